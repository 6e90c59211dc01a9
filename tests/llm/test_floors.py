"""Language scores against plain sums, and what the pipeline's language stage rejects."""

from __future__ import annotations

import base64
import random
import zlib

import numpy as np

import corpus_pipeline
from pairloom.llm.language_id import DIM, identify_languages, letter_vector, train_prototypes
from pairloom.llm.tables import table


def bundle(text):
    """Sum of the bound vectors of all runs of three letters; a gap may stand at either end."""
    codes = [0, *[ord(c) if c.isalpha() else 0 for c in (text or "").lower()], 0]
    codes = [c for i, c in enumerate(codes) if c or not i or codes[i - 1]]
    out = np.zeros(DIM)
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        if b:
            out += np.roll(letter_vector(a, DIM), 2).astype(float) * np.roll(letter_vector(b, DIM), 1) * letter_vector(c, DIM)
    return out


def test_scores_are_cosines(spark):
    texts = {1: "The cat and the dog", 2: "Die Katze, und der Hund!", 3: "the dogs", 4: "", 5: None, 6: "12 --", 7: "der die das Und", 8: "漢字 x"}
    langs = {1: "en", 2: "de", 3: "en", 7: "de"}
    docs = spark.createDataFrame([(d, t, langs.get(d)) for d, t in texts.items()], "doc_id long, text string, lang string")
    prototypes = train_prototypes(docs.filter("lang IS NOT NULL"))
    want = {x: sum(bundle(texts[d]) for d in langs if langs[d] == x) for x in ("de", "en")}
    for x, v in want.items():
        assert np.allclose(prototypes[x], v / np.linalg.norm(v))
    for r in identify_languages(docs, prototypes).select("row.doc_id", "lang_pred", "score").collect():
        v = bundle(texts[r.doc_id])
        if not v.any():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosine = {x: v @ w / np.linalg.norm(v) / np.linalg.norm(w) for x, w in want.items()}
        assert r.lang_pred == max(cosine, key=cosine.get) and np.isclose(r.score, max(0, max(cosine.values())), atol=1e-5)


def test_stage_rejects_what_is_in_no_language(spark, sf):
    docs = table(spark, sf.replace("sf0.001", "sf0.01"), "documents")
    r = random.Random(1)
    say = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    noise = [say(n) for n in (80, 200, 800, 3000) * 5]
    noise += ["".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(n)) for n in (100, 1000)]
    noise += [base64.b64encode(r.randbytes(n)).decode() for n in (300, 3000)]
    # Under ids of the held-out fold and others, with and without a language.
    rows = [(10**9 + i, t, r.choice(["en", None]), "src0", len(t)) for i, t in enumerate(noise)]
    assert {zlib.crc32(str(x[0]).encode()) % 3 == 1 for x in rows} == {True, False}
    both = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = {x.doc_id: x.text for x in corpus_pipeline.language_id(spark, both, "").collect()}
    assert not [i for i in kept if i >= 10**9]
    spoken = [x.doc_id for x in docs.collect() if x.text and any(c.isalpha() for c in x.text)]
    assert len(kept) >= 0.995 * len(spoken)
