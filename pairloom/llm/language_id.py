"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A run of three letters is bound into
one vector: the first letter's vector shifted by two places, times the second's shifted by
one, times the third's. The vectors of all runs of a text are bundled (added). A language's
prototype is the bundle of its training texts, and a text gets the language whose prototype
has the largest cosine with the text's bundle.

Bundles are sums, so the prototypes come from partial sums per task. Texts never move.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm import scan
from pairloom.llm.tables import small_batches

DIM = 1024
NO_LANGUAGE = "und"
#: Prototypes go to every executor; more languages than this are refused.
MAX_LANGUAGES = 4096
DOCS_AT_ONCE = 64
GRAMS_AT_ONCE = 4096
#: Bytes of text whose runs are counted at once; their arrays take some hundred times as much.
TEXT_BYTES = 1 << 18
#: Up to so many possible runs are counted in an array, more are sorted.
COUNTED_RUNS = 1 << 20
SEED = 11


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


@cache
def letter_vector(code: int, dim: int) -> np.ndarray:
    """+1 and -1 from the code point alone, so every task and every run agrees."""
    bits = np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, dim, dtype=np.int8)
    return bits * np.int8(2) - np.int8(1)


def gram_vectors(codes: np.ndarray, dim: int) -> np.ndarray:
    """One row per run of three letters (columns of ``codes``)."""
    out = None
    for place in range(3):
        letters, which = np.unique(codes[:, place], return_inverse=True)
        table = np.stack([np.roll(letter_vector(int(c), dim), 2 - place) for c in letters])
        out = table[which] if out is None else out * table[which]
    return out.astype(np.float32)


class Grams:
    """The runs of three letters of some texts: distinct runs, and which text has which.
    A run does not cross a gap between words; a gap may stand at either end."""

    def __init__(self, texts: list[str | None]):
        joined = "\0".join(["", *[(t or "").lower().replace("\0", " ") for t in texts], ""])
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        row = np.cumsum(codes == 0) - 1
        codes = np.where(_letters()[codes], codes, 0)
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        codes, row = codes[keep], row[keep]
        letters, small = np.unique(codes, return_inverse=True)
        base = len(letters)
        run = (small[:-2] * base + small[1:-1]) * base + small[2:]
        whole = codes[1:-1] != 0
        run, self.row = run[whole], row[1:-1][whole]
        if base**3 <= COUNTED_RUNS:
            seen = np.flatnonzero(np.bincount(run, minlength=1))
            number = np.zeros(base**3, np.int64)
            number[seen] = np.arange(len(seen))
            self.gram = number[run]
        else:
            seen, self.gram = np.unique(run, return_inverse=True)
        self.codes = np.stack([letters[seen // base**2], letters[seen // base % base], letters[seen % base]], axis=1)

    def bundles(self, group: np.ndarray, n_groups: int, dim: int) -> np.ndarray:
        """The summed vectors of the runs of every group of texts."""
        out = np.zeros((n_groups, dim), np.float64)
        owner = group[self.row]
        for a in range(0, len(self.codes), GRAMS_AT_ONCE):
            b = min(a + GRAMS_AT_ONCE, len(self.codes))
            vectors = gram_vectors(self.codes[a:b], dim)
            part = (self.gram >= a) & (self.gram < b) if b - a < len(self.codes) else slice(None)
            mine, grams = owner[part], self.gram[part] - a
            for g in range(0, n_groups, DOCS_AT_ONCE):
                h = min(g + DOCS_AT_ONCE, n_groups)
                sel = (mine >= g) & (mine < h)
                counts = np.bincount((mine[sel] - g) * (b - a) + grams[sel], minlength=(h - g) * (b - a))
                out[g:h] += counts.reshape(h - g, b - a).astype(np.float32) @ vectors
        return out


def _parts(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    _, offsets = scan.utf8(column)
    for i, j in scan.blocks(offsets, TEXT_BYTES):
        yield i, column.slice(i, j - i).to_pylist()


def train_prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM) -> dict[str, np.ndarray]:
    """Language to unit vector, from all rows that have a text and a language. Empty input
    gives no prototypes. The driver gets one vector per language."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for i, texts in _parts(batch.column(0)):
                names = sorted(set(langs[i : i + len(texts)]))
                number = {x: k for k, x in enumerate(names)}
                group = np.array([number[x] for x in langs[i : i + len(texts)]])
                for name, vector in zip(names, Grams(texts).bundles(group, len(names), dim), strict=True):
                    sums[name] = sums.get(name, 0) + vector
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
            names=["lang", "bundle"],
        )

    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    parts = rows.mapInArrow(partial, "lang string, bundle array<double>")
    summed = parts.select("lang", F.posexplode("bundle").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    whole = summed.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    with small_batches(docs.sparkSession):
        found = whole.orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out = {}
    for r in found:
        v = np.array(r.v)
        if norm := np.linalg.norm(v):
            out[r.lang] = v / norm
    return out


def identifier(prototypes: dict[str, np.ndarray]):
    """A column function from text to ``struct<lang, score, letters>``. The score is the
    cosine, at least 0; ``letters`` is their number. Null, a text without letters, or no prototypes give ``und`` and 0. Of
    equal cosines the first language in alphabetical order wins."""
    names = sorted(prototypes)
    matrix = np.stack([prototypes[n] for n in names]) if names else np.zeros((0, DIM))

    def identify(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            langs, scores, letters = [], [], []
            for _, texts in _parts(column):
                grams = Grams(texts)
                letters += np.bincount(grams.row, minlength=len(texts)).tolist()
                if not names:
                    langs += [NO_LANGUAGE] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                bundles = grams.bundles(np.arange(len(texts)), len(texts), matrix.shape[1])
                length = np.linalg.norm(bundles, axis=1)
                cosine = bundles @ matrix.T / np.where(length > 0, length, 1)[:, None]
                best = cosine.argmax(axis=1)
                for k, (b, n) in enumerate(zip(best.tolist(), length.tolist(), strict=True)):
                    langs.append(names[b] if n > 0 else NO_LANGUAGE)
                    scores.append(min(1.0, max(0.0, float(cosine[k, b]))) if n > 0 else 0.0)
            columns = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(letters, pa.int64())]
            yield pa.StructArray.from_arrays(columns, names=["lang", "score", "letters"])

    return F.arrow_udf(identify, "lang string, score double, letters long").asNondeterministic()


def held_out(id_col: Column | str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text falls in the fold; a null id is held out."""
    c = id_col if isinstance(id_col, Column) else F.col(id_col)
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds == fold, F.lit(True))


def identify_languages(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` in a struct ``row`` (so any names may occur), ``lang_pred``,
    ``score`` and ``letters``, the number of letters."""
    found = docs.select(F.struct("*").alias("row")).withColumn("_found", identifier(prototypes)(F.col("row").getField(text_col)))
    return found.select("row", F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score"), F.col("_found.letters").alias("letters"))


#: Texts of fewer letters than this power of two have too few runs to be judged.
LEAST_LETTERS = 5


def score_floors(found: DataFrame, share: float = 0.25) -> dict[int, float]:
    """What a text in a learned language reaches at least, by the power of two that its number
    of letters reaches: ``share`` of the median score of the texts from which the languages
    were learned (``found``: their rows of ``identify_languages``). Short texts score lower, so
    each length has its own floor; lengths without such texts, and those below
    ``LEAST_LETTERS``, have none. At most 32 numbers reach the driver."""
    rows = found.filter(F.col("letters") >= 1 << LEAST_LETTERS).groupBy(F.floor(F.log2("letters")).alias("length"))
    with small_batches(found.sparkSession):
        middles = rows.agg(F.percentile_approx("score", 0.5, 10_000).alias("middle")).collect()
    return {r.length: r.middle * share for r in middles}


def reaches(floors: dict[int, float]) -> Column:
    """Whether a row of ``identify_languages`` is in one of the learned languages."""
    floor = F.lit(0.0)
    for length, low in floors.items():
        floor = F.when(F.col("letters").between(1 << length, (2 << length) - 1), F.lit(low)).otherwise(floor)
    return (F.col("lang_pred") != NO_LANGUAGE) & (F.col("score") >= floor)
