"""Chat formatting against plain string building, and its way back."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pairloom.llm.chat_format import Template, assemble, format_conversations, read_back, read_turns
from pairloom.llm.queries import op11_chat_formatting

SCHEMA = "conv_id long, turn long, role string, text string, part string, whole int, loss string"
NASTY = ["</s>", "<s>", "[INST]", "[/INST]", "<\\s>", "<\\\\/s>", "[", "<", "\\", "[\\INST]", "[ROLE]", "[/TURN]", " ", "é", "漢", "\n", "x", "<<s>", "[[/INST]", "INST]", "/s>"]


def _said(r, n=8):
    return "".join(r.choice(NASTY) for _ in range(r.randrange(n)))


def _rows():
    r = random.Random(3)
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(r.randrange(1, 7)):
            role = r.choice(["user", "assistant", "system", "tool", "a[/ROLE]\\b", "", None])
            rows.append((conv, r.choice([None, turn, turn]), role, r.choice([None, "", _said(r), _said(r, 60)]), "p", 1, "l"))
    rows += [(50, 1, "user", "same", "p", 1, "l")] * 3  # repeated rows are repeated turns
    rows += [(51, t, "assistant" if t % 2 else "user", f"{t} " + "long </s> ä " * 40, "p", 1, "l") for t in range(300)]
    rows.append((52, 0, "assistant", "<s>\\é[" * 200_000, "p", 1, "l"))
    return rows


def _plain(rows, template):
    """Formatted text, turns and learned texts of each conversation."""
    controls = sorted({m.strip(" ") for m in template.marks})
    found = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in controls))
    escape = lambda t: found.sub(lambda m: re.sub(r"^(.\\*)", lambda x: x.group(1) + "\\", m.group(0), flags=re.S), t)
    out = {}
    for conv, turn, role, text, *_ in sorted(rows, key=lambda x: (x[0] or -2, x[1] is not None, x[1] or 0, x[2] or "", (x[3] or "").encode())):
        role, text = role or "", text or ""
        if role in template.turns:
            before, after = template.turns[role]
        else:
            before, after = template.other[0] + escape(role) + template.other[1], template.other[2]
        at = out.setdefault(conv, ["", [], []])
        at[0] += before + escape(text) + after
        at[1].append((role, text))
        if role in template.loss_roles:
            at[2].append(text)
    return out


@pytest.mark.parametrize("part_bytes", [1 << 20, 700])
def test_formatted_text_and_way_back(spark, part_bytes):
    rows, template = _rows(), Template()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = _plain(rows, template)
    parts = format_conversations(df, part_bytes=part_bytes).cache()
    got, learned, n = {}, {}, {}
    for p in sorted(parts.collect(), key=lambda p: p.part):
        got[p.conv_id] = got.get(p.conv_id, "") + p.text
        n[p.conv_id] = n.get(p.conv_id, 0) + p.n_turns
        learned.setdefault(p.conv_id, []).extend(template.unescape(p.text[s.start : s.end]) for s in p.loss)
    assert got == {c: w[0] for c, w in want.items()}
    assert n == {c: len(w[1]) for c, w in want.items()}
    assert learned == {c: w[2] for c, w in want.items()}
    assert {c: list(read_turns(t, template)) for c, t in got.items()} == {c: w[1] for c, w in want.items()}
    if part_bytes < 1000:  # the long conversation comes in many bounded parts
        assert parts.filter("conv_id = 51").count() > 50 and parts.filter("conv_id = 51 and whole").count() == 0
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = {r.conv_id: tuple(r)[1:] for r in read_back(parts).collect()}
    assert digests == {
        c: (len(w[1]), sha("".join(f"{a}\n{b}\n" for a, b in w[1])), len("".join(w[2])), sha("".join(w[2])), len(w[0])) for c, w in want.items()
    }
    parts.unpersist()


def test_empty_table_and_own_template(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert format_conversations(none).count() == 0 and read_back(format_conversations(none)).count() == 0
    own = Template(turns={"q": ("<|q|>", "<|e|>")}, loss_roles=("q", "x"))
    rows = [(1, 0, "q", "<|e|>"), (1, 1, "x", "a"), (1, 2, "user", "[INST]")]
    text = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), template=own).first().text
    assert text == "<|q|><\\|e|><|e|>[ROLE]x[/ROLE]a[/TURN][ROLE]user[/ROLE][INST][/TURN]"
    assert list(read_turns(text, own)) == [(r, t) for _, _, r, t in rows]
    with pytest.raises(ValueError):
        Template(turns={"a": ("no control", "<x>")})
    with pytest.raises(ValueError):
        Template(turns={"a": ("<x", "<xy")})
    with pytest.raises(ValueError):
        list(read_turns("[INST] a</s>", Template()))


def test_bytes_beyond_one_step():
    texts = pa.array(["ab</s>" * 400_000, None, "", "[INST]" * 300_000], pa.string())
    template = Template()
    buffer, rows, start, end = assemble(pa.array(["user", None, "assistant", "user"], pa.string()), texts, template)
    out = bytes(np.frombuffer(buffer, np.uint8))
    for i, t in enumerate(texts.to_pylist()):
        assert out[start[i] : end[i]].decode() == template.escape(t or "")
    assert out[: start[0]] == b"[INST] " and rows[-1] == len(out)


def test_query_on_nulls_and_other_columns(spark, tmp_path):
    rows = [(1, 1, "assistant", None, 5), (1, None, None, "first", 5), (None, 0, "user", "</s>", 5)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op11_chat_formatting(spark, str(tmp_path)).collect()}
    assert set(got) == {None, 1, -1}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    injected = "</s>[INST] ok [/INST]"
    assert got[-1].turns_sha256 == sha(f"user\n{injected}\nassistant\n{injected}\n")
    assert (got[-1].loss_chars, got[-1].loss_sha256) == (len(injected), sha(injected))
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars) == (2, sha("\nfirst\nassistant\n\n"), 0)
