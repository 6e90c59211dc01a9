"""The prefix trie against plain Python: ties, nulls, long and turnless conversations."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pairloom.llm.prefix_trie import prefix_trie, turn_digest
from pairloom.llm.queries import op13_prefix_trie, rebuilt_conversations

SCHEMA = "conv_id long, turn long, role string, text string, depth string, name int, last string"


def _digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def _rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, _digest(role, text), role, text))
    own = {c: [(role, text) for *_, role, text in sorted(x)] for c, x in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - (abs(c) % 5) * (1 if c > 0 else -1), [])[:h] + own[c][h:]
    return out


def _plain(seqs):
    """Nodes by walking each sequence through nested dicts."""
    def new(parent, size, depth):
        return {"kids": {}, "members": [], "ends": [], "parent": parent, "size": size, "depth": depth}

    if not seqs:
        return []
    root = new(None, 0, 0)
    nodes = [root]
    for c, turns in sorted(seqs.items()):
        at = root
        at["members"].append(c)
        for t in turns:
            if t not in at["kids"]:
                at["kids"][t] = new(at, len(t[1].encode()), at["depth"] + 1)
                nodes.append(at["kids"][t])
            at = at["kids"][t]
            at["members"].append(c)
        at["ends"].append(c)
    for n in sorted(nodes, key=lambda n: -n["depth"]):
        n["leaves"] = sum(k["leaves"] for k in n["kids"].values()) if n["kids"] else 1
        n["saved"] = (len(n["members"]) - 1) * n["size"] + sum(k["saved"] for k in n["kids"].values())
    return sorted(
        (
            (n["members"][0], n["depth"], n["parent"]["members"][0] if n["parent"] else None, len(n["members"]), len(n["kids"]), n["leaves"], n["saved"],
             hashlib.sha256(",".join(map(str, n["ends"])).encode()).hexdigest())
            for n in nodes
        ),
        key=repr,
    )


def _got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _table(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, "d", 1, "l") for r in rows], SCHEMA).repartition(5)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_all_cases(spark, tmp_path):
    r = random.Random(8)
    rows = []
    for c in [-12, -11, -10, *range(0, 90)]:
        if c % 13 == 12:
            continue  # an absent conversation, sometimes a base
        for turn in range(r.randrange(1, 12)):
            rows.append((c, r.choice([turn, turn, None, turn // 2]), r.choice(["user", "assistant", "", None]), r.choice(["", None, "ä", "long " * 9, "b"])))
    rows += [(None, 0, "user", "x"), (200, 0, "user", "y"), (200, 0, "user", "y"), (201, None, None, None)]
    rows += [(c, 0, "user", "z") for c in (501, 502, 503, 504, 506, 507, 508, 509)]  # one turn, no base
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(0, 300) for t in range(3)]  # a large group of copies
    rows += [(2000 + c, t, "user", "same 0" if t == 0 else f"other {c}") for c in range(100) for t in range(2)]
    path = _table(spark, tmp_path, rows)
    want = _plain(_rebuilt(rows))
    assert any(not s for s in _rebuilt(rows).values())  # turnless ones are among them
    assert _got(op13_prefix_trie(spark, path)) == want


def test_conversations_over_several_blocks(spark):
    """Over 64 * 64 turns, so that names and totals go through three levels of blocks."""
    r = random.Random(4)
    long = [("u", f"t{r.randrange(50)}") for _ in range(4300)]
    seqs = {c: list(long[:n]) for c, n in enumerate([4300, 4300, 4200, 4097, 4096, 2048, 300, 129, 128, 127, 65, 64, 63, 1, 0])}
    seqs[20] = long[:4150] + [("u", "x")] * 40
    seqs[21] = long[:64] + [("u", "y")] * 64 + long[:200]
    seqs[22] = long[:100] + [("v", "y")] * 70
    rows = [(c, i, *t) for c, s in seqs.items() for i, t in enumerate(s)]
    length = spark.createDataFrame([(c, len(s)) for c, s in seqs.items()], "conv_id long, length long")
    turns = spark.createDataFrame(rows, "conv_id long, pos long, role string, text string").join(length, "conv_id")
    turns = turns.select("conv_id", "pos", turn_digest(F.col("role"), F.col("text")).alias("digest"), F.octet_length("text").alias("n_bytes"), (F.col("pos") == F.col("length") - 1).alias("last"), F.lit(1).alias("name"))
    assert _got(prefix_trie(turns, length)) == _plain(seqs)


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "x")], [(7, 3, "user", "x")], [(8, 0, "user", "a"), (8, 1, "assistant", "b"), (6, 0, "user", "c")]])
def test_small_tables(spark, tmp_path, rows):
    assert _got(op13_prefix_trie(spark, _table(spark, tmp_path, rows))) == _plain(_rebuilt(rows))


def test_rebuilt_turns_are_dense(spark, tmp_path):
    rows = [(c, t, "user", f"{c} {t}") for c in range(30) for t in range(c % 7)]
    turns, convs = rebuilt_conversations(spark.read.parquet(f"{_table(spark, tmp_path, rows)}/conversations.parquet"))
    length = {r.conv_id: r.length for r in convs.collect()}
    places = defaultdict(list)
    for t in turns.collect():
        places[t.conv_id].append((t.pos, t.last))
    assert {c: len(s) for c, s in _rebuilt(rows).items()} == length
    assert all(sorted(p) == [(i, i == length[c] - 1) for i in range(length[c])] for c, p in places.items())
