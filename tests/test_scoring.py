from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from pairloom import fixed
from pairloom.config import GateConfig, ScoreConfig
from pairloom.functions import scoring, text
from pairloom.operators import pairing
from tests import plain

SFT = "sft_index long, instruction string, input string, output string, topic string, difficulty string"
PREF = "sft_index long, prompt string, chosen string, rejected string, topic string, quality_difference double"

SPACES = ["", " ", "\n\t", "\xa0", " 　", "\x1c\x1f", "​"]
TEXTS = SPACES + [
    "...", "a", "one. two. three. four", "one. two.", "end.", " . . x . ", "a\xa0b c a", "\x85x\x1dy",
    "The theory of systems: algorithm, model, structure, framework. For example, in detail. Analysis.",
    "ΑΣ latest", "İstanbul. ẞ", "🦆 quack. 🦆 quack",
] + ["x" * n for n in (19, 20, 49, 50, 99, 100, 199, 200, 500, 501, 1000, 1001, 2000, 2001)]


def test_text_functions_match_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    rows = df.select(
        "t",
        text.not_blank("t").alias("seen"),
        text.sentence_count("t").alias("sentences"),
        text.words("t").alias("words"),
        text.strip("t").alias("strip"),
        text.plain_spaces("t").alias("plain"),
    ).collect()
    for r in rows:
        assert r.seen == bool(r.t.strip()), repr(r.t)
        assert r.sentences == sum(1 for s in r.t.split(".") if s.strip()), repr(r.t)
        assert r.words == r.t.split(), repr(r.t)
        assert r.strip == r.t.strip(), repr(r.t)
        assert r.plain.split() == r.t.split()


def test_answer_score(spark):
    extra = [" ".join(fixed.TECHNICAL_TERMS[:n]) for n in range(11)]
    extra += [". ".join(fixed.QUALITY_INDICATORS[:n]) + "x" * 100 for n in range(9)]
    df = spark.createDataFrame([(t,) for t in TEXTS + extra], "t string")
    for r in df.select("t", scoring.answer_score("t").alias("s")).collect():
        assert r.s == plain.answer_score(r.t), repr(r.t)
    assert max(plain.answer_score(t) for t in extra) < 0.96


def _pairs():
    sides = [
        dict(instruction="Explain recursion", input="", output="It maintains a stack. " * 5, topic="Physics", difficulty="easy"),
        dict(instruction="te", input=None, output="st of strength in numbers and words", topic="", difficulty=None),
        dict(instruction="We sort the data", input="", output="and keep all of the data", topic="History", difficulty="expert"),
        dict(instruction="the latest news", input=" ", output="is an example", topic=None, difficulty="hard"),
        dict(instruction=" ", input="x", output="\n", topic="Physics", difficulty="medium"),
        dict(instruction="We analyze a novel event", input="y" * 30, output="Energy. Law. Poetry. " * 30, topic="Physics", difficulty="medium"),
        dict(instruction="q" * 900, input="w" * 100, output="e" * 1000, topic="Physics", difficulty="hard"),
        dict(instruction="q" * 900, input="w" * 100, output="e" * 1001, topic="Physics", difficulty="hard"),
    ]
    prefs = [
        dict(prompt="Explain recursion", chosen="It calls itself. Twice.", rejected="No idea at all", topic="Physics", quality_difference=0.1),
        dict(prompt="structure of things", chosen="a whole answer here", rejected="a part", topic="", quality_difference=0.5),
        dict(prompt="a", chosen="b" * 980, rejected="c", topic="History", quality_difference=0.09999),
        dict(prompt="p", chosen="c" * 1990, rejected="r", topic=None, quality_difference=None),
        dict(prompt="p", chosen="c" * 60, rejected=" ", topic="Physics", quality_difference=0.9),
    ]
    return list(itertools.product(sides, prefs))


def _frames(spark):
    pairs = _pairs()
    sft = [(i, s["instruction"], s["input"], s["output"], s["topic"], s["difficulty"]) for i, (s, _) in enumerate(pairs)]
    pref = [(i, p["prompt"], p["chosen"], p["rejected"], p["topic"], p["quality_difference"]) for i, (_, p) in enumerate(pairs)]
    return pairs, spark.createDataFrame(sft, SFT), spark.createDataFrame(pref, PREF)


def test_pair_scores_with_default_words(spark):
    pairs, sft, pref = _frames(spark)
    rows = {r.pair_id: r for r in pairing.score_pairs(sft, pref).collect()}
    assert len(rows) == len(pairs)
    for i, (s, p) in enumerate(pairs):
        r = rows[i]
        got = (r.sft_ok, r.preference_ok, r.quality, r.relevance, r.diversity, r.difficulty_score, r.score)
        assert got == plain.scores(s, p), (s, p)


def test_keyword_across_the_joint(spark):
    cfg = ScoreConfig(categories=(("data structure",), ("tion ",), ("zzz",)))
    s = dict(instruction="a b c d e f g", input="", output="all our data", topic=None)
    p = dict(prompt="structure it is", chosen="nation", rejected="other words", topic=None, quality_difference=0.5)
    sft = spark.createDataFrame([(0, s["instruction"], "", s["output"], None, None)], SFT)
    pref = spark.createDataFrame([(0, p["prompt"], p["chosen"], p["rejected"], None, 0.5)], PREF)
    row = pairing.score_pairs(sft, pref, cfg).first()
    assert row.relevance == plain.scores(s, p, cfg)[3] == 0.2


def test_every_default_word_counts(spark):
    words = [w for ws in fixed.CATEGORIES.values() for w in ws]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    bits = df.select("t", F.bit_count(scoring.category_bits("t", tuple(fixed.CATEGORIES.values()))).alias("n"))
    for r in bits.collect():
        assert r.n == sum(any(w in r.t for w in ws) for ws in fixed.CATEGORIES.values()), r.t


def test_gate_bounds_and_standalone_columns(spark):
    _, sft, pref = _frames(spark)
    by_column = sft.select("sft_index", scoring.sft_gate(GateConfig()).alias("ok")).collect()
    by_feature = {r.pair_id: r for r in pairing.score_pairs(sft, pref).collect()}
    assert all(by_feature[r.sft_index].sft_ok == r.ok for r in by_column)


def test_difference_is_never_negative(spark):
    df = spark.createDataFrame([("short", "x. y. z. w. " * 30), (None, "a"), ("a", "a")], "c string, r string")
    assert [r.d for r in df.select(scoring.quality_difference("c", "r").alias("d")).collect()] == [0.0, 0.0, 0.0]
