"""One query per operator group, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairloom import fixed
from pairloom.config import ScoreConfig
from pairloom.functions import prompts, tutoring
from pairloom.functions.scoring import answer_score, preference_gate, quality_difference, sft_gate, spaced
from pairloom.functions.text import not_blank, words
from pairloom.operators import (
    diversity,
    frequent,
    hook,
    judging,
    pairing,
    preferences,
    profiling,
    ranking,
    templates,
    training,
    tutor,
    vectors,
)
from pairloom.operators.indexing import with_dense_index
from pairloom.operators.responder import respond
from pairloom.plans import curation, fixtures as fx
from pairloom.session import fresh_dir
from pairloom.sources import files, resume, runs, schemas
from pairloom.streaming import lists, profiles, scores

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TOP = 300
TOP_PER_TOPIC = 20
PART = 3
WORDS = 10
COUNTERS = 64
NEAR = 0.9
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
ARRAY = "sft_index bigint, instruction string, input string, output string"
SEED = fixed.SPLIT_SEED


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


# ---- pairing, gates, scores, selection ---------------------------------------------


def _flat(pairs: DataFrame, *extra: str) -> DataFrame:
    return pairs.select(
        "pair_id",
        r6("score").alias("score"),
        *extra,
        F.col("sft.topic").alias("topic"),
        F.col("sft.difficulty").alias("difficulty"),
        F.col("sft.instruction").alias("instruction"),
        F.col("sft.input").alias("input"),
        F.col("sft.output").alias("output"),
        F.col("preference.rejected").alias("rejected"),
    )


@query
def curated_topk(spark, sf):
    return _flat(curation.curate_pairs(fx.sft(spark, sf), fx.preferences(spark, sf), TOP, fx.SCORING))


@query
def curated_topk_gated(spark, sf):
    return _flat(curation.curate_pairs(fx.sft(spark, sf), fx.preferences(spark, sf), TOP, fx.SCORING, gated=True))


@query
def topk_per_topic(spark, sf):
    kept = curation.best_pairs(
        fx.sft(spark, sf), fx.preferences(spark, sf), TOP_PER_TOPIC, fx.SCORING, per="topic"
    )
    return rounded(kept, "score")


@query
def ranked_pairs(spark, sf):
    scored = pairing.score_pairs(fx.sft(spark, sf), fx.preferences(spark, sf), fx.SCORING)
    return rounded(ranking.rank(scored.select("pair_id", "score")), "score")


@query
def score_parts(spark, sf):
    scored = pairing.score_pairs(fx.sft(spark, sf), fx.preferences(spark, sf), fx.SCORING)
    return rounded(scored, *pairing.SCORES)


@query
def gate_flags(spark, sf):
    left = fx.sft(spark, sf).select("sft_index", sft_gate().alias("sft_ok"))
    right = fx.preferences(spark, sf).select("sft_index", preference_gate().alias("preference_ok"))
    return left.join(right, "sft_index")


@query
def curated_topk_sorted(spark, sf):
    """The same selection by a distributed sort instead of an ordered limit, and with the
    ids joined by shuffle: what a large ``n`` takes."""
    scored = pairing.score_pairs(fx.sft(spark, sf), fx.preferences(spark, sf), fx.SCORING)
    return rounded(ranking.top_n(scored.select("pair_id", "score"), TOP, limit=0), "score")


@query
def topk_per_topic_sorted(spark, sf):
    scored = pairing.score_pairs(fx.sft(spark, sf), fx.preferences(spark, sf), fx.SCORING, keep=("topic",))
    kept = ranking.top_n_per(scored.select("pair_id", "score", "topic"), "topic", TOP_PER_TOPIC, limit=0)
    return rounded(kept.select("pair_id", "score", "rank"), "score")


@query
def curated_per_topic(spark, sf):
    """The best pairs of every topic, with their texts."""
    kept = curation.curate_pairs(
        fx.sft(spark, sf), fx.preferences(spark, sf), TOP_PER_TOPIC, fx.SCORING, per="topic"
    )
    return _flat(kept)


@query
def quota_topk(spark, sf):
    """The best pairs with the mix of topics and difficulties that all pairs have."""
    kept = curation.curate_pairs(fx.sft(spark, sf), fx.preferences(spark, sf), TOP, fx.SCORING, quota=("topic", "difficulty"))
    return _flat(kept)


@query
def diverse_topk(spark, sf):
    """Pairs chosen for the words that they add and for their score."""
    scored = pairing.score_pairs(fx.sft(spark, sf), fx.preferences(spark, sf), fx.SCORING)
    texts = fx.sft(spark, sf).select("sft_index", diversity.word_features(spaced("instruction", "input", "output")).alias("features"))
    rows = texts.join(scored.select(F.col("pair_id").alias("sft_index"), "score"), "sft_index")
    return rounded(diversity.diverse_top_n(rows, TOP, F.col("features"), score="score", score_weight=WORDS), "gain")


@query
def score_parts_default(spark, sf):
    """Scores with the published vocabularies."""
    scored = pairing.score_pairs(fx.sft(spark, sf), fx.preferences(spark, sf), ScoreConfig())
    return rounded(scored, *pairing.SCORES)


@query
def unzipped_sides(spark, sf):
    kept = curation.curate_pairs(fx.sft(spark, sf), fx.preferences(spark, sf), TOP, fx.SCORING)
    left, right = pairing.unzip_pairs(kept)
    one = left.agg(F.lit("sft").alias("side"), F.count("*").alias("n"), F.sum("sft_index").alias("keys"))
    two = right.agg(F.lit("preference").alias("side"), F.count("*").alias("n"), F.sum("sft_index").alias("keys"))
    return one.unionByName(two)


@query
def unpaired_left(spark, sf):
    return pairing.unpaired(fx.sft(spark, sf), fx.reviewed(spark, sf)).select("sft_index", "topic", "difficulty")


@query
def positional_pairs(spark, sf):
    """Rows without a common key, paired by position; the shorter side decides."""
    docs = fx.table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    left = with_dense_index(docs, "n_chars", "doc_id", name="pos")
    right = with_dense_index(fx.table(spark, sf, "labels"), F.desc("doc_id"), name="pos").withColumnRenamed("doc_id", "label_id")
    return pairing.pair(left, right, "pos").select(
        "pair_id", F.col("sft.doc_id").alias("doc_id"), F.col("preference.label_id").alias("label_id")
    )


@query
def first_rows(spark, sf):
    """The first rows by a key with gaps."""
    return ranking.first_n(fx.table(spark, sf, "labels"), TOP_PER_TOPIC, "doc_id", dense=False)


# ---- continue modes ---------------------------------------------------------------


@query
def resume_hwm(spark, sf):
    """Documents above the highest one that a run reviewed which stopped halfway, all of
    them and those below a number."""
    src = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("sft_index"), "lang")
    labels = fx.table(spark, sf, "labels")
    middle = labels.agg(F.floor(F.avg("doc_id"))).scalar()
    done = labels.filter((F.col("quality") == 1) & (F.col("doc_id") <= middle)).select(F.col("doc_id").alias("sft_index"))
    n = src.agg(F.floor(F.max("sft_index") * 0.9)).first()[0]
    every = resume.pending_by_hwm(src, done).withColumn("mode", F.lit("all"))
    return every.unionByName(resume.pending_by_hwm(src, done, n=n).withColumn("mode", F.lit("below")))


@query
def resume_by_key(spark, sf):
    src = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("sft_index"), "lang", "source")
    return resume.pending_by_key(src, fx.reviewed(spark, sf))


@query
def resume_fresh_ids(spark, sf):
    """Ids still to be made when the labelled rows exist and all documents are wanted."""
    wanted = fx.table(spark, sf, "documents").count()
    return resume.remaining_ids(fx.reviewed(spark, sf), wanted)


@query
def extended_rows(spark, sf):
    """What exists and what was pending, together again."""
    src = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("sft_index"), "lang")
    done = src.join(fx.reviewed(spark, sf), "sft_index", "left_semi")
    whole = resume.extend(done.withColumn("state", F.lit("done")), resume.pending_by_key(src, done))
    return whole.groupBy("lang", "state").agg(F.count("*").alias("n"), F.sum("sft_index").alias("keys"))


@query
def jsonl_round_trip(spark, sf):
    """Written in two appends as JSON lines, read back, broken lines set aside."""
    path = fresh_dir(spark, "jsonl")
    rows = fx.sft(spark, sf)
    files.append_jsonl(rows.filter("input = ''"), path)
    files.append_jsonl(rows.filter("input <> ''"), path)
    # Turns are not JSON: appended as text, they are the bad lines.
    fx.table(spark, sf, "conversations").select(
        F.regexp_replace("text", r"[\r\n]+", " ").alias("value")
    ).write.mode("append").text(path)
    good, bad = files.read_jsonl(spark, path, schemas.SFT)
    kept = good.select("sft_index", "instruction", "input", "output", F.lit(True).alias("parsed"))
    return kept.unionByName(
        bad.select(F.col("value").alias("instruction"), F.lit(False).alias("parsed")), allowMissingColumns=True
    )


@query
def json_array_round_trip(spark, sf):
    """Written as one indented JSON array per part, read back in splits."""
    path = fresh_dir(spark, "array")
    rows = fx.sft(spark, sf).select("sft_index", "instruction", "input", "output")
    pretty = F.regexp_replace(F.to_json(F.struct("*"), {"pretty": "true"}), "(?m)^", "  ")
    # One array per block of keys: a file holds one array.
    bodies = rows.select((F.col("sft_index") / 500).cast("int").alias("block"), "sft_index", pretty.alias("j"))
    one = bodies.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("sft_index", "j"))).alias("all"))
    array = F.concat(F.lit("[\n"), F.array_join(F.transform("all", lambda x: x["j"]), ",\n"), F.lit("\n]"))
    one.select("block", array.alias("value")).write.partitionBy("block").text(path)
    return files.read_json_array(spark, f"{path}/*/*.txt", ARRAY, indent=2)


@query
def json_array_any_layout(spark, sf):
    """The same without line breaks between and inside the elements; read in splits too."""
    path = fresh_dir(spark, "array")
    rows = fx.sft(spark, sf).select("sft_index", "instruction", "input", "output")
    bodies = rows.select((F.col("sft_index") / 500).cast("int").alias("block"), "sft_index", F.to_json(F.struct("*")).alias("j"))
    one = bodies.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("sft_index", "j"))).alias("all"))
    array = F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["j"]), ","), F.lit("]"))
    one.select("block", array.alias("value")).write.partitionBy("block").text(path)
    return files.read_json_array(spark, f"{path}/*/*.txt", ARRAY)


@query
def continued_write(spark, sf):
    """A dataset written whole, then continued with the rows that were missing."""
    path = fresh_dir(spark, "dataset")
    src = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("sft_index"), "lang", "source")
    files.write_dataset(src.join(fx.reviewed(spark, sf), "sft_index", "left_semi"), path, mode="overwrite")
    done = spark.read.parquet(path)
    files.write_dataset(resume.pending_by_key(src, done), path, mode="continue")
    return spark.read.parquet(path)


@query
def finished_runs(spark, sf):
    """Two runs, the first of them repeated after it stopped halfway; every row counts once."""
    path = fresh_dir(spark, "runs")
    src = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("sft_index"), "lang", "source")
    first = src.join(fx.reviewed(spark, sf), "sft_index", "left_semi")
    # What a run leaves behind that was lost before its end.
    first.filter("lang = 'en'").withColumn("run_id", F.lit("first")).write.partitionBy("run_id").parquet(f"{path}/rows")
    schema = "sft_index bigint, lang string, source string"
    seen = runs.read_runs(spark, path, schema)
    runs.write_run(resume.pending_by_key(first, seen), path, "first")
    runs.write_run(resume.pending_by_key(src, runs.read_runs(spark, path, schema)), path, "second")
    return runs.read_runs(spark, path, schema)


@query
def split_failures(spark, sf):
    """Rows whose answer failed, apart from the others; none stops the job."""
    docs = fx.sft(spark, sf).withColumn("error", F.when(~not_blank("output"), "empty answer"))
    ok, failed = resume.split_errors(docs)
    return ok.select("sft_index", F.lit("ok").alias("state")).unionByName(failed.select("sft_index", F.lit("failed").alias("state")))


# ---- profiles -----------------------------------------------------------------------


@query
def length_profile(spark, sf):
    sides = {
        "sft": (fx.sft(spark, sf), ("instruction", "input", "output")),
        "preference": (fx.preferences(spark, sf), ("prompt", "chosen", "rejected")),
    }
    parts = [
        profiling.numeric_profile(df, {name: F.length(spaced(*cs))}) for name, (df, cs) in sides.items()
    ]
    return rounded(parts[0].unionByName(parts[1]), "avg", "std")


@query
def topic_distribution(spark, sf):
    return rounded(profiling.distribution(fx.sft(spark, sf), "topic", "Unknown", "sft_index"), "pct")


@query
def difficulty_distribution(spark, sf):
    return rounded(profiling.distribution(fx.sft(spark, sf), "difficulty", "medium", "sft_index"), "pct")


def _strategies(spark, sf):
    return fx.sft(spark, sf).select("sft_index", preferences.strategy("sft_index").alias("degradation_strategy"))


@query
def strategy_distribution(spark, sf):
    return rounded(
        profiling.distribution(_strategies(spark, sf), "degradation_strategy", "unknown", "sft_index"), "pct"
    )


@query
def frequent_words(spark, sf):
    """The ten most frequent words of all texts, from bounded counters per task."""
    rows = fx.documents(spark, sf).select(words(F.lower("text")).alias("words"))
    return frequent.most_frequent(rows, "words", WORDS, counters=COUNTERS)


@query
def criteria_frequency(spark, sf):
    rows = fx.sft(spark, sf).select(preferences.sample_criteria("sft_index").alias("criteria_used"))
    return rounded(profiling.distribution(rows, "criteria_used"), "pct")


@query
def diff_stats(spark, sf):
    pref = fx.preferences(spark, sf)
    stats = profiling.numeric_profile(pref, {"quality_difference": F.coalesce("quality_difference", F.lit(0.0))})
    return rounded(stats, "avg", "std", "min", "max")


@query
def diff_histogram(spark, sf):
    return rounded(profiling.bucket_counts(fx.preferences(spark, sf), "quality_difference", (0.3, 0.6)), "pct")


@query
def input_share(spark, sf):
    return rounded(profiling.share(fx.sft(spark, sf), not_blank("input")), "pct")


@query
def field_lengths(spark, sf):
    stats = profiling.numeric_profile(
        fx.sft(spark, sf),
        {
            "instruction": F.length("instruction"),
            "output": F.length("output"),
            "sft_index": F.coalesce("sft_index", F.lit(-1)),
        },
    )
    return rounded(stats, "avg", "std")


@query
def score_profile(spark, sf):
    kept = curation.best_pairs(fx.sft(spark, sf), fx.preferences(spark, sf), TOP, fx.SCORING)
    return rounded(profiling.numeric_profile(kept, {"score": F.col("score")}), "avg", "std", "min", "max")


@query
def validation_report(spark, sf):
    sft = fx.sft(spark, sf)
    return profiling.validate(sft, fx.reviewed(spark, sf), fixed.TARGET_PAIRS)


@query
def profile_grouping_sets(spark, sf):
    rows = fx.sft(spark, sf).select(
        "topic", "difficulty", preferences.strategy("sft_index").alias("degradation_strategy")
    )
    columns = {"topic": "Unknown", "difficulty": "medium", "degradation_strategy": "unknown"}
    return rounded(profiling.dataset_profile(rows, columns), "pct")


# ---- rows from templates ----------------------------------------------------------------


def _ids(spark, sf):
    return fx.table(spark, sf, "documents").select(F.col("doc_id").alias("sft_index"))


@query
def template_rows(spark, sf):
    return templates.template_rows(_ids(spark, sf), SEED)


@query
def template_rows_literal(spark, sf):
    return templates.template_rows(_ids(spark, sf), SEED, literal=True)


@query
def template_rows_wide(spark, sf):
    """A topic per part of the catalogue; their numbers come from the operator."""
    parts = fx.table(spark, sf, "part")
    topics = parts.select(
        F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("topic"),
        F.array("p_brand", "p_type").alias("concepts"),
        F.array(F.concat(F.lit("What is "), F.col("p_name"))).alias("questions"),
        F.array("p_type").alias("problem_types"),
    )
    return templates.template_rows(_ids(spark, sf), SEED, knowledge=topics)


@query
def generated_rows(spark, sf):
    """Template rows with a model's answer, or the fallback answer."""
    made = templates.generate_rows(_ids(spark, sf), echo, SEED)
    return made.select("sft_index", "instruction", "output", "error")


@query
def fallback_answers(spark, sf):
    rows = templates.template_rows(_ids(spark, sf), SEED)
    return rows.select(
        "sft_index", prompts.fallback_answer("instruction", "concept", "topic", "difficulty").alias("output")
    )


@query
def answer_prompts(spark, sf):
    rows = templates.template_rows(_ids(spark, sf), SEED)
    return rows.select(
        "sft_index",
        prompts.answer_system("topic", "concept", "difficulty").alias("system"),
        prompts.answer_user("instruction", "input").alias("user"),
    )


def echo():
    """Stands in for a model: repeats the request, fails where it finds a colon early."""

    def ask(system: str, user: str) -> str:
        if ":" in user[:40]:
            raise ValueError("refused")
        return f" {user} "

    return ask


def echo_with_settings():
    """The same for many requests at a time, telling the temperature each came with."""

    def ask_many(requests: list[dict]) -> list[str]:
        return [f"{r['temperature']:.1f} {r['user']}" for r in requests]

    return ask_many


@query
def responder_echo(spark, sf):
    rows = fx.chat(spark, sf)
    answered = respond(rows, F.lit(""), "instruction", echo, prompts.fallback_response("instruction"))
    return answered.select("conv_id", "turn", "response", "error")


# ---- preference rows -----------------------------------------------------------------------


@query
def prompt_concat(spark, sf):
    return fx.sft(spark, sf).select("sft_index", prompts.prompt_text("instruction", "input").alias("prompt"))


@query
def chosen_sides(spark, sf):
    return preferences.chosen_side(fx.sft(spark, sf))


@query
def strategy_round_robin(spark, sf):
    first = preferences.strategy("sft_index")
    rows = fx.sft(spark, sf).select("sft_index", "topic", "instruction", first.alias("strategy"))
    return rows.select(
        "sft_index",
        "strategy",
        preferences.other_strategy("sft_index", "strategy").alias("other"),
        prompts.degradation_system("strategy").alias("system"),
        prompts.degradation_prompt("instruction", F.coalesce("topic", F.lit("Unknown")), "strategy").alias("user"),
    )


@query
def degraded_answers(spark, sf):
    rows = fx.sft(spark, sf).withColumn("strategy", preferences.strategy("sft_index"))
    worse = preferences.degrade(rows, "output", "strategy")
    return worse.select("sft_index", "strategy", "degraded")


@query
def answer_quality(spark, sf):
    pref = fx.preferences(spark, sf)
    return pref.select(
        "sft_index",
        r6(answer_score("chosen", fx.ANSWERS)).alias("chosen_score"),
        r6(answer_score("rejected", fx.ANSWERS)).alias("rejected_score"),
        r6("quality_difference").alias("quality_difference"),
    )


@query
def answer_quality_default(spark, sf):
    """Answer scores with the published vocabularies."""
    pref = fx.preferences(spark, sf)
    return pref.select(
        "sft_index",
        r6(answer_score("chosen")).alias("chosen_score"),
        r6(answer_score("rejected")).alias("rejected_score"),
        r6(quality_difference("chosen", "rejected")).alias("quality_difference"),
    )


@query
def weak_pairs(spark, sf):
    """Pairs that get a second try, and what comes of it."""
    pref = fx.preferences(spark, sf).withColumn("degradation_strategy", preferences.strategy("sft_index"))
    again = preferences.retry_weak(pref, preferences.ByRule(), cfg=fx.ANSWERS)
    return again.select("retried", "sft_index", "degradation_strategy", "rejected", r6("quality_difference").alias("quality_difference"))


@query
def criteria_sample(spark, sf):
    rows = fx.sft(spark, sf).select("sft_index", preferences.sample_criteria("sft_index").alias("names"))
    return rows.select(
        "sft_index",
        preferences.criteria_text("names", None, ", ").alias("criteria"),
        preferences.criteria_text("names").alias("phrases"),
        preferences.reason("sft_index", "names").alias("reason"),
    )


@query
def preference_rows(spark, sf):
    made = preferences.build_preferences(fx.sft(spark, sf), cfg=fx.ANSWERS)
    return made.withColumns(
        {"criteria_used": F.array_join("criteria_used", ","), "quality_difference": r6("quality_difference")}
    )


@query
def preference_first_n(spark, sf):
    """Preference rows for the first instruction rows only."""
    made = preferences.build_preferences(fx.sft(spark, sf), cfg=fx.ANSWERS, n=TOP)
    return made.select("sft_index", "prompt", "chosen", "rejected", "degradation_strategy")


@query
def model_preferences(spark, sf):
    """The same with a model call per row and a second call for weak rows only."""
    made = preferences.build_preferences(fx.sft(spark, sf), preferences.ByModel(echo), cfg=fx.ANSWERS)
    return made.select("sft_index", "degradation_strategy", "rejected", r6("quality_difference").alias("quality_difference"))


# ---- training text --------------------------------------------------------------------------


@query
def chat_sft(spark, sf):
    return training.chat_sft(fx.chat(spark, sf), keep=("conv_id", "turn"))


@query
def chat_dpo(spark, sf):
    return training.chat_dpo(fx.preferences(spark, sf), keep=("sft_index",))


@query
def incomplete_rows(spark, sf):
    return training.flag_incomplete(fx.sft(spark, sf)).select("sft_index", "incomplete")


@query
def split_exact(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang")
    return training.split_exact(docs, "doc_id")


@query
def split_grouped(spark, sf):
    """No prompt on both sides, every topic and difficulty with its share on each."""
    rows = fx.sft(spark, sf).withColumn("prompt", prompts.prompt_text("instruction", "input"))
    return training.split_grouped(rows, ["prompt"], ["topic", "difficulty"]).select("sft_index", "split")


@query
def split_bucket(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang")
    return training.split_bucket(docs, "doc_id")


@query
def token_budget(spark, sf):
    rows = training.token_budget(fx.documents(spark, sf))
    return rows.select("doc_id", F.array_join("tokens", " ").alias("tokens"), F.size("labels").alias("n_labels"), "truncated")


@query
def truncation_share(spark, sf):
    return rounded(training.truncation_share(training.token_budget(fx.documents(spark, sf))), "avg_tokens")


def piece_ids():
    """A tokenizer for the model hook: piece ids of each text."""
    import sentencepiece

    tokenizer = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    return lambda requests: tokenizer.encode([r["text"] or "" for r in requests])


@query
def token_ids(spark, sf):
    """The first ids of every chat text by a real tokenizer, asked once and kept."""
    rows = fx.chat(spark, sf).select(F.concat_ws("-", "conv_id", "turn").alias("chat_id"), "instruction", "input", "output")
    texts = training.chat_sft(rows, keep=("chat_id",))
    answers = hook.answer_all(texts, "chat_id", ["text"], piece_ids, "array<int>", fresh_dir(spark, "ids"))
    kept = training.budget_ids(answers.withColumnRenamed("result", "ids"), "ids")
    return kept.select("chat_id", "input_ids", "labels", "truncated")


@query
def masked_accuracy(spark, sf):
    return rounded(training.masked_accuracy(fx.token_rows(spark, sf), "predictions", "labels", shift=(0, 1)), "accuracy")


@query
def argmax_labels(spark, sf):
    vectors = fx.table(spark, sf, "embeddings")
    return vectors.select("vec_id", training.argmax("embedding").alias("best"))


@query
def near_vectors(spark, sf):
    """Groups of near copies among all vectors and a changed copy of each: its largest
    coordinate set to zero."""
    return vectors.near_vectors(fx.copied_vectors(spark, sf), NEAR)


# ---- evaluation ---------------------------------------------------------------------------


@query
def judge_totals(spark, sf):
    parsed = judging.parse_judge(fx.verdicts(spark, sf))
    return parsed.select("id", "valid", "first_total", "second_total", "summary")


@query
def judge_summary(spark, sf):
    return rounded(judging.judge_summary(judging.parse_judge(fx.verdicts(spark, sf))), "mean_points")


@query
def judge_outcomes(spark, sf):
    return judging.judge_outcomes(judging.parse_judge(fx.verdicts(spark, sf)))


@query
def judge_intervals(spark, sf):
    found = judging.judge_intervals(judging.parse_judge(fx.verdicts(spark, sf)))
    return rounded(found, "estimate", "lower", "upper")


@query
def judge_prompts(spark, sf):
    pref = fx.preferences(spark, sf)
    return pref.select("sft_index", prompts.judge_prompt("prompt", "chosen", "rejected").alias("judge_prompt"))


@query
def eval_results(spark, sf):
    """Every document as an item; only labelled ones were answered, toxic ones failed."""
    items = fx.sft(spark, sf).select(F.col("sft_index").alias("id"), F.col("instruction").alias("prompt"), "input")
    failed = fx.table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "out of memory").alias("error")
    )
    answers = fx.verdicts(spark, sf).join(failed, "id").select(
        "id", F.lit("first").alias("sft_response"), F.lit("second").alias("dpo_response"), "verdict", "error"
    )
    rows = judging.eval_results(items, answers)
    return rows.select(
        "id", "prompt", "sft_response", "dpo_response", F.col("judge_result.error").alias("error"), "sft_total", "dpo_total"
    )


@query
def inference_prompts(spark, sf):
    items = fx.sft(spark, sf)
    return items.select("sft_index", prompts.chat_prompt(prompts.eval_prompt("instruction", "input")).alias("prompt"))


@query
def eval_size_check(spark, sf):
    return profiling.warn_small(fx.table(spark, sf, "benchmark"), fixed.MIN_EVAL_ROWS)


# ---- tutoring --------------------------------------------------------------------------------


@query
def request_prompts(spark, sf):
    rows = tutor.request_prompts(fx.requests(spark, sf))
    return rows.select("request_id", "command", "agent", "temperature", "system", "user")


@query
def level_difficulty(spark, sf):
    rows = fx.requests(spark, sf).select("current_level", tutoring.level_to_difficulty("current_level").alias("difficulty"))
    return rows.groupBy("current_level", "difficulty").agg(F.count("*").alias("n"))


@query
def assessment_outcome(spark, sf):
    events = fx.assessments(fx.table(spark, sf, "events"))
    return events.select("event_id", tutoring.assessment_outcome("assessment").alias("outcome"))


@query
def error_answers(spark, sf):
    """What a failed request says, with an empty name where no agent would have taken it."""
    rows = tutor.request_prompts(fx.requests(spark, sf))
    return rows.select("request_id", tutoring.error_answer("agent", "target").alias("answer"))


@query
def tutor_answers(spark, sf):
    """Every request sent with its agent's temperature, many at a time."""
    rows = tutor.request_prompts(fx.requests(spark, sf))
    answered = respond(
        rows, "system", "user", echo_with_settings, settings={"temperature": "temperature"}, batch=True
    )
    return answered.select("request_id", "response", "error")


def _listed(profile: DataFrame) -> DataFrame:
    return profile.withColumns(
        {c: F.array_join(c, ",") for c in ("mastered_topics", "weak_topics")}
    )


@query
def student_profiles(spark, sf):
    return _listed(tutor.student_profiles(fx.assessments(fx.table(spark, sf, "events"))))


@query
def student_profiles_parts(spark, sf):
    """The same in parts of a few entries."""
    return _listed(tutor.student_profiles(fx.assessments(fx.table(spark, sf, "events")), block=PART))


@query
def student_progress(spark, sf):
    return tutor.student_progress(fx.assessments(fx.table(spark, sf, "events")))


# ---- streams -----------------------------------------------------------------------------------


def _arriving(spark, sf, name, spread_by):
    """The table as a stream of files, spread like the table itself. The table may be one
    file or a folder of them; a stream takes a single file only by a pattern."""
    static = spark.read.parquet(f"{sf}/{name}.parquet")
    files_ = spark.readStream.schema(static.schema).parquet(f"{sf}/{name}.parque[t]")
    return fx.spread(files_, spread_by)


@query
def stream_scores(spark, sf):
    out = fresh_dir(spark, "scores")
    pairs = fx.as_pairs(_arriving(spark, sf, "documents", "doc_id"))
    scores.stream_scores(pairs, f"{out}/rows", f"{out}/progress", fx.SCORING).awaitTermination()
    written = spark.read.schema(scores.scored_stream(pairs, fx.SCORING).schema).parquet(f"{out}/rows")
    return rounded(written, *pairing.SCORES)


@query
def stream_profiles(spark, sf):
    """Events logged as they arrive; the profiles are read from the log."""
    out = fresh_dir(spark, "profiles")
    events = fx.assessments(_arriving(spark, sf, "events", "event_id"))
    profiles.stream_assessments(events, f"{out}/log", f"{out}/progress").awaitTermination()
    log = spark.read.schema(events.schema).parquet(f"{out}/log")
    return _listed(tutor.student_profiles(log))


@query
def stream_lists(spark, sf):
    """Topic lists kept as state: events arrive in four deliveries, some of them one late,
    and every delivery is a new run from the checkpoint. A tick closes what is open."""
    out = fresh_dir(spark, "lists")
    events = fx.timed_assessments(fx.table(spark, sf, "events"))
    schema = events.drop("delivery").schema
    for k in range(fx.DELIVERIES + 1):
        events.filter(F.col("delivery") == k).drop("delivery").write.mode("append").parquet(f"{out}/in")
        arriving = spark.readStream.schema(schema).parquet(f"{out}/in")
        lists.stream_lists(arriving, f"{out}/rows", f"{out}/progress", fx.LATE).awaitTermination()
    return _listed(lists.read_lists(spark, f"{out}/rows"))


@query
def stream_joined_scores(spark, sf):
    """Both sides of the pairs arrive apart, in several deliveries and as many runs; toxic
    documents never get a preference side."""
    out = fresh_dir(spark, "joined")
    left, right, delay = fx.timed_sides(spark, sf)
    for k in range(fx.DELIVERIES):
        sides = []
        for name, df in (("sft", left), ("preference", right)):
            df.filter(F.col("delivery") == k).drop("delivery").write.mode("append").parquet(f"{out}/{name}")
            sides.append(spark.readStream.schema(df.drop("delivery").schema).parquet(f"{out}/{name}"))
        scores.stream_joined_scores(*sides, f"{out}/rows", f"{out}/progress", delay, cfg=fx.SCORING).awaitTermination()
    return rounded(spark.read.parquet(f"{out}/rows"), *pairing.SCORES)


@query
def stream_progress(spark, sf):
    out = fresh_dir(spark, "progress")
    events = fx.assessments(_arriving(spark, sf, "events", "event_id"))
    profiles.stream_profiles(events, f"{out}/rows", f"{out}/progress").awaitTermination()
    return profiles.read_progress(spark, f"{out}/rows")
