"""Views of the given tables in the shape of the datasets, over whole tables and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairloom.config import AnswerConfig, ScoreConfig
from pairloom.functions.scoring import quality_difference
from pairloom.functions.text import or_empty, words

# The given prose is made of invented words, so the queries look for parts of them.
CATEGORIES = (("ing", "able"), ("tion ",), ("ment",), ("ich",), ("wh",), ("eau",))
TERMS = ("tion", "the", "ment", "ing", "ich", "ou", "er", "qu", "and", "wh")
INDICATORS = (". the", ", the", "in the", "eaux", "ung", "able", "of a", "and")

SCORING = ScoreConfig(categories=CATEGORIES)
ANSWERS = AnswerConfig(terms=TERMS, indicators=INDICATORS)

TOPIC_SOURCES = {
    "Mathematics": ("src0", "src1", "src2", "src3"),
    "Computer Science": ("src4", "src5", "src6", "src7"),
    "Physics": ("src8", "src9", "src10", "src11"),
    "Literature": ("src12", "src13", "src14", "src15"),
    "History": ("src16", "src17", "src18"),
}


# Session setting: deal the texts out to this many partitions before the work on them, for
# tables of few, large row groups, which a scan cannot split. Unset, nothing is moved.
SPREAD = "spark.pairloom.spread"


def spread(df: DataFrame, by: str) -> DataFrame:
    """The same on every master and for every size: only the session's setting counts."""
    parts = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(parts), by) if parts else df


def table(spark: SparkSession, sf_dir: str, name: str, spread_by: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, spread_by) if spread_by else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id")


def _topic() -> Column:
    out = F.lit(None).cast("string")
    for topic, sources in TOPIC_SOURCES.items():
        out = F.when(F.col("source").isin(*sources), topic).otherwise(out)
    return out


def _difficulty() -> Column:
    n = F.col("n_chars")
    return F.when(n < 800, "easy").when(n < 1600, "medium").when(n < 4000, "hard")


def _split(docs: DataFrame) -> DataFrame:
    """Cut every text, whole, into first sentence, second sentence (other languages than
    English) and rest."""
    first = F.substring_index("text", ".", 1)
    cut = docs.withColumn("instruction", first).withColumn(
        "_rest", F.expr("substring(text, length(instruction) + 2)")
    )
    cut = cut.withColumn(
        "input", F.when(F.col("lang") != "en", F.substring_index("_rest", ".", 1)).otherwise("")
    )
    skip = F.when(F.col("input") != "", F.length("input") + 2).otherwise(1)
    return cut.withColumn("output", F.substring(F.col("_rest"), skip, F.length("_rest")))


def _sft_columns() -> list[Column]:
    return [F.col("instruction"), F.col("input"), F.col("output"), _topic().alias("topic"), _difficulty().alias("difficulty")]


def _with_rejected(cut: DataFrame) -> DataFrame:
    """The rejected answer is the first sentence (English) or what follows the first line
    (other languages, empty for a single line)."""
    after_line = F.when(
        F.contains("output", F.lit("\n")), F.expr("substring(output, instr(output, '\\n') + 1)")
    ).otherwise("")
    rejected = F.when(F.col("lang") == "en", F.substring_index("output", ".", 1)).otherwise(after_line)
    cut = cut.withColumn("rejected", rejected)
    return cut.withColumn("quality_difference", quality_difference("output", "rejected", ANSWERS))


def _preference_columns() -> list[Column]:
    topic = F.when((F.col("lang") == "fr") & (_topic() == "History"), "Physics").otherwise(_topic())
    return [
        F.col("instruction").alias("prompt"),
        F.col("output").alias("chosen"),
        F.col("rejected"),
        topic.alias("topic"),
        _difficulty().alias("difficulty"),
        F.col("quality_difference"),
    ]


def as_sft(docs: DataFrame) -> DataFrame:
    return _split(docs).select(F.col("doc_id").alias("sft_index"), *_sft_columns())


def as_preference(docs: DataFrame) -> DataFrame:
    return _with_rejected(_split(docs)).select(F.col("doc_id").alias("sft_index"), *_preference_columns())


def as_pairs(docs: DataFrame) -> DataFrame:
    """Both sides of each pair in one row; works on a table or a stream of documents."""
    return _with_rejected(_split(docs)).select(
        F.col("doc_id").alias("pair_id"),
        F.struct(*_sft_columns()).alias("sft"),
        F.struct(*_preference_columns()).alias("preference"),
    )


def sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_sft(documents(spark, sf_dir))


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_preference(documents(spark, sf_dir))


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the rows that exist already: the documents that carry a label."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sft_index"))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns followed by an assistant turn; a system text becomes the input.

    The next turn is found by its number, so no task has to hold a whole conversation.
    """
    turns = table(spark, sf_dir, "conversations")
    users = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("instruction"))
    replies = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output")
    )
    systems = turns.filter(F.col("role") == "system").groupBy("conv_id").agg(F.max("text").alias("input"))
    rows = users.join(replies, ["conv_id", "turn"]).join(systems, "conv_id", "left")
    return rows.select("conv_id", "turn", "instruction", or_empty("input").alias("input"), "output")


def assessments(events: DataFrame, *more: Column) -> DataFrame:
    """Assessment events; the value of an event decides the grade. ``more`` columns follow."""
    grade = (
        F.when(F.col("value") >= 30, "Score: 10 points")
        .when(F.col("value") < 5, "Score: below 5 points")
        .otherwise("Score: 7 points")
    )
    return events.select(
        F.col("user_id").alias("student_id"), "event_id", F.col("event_type").alias("topic"), grade.alias("assessment"), *more
    )


# Runs in which the events, and the two sides of the pairs, arrive; how late some of them are.
DELIVERIES = 4
LATE = "2 days"


def timed_assessments(events: DataFrame) -> DataFrame:
    """Assessments with their time and the run in which they arrive: a quarter of the time
    span each, and what purchases of a span's last day say comes one run later. A tick
    without student follows in a last run."""
    at = F.col("ts").cast("timestamp")
    rows = assessments(events, at.alias("ts"))
    first, last = events.agg(F.min(F.unix_micros(at)), F.max(F.unix_micros(at))).first()
    first, last = first or 0, last or 0
    span = F.lit((last - first) // DELIVERIES + 1)
    since = F.unix_micros("ts") - first
    day = 86_400_000_000
    late = (F.col("topic") == "purchase") & (since % span > span - day)
    run = F.least(F.floor(since / span) + late.cast("int"), F.lit(DELIVERIES - 1)).cast("int")
    tick = events.sparkSession.range(1).select(
        F.lit(None).cast("bigint").alias("student_id"),
        F.lit(-1).cast("bigint").alias("event_id"),
        F.timestamp_micros(F.lit(last + 400 * day)).alias("ts"),
        F.lit("").alias("topic"),
        F.lit("").alias("assessment"),
        F.lit(DELIVERIES).alias("delivery"),
    )
    return rows.withColumn("delivery", run).select(tick.columns).unionByName(tick)


def timed_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, str]:
    """Both sides of the pairs with a time and the run in which they arrive, and how late a
    side may be. A preference side lies half an hour after its instruction; the French ones
    arrive a run later, and toxic documents have none. Both end with a tick: a side with a
    negative key far in the future."""
    docs = documents(spark, sf_dir)
    top = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    per_run = top // (DELIVERIES - 2) + 1
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("sft_index"))
    run = F.floor(F.col("sft_index") / per_run).cast("int")
    left = as_sft(docs).withColumns({"ts": at, "delivery": run})
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("sft_index"))
    french = docs.filter("lang = 'fr'").select(F.col("doc_id").alias("sft_index"), F.lit(1).alias("_later"))
    right = as_preference(docs).join(toxic, "sft_index", "left_anti").join(french, "sft_index", "left")
    right = right.withColumns({"ts": at + F.expr("INTERVAL 30 minutes"), "delivery": run + F.coalesce("_later", F.lit(0))}).drop("_later")
    far = F.timestamp_seconds(F.lit(1_700_000_000 + 10 * top + 10**8))

    def tick(df: DataFrame, key: int) -> DataFrame:
        given = {"sft_index": F.lit(key), "ts": far, "delivery": F.lit(DELIVERIES - 1)}
        return spark.range(1).select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema])

    return left.unionByName(tick(left, -1)), right.unionByName(tick(right, -2)), f"{per_run + 3600} seconds"


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's reply per labelled document: plain, fenced, broken, one model missing,
    one model as a string."""
    n = lambda c: F.col(c).cast("string")
    points = lambda a, d, e: F.concat(
        F.lit('{"Accuracy": '), a, F.lit(', "Difficulty_Match": '), d, F.lit(', "Educational_Value": '), e, F.lit("}")
    )
    first = points(n("a1"), n("d1"), n("e1"))
    second = points(n("a2"), n("d2"), n("e2"))
    with_first = lambda x: F.concat(
        F.lit('{"SFT_Model": '), x, F.lit(', "DPO_Model": '), second, F.lit(', "Summary": "done"}')
    )
    kind = F.col("id") % 5
    text = (
        F.when(kind == 0, with_first(first))
        .when(kind == 1, F.concat(F.lit("```json\n"), with_first(first), F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("The first answer is better: "), first))
        .when(kind == 3, F.concat(F.lit('{"DPO_Model": '), second, F.lit(', "Summary": "one side"}')))
        .otherwise(with_first(F.lit('"not rated"')))
    )
    rows = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        (F.col("quality") * 2 + 2).alias("a1"),
        (F.lit(3) - F.col("toxic")).alias("d1"),
        (F.col("doc_id") % 6).alias("e1"),
        (F.col("quality") + 3).alias("a2"),
        (F.lit(4) - F.col("toxic") * 2).alias("d2"),
        (F.col("doc_id") % 4).alias("e2"),
    )
    return rows.select("id", text.alias("verdict"))


def copied_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector, and under the next negative number a copy without its largest
    coordinate, which is more or less near to it."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    cut = F.transform("embedding", lambda x: F.when(x == F.array_max("embedding"), F.lit(0.0).cast("float")).otherwise(x))
    return rows.unionByName(rows.select((-1 - F.col("vec_id")).alias("vec_id"), cut.alias("embedding")))


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lengths of every turn as labels, every fourth ignored; predictions are off by
    one at every seventh word."""
    both = F.transform(
        words("text"),
        lambda w, i: F.struct(
            F.when(i % 4 == 3, -100).otherwise(F.length(w)).alias("label"),
            (F.length(w) + F.when(i % 7 == 6, 1).otherwise(0)).alias("pred"),
        ),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", both.alias("_both"))
    return rows.select("conv_id", "turn", F.col("_both.label").alias("labels"), F.col("_both.pred").alias("predictions"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tutor request per event; one kind of event asks for nothing known."""
    command = F.lit("unknown")
    for kind, name in {"signup": "plan", "view": "material", "purchase": "assess", "click": "explain"}.items():
        command = F.when(F.col("event_type") == kind, name).otherwise(command)
    value = F.col("value")
    level = F.when(value < 10, "beginner").when(value < 20, "intermediate").when(value < 30, "advanced").when(value < 40, "expert")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        command.alias("command"),
        F.col("event_type").alias("subject"),
        F.col("props").alias("target"),
        F.lit("4 weeks").alias("time_available"),
        F.col("props").alias("topic"),
        F.col("props").alias("question"),
        F.col("event_type").alias("student_answer"),
        F.col("props").alias("reference_answer"),
        F.col("event_type").alias("concept"),
        F.when(value >= 15, F.col("props")).otherwise("").alias("confusion_point"),
        level.alias("current_level"),
    )
