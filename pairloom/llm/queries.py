"""The registered queries of this folder: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.llm.chat_format import format_conversations, read_back
from pairloom.llm.decontamination import benchmark_hits, is_contaminated, items_digest
from pairloom.llm.exact_dedup import duplicate_groups
from pairloom.llm.jaccard_join import near_duplicates
from pairloom.llm.language_id import held_out, identify_languages, train_prototypes
from pairloom.llm.lexical_search import ranked_search
from pairloom.llm.line_dedup import dedup_lines
from pairloom.llm.pii import KINDS, count_of, find_personal_data, span_text
from pairloom.llm.prefix_trie import prefix_trie, turn_digest
from pairloom.llm.quality import score_documents, train
from pairloom.llm.run_length_index import remove_repeated_bytes
from pairloom.llm.segmentation import sample_segmentations
from pairloom.llm.substring_dedup import remove_repeated_runs
from pairloom.llm.tables import stored, table
from pairloom.operators.indexing import with_group_index

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("runs").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "row.doc_id",
        *[count_of(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.concat("base", "found")).alias("spans"),
        F.size("found").cast("long").alias("n_found"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("row.doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = benchmark_hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        items_digest().alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents"), keep="largest")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    prototypes = train_prototypes(docs.filter(~held_out()))
    found = identify_languages(docs.select("doc_id", "text"), prototypes)
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def op8_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str = MODEL) -> DataFrame:
    """Every sample's piece ids, and what they decode to. A document with null text has one
    row without a sample."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = sample_segmentations(docs, model_file, k=SAMPLES, decoded=True)
    one = drawn.select("row.doc_id", F.posexplode_outer("samples").alias("sample", "s"))
    return one.select(
        "doc_id",
        "sample",
        F.when(F.col("s").isNotNull(), F.size("s.ids").cast("long")).alias("n_pieces"),
        "s.ids",
        "s.log_prob",
        "s.gumbel",
        "s.inclusion",
        "s.decoded_sha256",
        "s.round_trip",
    )


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 5 == 0
    weights = train(docs, table(spark, sf_dir, "labels"), ~fold("doc_id"))
    return score_documents(docs, weights).select(
        "row.doc_id",
        F.coalesce(fold("row.doc_id"), F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one more that consists of control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-1).cast(rows.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"),
    )
    return read_back(stored(format_conversations(rows.unionByName(extra)), "chat"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


HEAD, SPAN = 9, 64


def rebuilt_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, pos, digest, n_bytes, last`` of the turns, and ``conv_id, length`` of all
    conversations, after each took its first h turns from conversation c - c % 5, with
    h = crc32(c) % 9.

    Turns are ordered by ``turn`` (null first), equal ones by the digest of role and text.
    Rows without ``conv_id`` belong to no conversation.
    """
    own = rows.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint"), "turn", turn_digest(F.col("role"), F.col("text")).alias("digest"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")
    )
    turns = stored(with_group_index(own, ["conv_id"], "turn", "digest", name="pos").drop("turn"), "turns")
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD
    convs = convs.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % 5})
    heads = turns.filter((F.col("pos") < HEAD - 1) & (F.col("conv_id") % 5 == 0)).withColumnRenamed("conv_id", "base")
    n_heads = heads.groupBy("base").agg(F.count(F.lit(1)).alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = convs.join(n_heads, "base", "left").withColumn("taken", taken)
    convs = stored(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "convs")
    last = (F.col("pos") == F.col("length") - 1).alias("last")
    columns = ["conv_id", "pos", "digest", "n_bytes", last]
    first = convs.join(heads, "base").filter(F.col("pos") < F.col("taken")).select(*columns)
    # A long conversation meets its row in stretches, so no key has more than SPAN turns.
    stretch = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n") / SPAN))).alias("stretch")
    keyed = turns.withColumn("stretch", F.floor(F.col("pos") / SPAN))
    rest = keyed.join(convs.select("conv_id", "h", "taken", "length", stretch), ["conv_id", "stretch"]).filter(F.col("pos") >= F.col("h"))
    rest = rest.withColumn("pos", F.col("pos") - F.col("h") + F.col("taken")).select(*columns)
    return stored(first.unionByName(rest), "rebuilt"), convs.select("conv_id", "length")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt_conversations(table(spark, sf_dir, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_pii,
        op3_line_dedup,
        op4_decontamination,
        op5_jaccard_join,
        op6_exact_dedup,
        op7_language_id,
        op8_sentencepiece,
        op9_quality_classifier,
        op10_substring_dedup,
        op11_chat_formatting,
        op12_lexical_search,
        op13_prefix_trie,
    )
}
