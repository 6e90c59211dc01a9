"""A training corpus from raw documents: language, repeated lines, near duplicates, benchmark
passages, and sampled segmentations of what is left.

Every stage takes all rows its predecessor kept, as a written table. All but the last return
the columns of ``documents``, with ``text`` and ``n_chars`` as the stage leaves them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.llm.decontamination import remove_benchmark
from pairloom.llm.jaccard_join import near_duplicates
from pairloom.llm.language_id import held_out, identify_languages, reaches, score_floors, train_prototypes
from pairloom.llm.line_dedup import dedup_lines
from pairloom.llm.queries import MODEL, SAMPLES
from pairloom.llm.segmentation import sample_segmentations
from pairloom.llm.tables import stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go: null texts, texts without a letter, and those whose
    cosine stays far below what the training texts of their length reach. Where no language
    could be learned, every document with a letter stays. Repeated ids are rows of their own."""
    trained = docs.filter(~held_out() & F.col("lang").isNotNull())
    prototypes = train_prototypes(trained)
    if not prototypes:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    floors = score_floors(identify_languages(trained.select("text"), prototypes))
    return identify_languages(docs, prototypes).filter(reaches(floors)).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of three-line windows are cut out; documents of which nothing is left go."""
    cut = dedup_lines(docs).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    text = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("kept_text"))
    changed = {"text": text, "n_chars": F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("kept_text"))}
    return cut.select(*[changed.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest id stays."""
    dropped = near_duplicates(docs).filter("component_id != doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words in benchmark windows go."""
    return remove_benchmark(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Distinct sampled segmentations of each document as piece ids, ready for training."""
    drawn = sample_segmentations(docs.select("doc_id", "lang", "text"), MODEL, k=SAMPLES)
    one = drawn.select("row.doc_id", "row.lang", F.posexplode("samples").alias("sample", "s"))
    return one.select("doc_id", "lang", "sample", "s.ids", "s.log_prob", "s.inclusion")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("segmentation", segmentation),
]

# Learnt prototypes and sampled segmentations cannot be said in SQL; the tests hold the
# pipeline against brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
