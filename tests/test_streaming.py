from __future__ import annotations

from pairloom.operators import pairing
from pairloom.plans import fixtures as fx
from pairloom.streaming import scores


def test_scores_of_two_deliveries_equal_the_batch(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    src, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for part in ("lang = 'en'", "lang <> 'en'"):
        docs.filter(part).coalesce(2).write.mode("append").parquet(src)
        arriving = fx.as_pairs(spark.readStream.schema(docs.schema).parquet(src))
        for _ in range(2):
            scores.stream_scores(arriving, out, progress, fx.SCORING).awaitTermination()
    batch = pairing.score_pairs(fx.as_sft(docs), fx.as_preference(docs), fx.SCORING)
    streamed = spark.read.parquet(out).select(batch.columns)
    assert streamed.count() == docs.count()
    assert set(streamed.collect()) == set(batch.collect())
    assert set(scores.scored_stream(fx.as_pairs(docs), fx.SCORING).collect()) == set(batch.collect())
