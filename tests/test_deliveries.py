from __future__ import annotations

from pairloom.plans import fixtures as fx


def test_deliveries_of_events_need_no_join(spark, sf):
    plan = fx.timed_assessments(spark.read.parquet(f"{sf}/events.parquet"))
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()
