"""Headline queries: median of three runs after one warm-up, as one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pairloom.plans.queries import QUERIES
from pairloom.session import build_session

HEADLINE = [
    "curated_topk", "curated_topk_gated", "topk_per_topic", "ranked_pairs", "score_parts",
    "gate_flags", "resume_by_key", "length_profile", "topic_distribution", "diff_histogram",
    "profile_grouping_sets", "template_rows", "fallback_answers", "degraded_answers",
    "answer_quality", "weak_pairs", "preference_rows", "chat_sft", "chat_dpo", "split_exact",
    "token_budget", "masked_accuracy", "judge_summary", "request_prompts", "student_profiles",
    "responder_echo", "stream_scores", "stream_profiles", "score_parts_default", "answer_quality_default",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            # The given tables are files of one row group, which one task would scan.
            "spark.pairloom.spread": "16",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        run(name)
        times[name] = round(statistics.median(run(name) for _ in range(RUNS)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
