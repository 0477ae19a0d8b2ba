"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 4) set the scale. Every
DataFrame is run to its end with Spark's no-op sink, so all its columns are computed. One untimed
round over the smallest tables beside them lets the JVM compile what a long-lived session has
compiled; nothing it computes is reused. BENCH_WARM_UP=0 leaves it out.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from queuelens.plans import features, scoring, training  # noqa: E402
from queuelens.registry import QUERIES, catalog  # noqa: E402
from queuelens.session import build_session  # noqa: E402

HEADLINE = [
    "clean_jobs", "clean_funnel", "user_stats", "queue_stats", "temporal_split", "sample_n", "join_user_stats",
    "transform", "feature_stats", "user_history", "queue_history", "active_connections", "rate_by_method",
    "latency_quantiles", "regression_metrics", "error_percentiles", "batch_summary", "profile_schema", "quality_report",
    "reuse_ratio", "stream_request_rate",
]


def run(spark, sf: str) -> tuple[int, dict[str, float]]:
    times: dict[str, float] = {}

    def clock(name, make):
        start = time.perf_counter()
        result = make()
        if hasattr(result, "write"):
            result.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        return result

    # Whole stages first: each builds on the stored result of the one before.
    jobs = clock("store_job_log", lambda: catalog.jobs(spark, sf))
    rows = jobs.count()
    table = clock("clean_and_split", lambda: catalog.split_table(spark, sf))
    state = clock("fit_features", lambda: catalog.state(spark, sf))
    train = table.where(F.col("split") == "train")
    clock("transform_train", lambda: features.transform(train, state).select("job_id", *state.features))
    trained = clock("train_ensemble", lambda: catalog.trained(spark, sf))
    clock("evaluate_test", lambda: training.evaluate_test(table, trained))
    requests = catalog.service_requests(spark, sf)
    clock("score_batch", lambda: scoring.score_batch(requests, trained).select("request_id", *scoring.OUTPUTS))
    for name in HEADLINE:
        clock(name, lambda: QUERIES[name](spark, sf))
    return rows, times


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    warm_up = os.environ.get("BENCH_WARM_UP", "1") != "0" and os.path.isdir(small)
    if warm_up:
        run(spark, small)
        catalog.forget_fitted()
    rows, times = run(spark, sf)
    print(
        json.dumps(
            {
                "metric": "total wall time of headline job-log queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
                "rows": rows,
                "warm_up": warm_up,
                "rows_per_sec": {k: round(rows / times[k]) for k in ("clean_and_split", "fit_features", "transform_train", "score_batch")},
            }
        )
    )


if __name__ == "__main__":
    main()
