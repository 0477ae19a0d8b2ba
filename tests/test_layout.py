import numpy as np
from pyspark.sql import functions as F

from queuelens.operators import sketches
from queuelens.sources import layout
from tests.test_sketches import rows_per_task, skewed


def rows_read(df):
    """The rows that the scan of `df` handed on, and the result."""
    got = df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return scan.metrics().get("numOutputRows").get().value(), got


def test_a_lookup_skips_most_of_a_clustered_log(spark, tmp_path):
    n = 120_000
    hashed = F.xxhash64("id")
    log = spark.range(n).select(
        hashed.alias("job_id"),
        F.concat(F.lit("u"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(400))).alias("user"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("id", F.lit(2)), F.lit(4 * 86_400))).alias("submit_time"),
    )
    path = layout.clustered_parquet(log, str(tmp_path / "clustered"), 40, distinct=4_000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stored = spark.read.parquet(path)
        assert len(stored.inputFiles()) == 40
        read, got = rows_read(stored.where("user = 'u17'"))
        assert sorted(got) == sorted(log.where("user = 'u17'").collect())
        assert read <= n * 10 // 40  # a file or two for each of the five days that are touched
        ids = [r.job_id for r in log.limit(5).collect()]
        for one in ids:
            read, got = rows_read(stored.where(F.col("job_id") == one))
            assert [r.job_id for r in got] == [one] and read <= n * 4 // 40
        day = stored.where("submit_time < timestamp_seconds(1700006400)")
        read, got = rows_read(day)
        assert len(got) == log.where("submit_time < timestamp_seconds(1700006400)").count() and read <= n * 5 // 40
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    none = layout.clustered_parquet(log.limit(0), str(tmp_path / "none"), 4)
    assert spark.read.schema(log.schema).parquet(none).count() == 0


def test_a_colocated_lookup_moves_no_row(spark):
    df = skewed(spark)
    table = df.where("user is not null and user != 'u7'").groupBy("user").agg(F.count("*").alias("jobs"))
    heavy = sketches.heavy_keys(sketches.frequent_sketches(df, "user"), "user")
    log, known = layout.colocated(df, table, "user", heavy, ["job_id"], 8)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(kept, ("false", "-1")):
            spark.conf.set(k, v)
        joined = layout.colocated_lookup(log, known, "user")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        per_task = rows_per_task(joined)
        assert len(per_task) == 8 and max(per_task) <= 2 * np.median(per_task)
        expected = df.join(table, "user", "left").select(joined.columns)
        assert sorted(joined.collect(), key=lambda r: r.job_id) == sorted(expected.collect(), key=lambda r: r.job_id)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
