from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from queuelens.operators import filters, joins, sketches
from queuelens.plans import training

PROBS = [0.01, 0.5, 0.95, 0.99]


@pytest.mark.parametrize("n", [1, 300, 40_000, 400_000])
def test_merged_quantiles_keep_their_rank(spark, n):
    rng = np.random.default_rng(n)
    values = np.where(rng.random(n) < 0.4, 7.0, rng.lognormal(0, 3, n))  # two fifths of the rows are one value
    rows = spark.createDataFrame([(float(v), i % 50, i % 2) for i, v in enumerate(values)], "v double, slice int, g int")
    parts = sketches.quantile_sketches(rows, "v", ["g", "slice"])
    found = sketches.merged_quantiles(parts, PROBS, ["g"])
    off = sketches.rank_check(rows, "v", found, ["g"]).collect()
    assert len(off) == min(n, 2) * len(PROBS)
    assert max(r.off for r in off) <= 2 * sketches.rank_error()
    whole = sketches.merged_quantiles(parts, [0.5]).first()
    assert whole.n == n


def test_quantile_sketches_leave_out_what_exact_quantiles_do(spark):
    rows = spark.createDataFrame([(1.0, "a"), (None, "a"), (float("nan"), "a"), (float("inf"), "a"), (None, "b")], "v double, g string")
    found = sketches.merged_quantiles(sketches.quantile_sketches(rows, "v", ["g"]), [0.5], ["g"]).collect()
    assert [(r.g, r.value, r.n) for r in found] == [("a", 1.0, 1)]
    empty = sketches.quantile_sketches(rows.limit(0), "v", ["g"])
    assert sketches.merged_quantiles(empty, [0.5]).count() == 0


def test_profile_from_sketches(spark):
    n = 20_000
    texts = {"id": lambda i: f"x{i}", "rare": lambda i: f"r{i % 9}", "under": lambda i: f"u{i % (n // 2 - 1)}", "half": lambda i: f"h{i % (n // 2)}"}
    rows = [(i % 30, i - 5, float(i), None, *[f(i) for f in texts.values()]) for i in range(n)]
    df = spark.createDataFrame(rows, "day int, whole bigint, part double, none string, " + ", ".join(f"{c} string" for c in texts))
    days = sketches.column_sketches(df, ["day"])
    assert "Expand" not in days._jdf.queryExecution().executedPlan().toString()
    found = {r["column"]: r for r in sketches.profile_from_sketches(df, days).collect()}
    exact = {r["column"]: r for r in filters.profile_schema(df).collect()}
    assert {c: (r.min_value, r.max_value, r.suggested) for c, r in found.items()} == {
        c: (r.min_value, r.max_value, r.suggested) for c, r in exact.items()
    }
    # One value less than half of the rows decides; the sketch alone couldn't, so the column is counted.
    assert found["under"].suggested == "category" and found["half"].suggested == "string"
    assert found["under"].distinct_estimate == n // 2 - 1
    assert found["id"].distinct_estimate == pytest.approx(n, rel=6 * sketches.distinct_error())
    none = sketches.profile_from_sketches(df.limit(0), sketches.column_sketches(df.limit(0), ["day"]))
    assert none.count() == 0


def skewed(spark, n=80_000):
    key = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.concat(F.lit("u"), F.col("id") % 4001))
    return spark.range(n).select(F.col("id").alias("job_id"), key.alias("user"), (F.col("id") % 12).alias("day"))


def test_heavy_keys(spark):
    df = skewed(spark)
    known = df.where("user is not null").count()
    found = sketches.heavy_keys(sketches.frequent_sketches(df, "user", ["day"]), "user", 0.01).collect()
    assert [r["user"] for r in found] == ["hot"]
    assert found[0].share == pytest.approx(40_000 / known, abs=sketches.count_error())
    assert sketches.heavy_keys(sketches.frequent_sketches(df.limit(0), "user"), "user").count() == 0
    with pytest.raises(ValueError):
        sketches.heavy_keys(sketches.frequent_sketches(df, "user"), "user", share=1e-5)


def rows_per_task(joined):
    # The looked-up column is read too; Spark would leave out a lookup that nothing uses.
    at = joined.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.max("jobs"))
    return [r.n for r in at.collect()]


def test_salted_lookup(spark):
    df = skewed(spark)
    table = df.where("user is not null and user != 'u7'").groupBy("user").agg(F.count("*").alias("jobs"))
    heavy = sketches.heavy_keys(sketches.frequent_sketches(df, "user"), "user")
    wrong = spark.createDataFrame([("nobody", 0.9), ("u8", 1e-9), ("u8", 0.5)], "user string, share double")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(kept, ("false", "-1")):
            spark.conf.set(k, v)
        joined = joins.salted_lookup(df, table, "user", heavy, ["job_id"])
        per_task, plain = rows_per_task(joined), rows_per_task(df.join(table, "user", "left"))
        assert joined.columns == ["job_id", "user", "day", "jobs"]
        assert len(per_task) == 8 and max(per_task) <= 2 * np.median(per_task) < max(plain)
        expected = sorted(df.join(table, "user", "left").select(joined.columns).collect(), key=lambda r: r.job_id)
        assert sorted(joined.collect(), key=lambda r: r.job_id) == expected
        assert sorted(joins.salted_lookup(df, table, "user", wrong, ["job_id"]).collect(), key=lambda r: r.job_id) == expected
        assert joins.salted_lookup(df, table, "user", heavy.limit(0), ["job_id"]).where("jobs is null").count() == df.where("user is null or user = 'u7'").count()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_funnel_of_the_pass_that_writes(spark, job_rows):
    at = [datetime(2024, 1, 1, h, tzinfo=timezone.utc) for h in range(10)]
    rows = [{"submit_time": t} for t in at] + [{"run_time": 0}, {"run_time": 5}, {"nodes_req": 0}, {"state": "FAILED"}]
    jobs = job_rows(*rows)
    table, funnel = training.training_table_and_funnel(jobs)
    assert table.count() == 10
    left = [r["rows_kept"] for r in funnel.orderBy("position").collect()]
    assert left == [14, 13, 12, 11, 11, 10]
    assert sorted(funnel.collect()) == sorted(filters.clean_funnel(jobs).collect())


def test_funnel_without_rows(spark, job_rows, tmp_path):
    job_rows({}).where("job_id < 0").write.parquet(str(tmp_path / "none"))
    for empty in (job_rows({}).where("job_id < 0"), spark.read.parquet(str(tmp_path / "none"))):
        table, funnel = training.training_table_and_funnel(empty)
        assert table.count() == 0 and {r["rows_kept"] for r in funnel.collect()} == {0}
    jobs = job_rows({"nodes_req": 0}, {"mem_req": float("nan")}, {"run_time": None})
    table, funnel = training.training_table_and_funnel(jobs)
    assert table.count() == 0
    assert sorted(funnel.collect()) == sorted(filters.clean_funnel(jobs).collect())
