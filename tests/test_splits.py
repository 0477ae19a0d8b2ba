from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from queuelens.operators.ranks import keys_at_ranks
from queuelens.operators.splits import flat_cuts, nested_cuts, sample_n, temporal_split

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def _jobs(spark, rows):
    return spark.createDataFrame(rows, "job_id bigint, submit_time timestamp")


def _labels(df):
    return {r["job_id"]: r["split"] for r in df.collect()}


def _expected(rows, cuts):
    ordered = [j for j, t in sorted(rows, key=lambda r: (r[1] is None, r[1] or T0, r[0]))]
    a, b = cuts(len(ordered))
    return {j: "train" if i < a else "val" if i < b else "test" for i, j in enumerate(ordered)}


@pytest.mark.parametrize("cuts", [nested_cuts(), flat_cuts()])
def test_split_with_ties_gaps_and_missing_times(spark, cuts):
    rows = [(i, T0 + timedelta(seconds=(i * 7919) % 50, hours=i % 3)) for i in range(400)] + [(1000 + i, None) for i in range(30)]
    assert _labels(temporal_split(_jobs(spark, rows), cuts)) == _expected(rows, cuts)


def test_split_when_every_job_has_the_same_time(spark):
    rows = [((i * 37) % 500, T0) for i in range(500)]
    assert _labels(temporal_split(_jobs(spark, rows))) == _expected(rows, nested_cuts())


def test_one_row_and_no_rows(spark):
    assert _labels(temporal_split(_jobs(spark, [(1, T0)]))) == {1: "test"}
    assert temporal_split(_jobs(spark, [])).count() == 0


@pytest.mark.parametrize("small", [1, 10, 10_000])
def test_refinement_finds_the_same_keys(spark, small):
    df = spark.range(2000).select(F.pmod(F.col("id") * 7919, F.lit(500)).alias("a"), F.col("id").alias("b"))
    levels = [F.floor(F.col("a") / 100), F.floor(F.col("a") / 10), F.col("a"), F.shiftright("b", 8), F.col("b")]
    ordered = sorted((r["a"], r["b"]) for r in df.collect())
    ranks = [0, 1, 777, 1999, 2000]
    total, keys = keys_at_ranks(df, levels, [F.col("a"), F.col("b")], lambda n: ranks, small)
    assert total == 2000
    assert keys == [ordered[r] if r < 2000 else None for r in ranks]


def test_split_plan_has_no_shuffle(spark):
    rows = [(i, T0 + timedelta(minutes=i)) for i in range(100)]
    plan = temporal_split(_jobs(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_sample_is_exact_repeatable_and_seeded(spark):
    df = spark.range(5000).withColumnRenamed("id", "job_id")
    first = {r["job_id"] for r in sample_n(df, 321).collect()}
    assert len(first) == 321
    assert first == {r["job_id"] for r in sample_n(df.repartition(5), 321).collect()}
    assert first != {r["job_id"] for r in sample_n(df, 321, seed=7).collect()}
    assert sample_n(df, 9999).count() == 5000
    assert sample_n(df, 0).count() == 0
