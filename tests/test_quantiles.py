import numpy as np
import pytest
from pyspark.sql import functions as F

from queuelens.operators.quantiles import approx_quantiles, exact_quantiles, grouped_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.995, 1.0]


def _frame(spark, values, group=None):
    rows = [(None if v is None else float(v), g) for v, g in zip(values, group or ["g"] * len(values))]
    return spark.createDataFrame(rows, "v double, g string")


@pytest.mark.parametrize(
    "values",
    [
        [5.0],
        [1.0, 2.0],
        [0.0] * 50,
        [-3.5, -3.5, 0.0, 1e-9, 2e-9, 7.0, 1e12],
        list(np.random.default_rng(1).lognormal(0, 3, 500)),
        list(-np.random.default_rng(2).exponential(1e-4, 400)) + [0.0] * 100,
        list(np.random.default_rng(3).integers(0, 5, 300).astype(float)),
    ],
)
def test_equals_numpy(spark, values):
    got = exact_quantiles(_frame(spark, values), {"v": PROBS}).first()["v"]
    assert got == pytest.approx(np.quantile(values, PROBS), rel=1e-12, abs=0)


def test_leaves_out_missing_and_infinite(spark):
    df = _frame(spark, [1.0, None, 3.0, float("inf"), float("-inf"), float("nan"), 2.0])
    row = exact_quantiles(df, {"v": [0.5]}, counts_as="found").first()
    assert row["v"] == [2.0] and row["found"] == [3]


def test_hot_group_null_group_and_small_groups(spark):
    rng = np.random.default_rng(4)
    group = ["hot"] * 3000 + [None] * 50 + [f"g{i}" for i in range(100)]
    values = list(rng.normal(0, 1, 3000)) + list(rng.normal(5, 1, 50)) + list(rng.normal(0, 9, 100))
    got = {r["g"]: r["v"] for r in exact_quantiles(_frame(spark, values, group), {"v": PROBS}, ["g"]).collect()}
    assert len(got) == 102
    for key in ("hot", None, "g7"):
        expected = np.quantile([v for v, g in zip(values, group) if g == key], PROBS)
        assert got[key] == pytest.approx(expected, rel=1e-12)


def test_many_columns_different_probabilities(spark):
    df = spark.range(1, 102).select(F.col("id").cast("double").alias("a"), (F.col("id") * -2).alias("b"), F.lit(None).cast("double").alias("c"))
    row = exact_quantiles(df, {"a": [0.5], "b": [0.0, 1.0, 0.25], "c": [0.5]}).first()
    assert row["a"] == [51.0] and row["b"] == [-202.0, -2.0, -152.0] and row["c"] == [None]


def test_weight_counts_as_repeated_rows(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 1), (10.0, 4)], "v double, w bigint")
    expected = np.quantile([1.0] * 5 + [2.0] + [10.0] * 4, PROBS)
    assert exact_quantiles(df, {"v": PROBS}, weight="w").first()["v"] == pytest.approx(expected)


def test_no_group_is_broadcast_and_counts_share_an_exchange(spark):
    df = spark.range(1000).select((F.col("id") % 97).alias("v"), (F.col("id") % 3).alias("g"))
    grouped = exact_quantiles(df, {"v": [0.5]}, ["g"])
    grouped.collect()
    assert "ReusedExchange" in grouped._jdf.queryExecution().executedPlan().toString()


def test_approx_has_the_same_shape(spark):
    df = spark.range(1, 1001).select(F.col("id").alias("v"))
    assert approx_quantiles(df, {"v": [0.5, 0.9]}).first()["v"] == pytest.approx([500, 900], abs=2)


@pytest.mark.parametrize("limit", [0, 60, 10**6])
def test_grouped_paths_agree(spark, limit):
    rng = np.random.default_rng(5)
    group = ["hot"] * 500 + [None] * 80 + [f"g{i % 20}" for i in range(100)] + ["empty", "gap", "gap"]
    values = list(rng.lognormal(0, 2, 680)) + [None, float("nan"), 4.0]
    df = _frame(spark, values, group)
    got = {r["g"]: r["v"] for r in grouped_quantiles(df, {"v": PROBS}, ["g"], limit).collect()}
    assert set(got) == set(group)
    for key in ("hot", None, "g3"):
        expected = np.quantile([v for v, g in zip(values, group) if g == key], PROBS)
        assert got[key] == pytest.approx(expected, rel=1e-12)
    assert got["gap"] == [4.0] * len(PROBS)
    assert got["empty"] == [None] * len(PROBS)


def test_rows_are_read_once_for_the_buckets_and_once_for_the_values_inside(spark, tmp_path):
    values = np.random.default_rng(8).lognormal(0, 2, 2000)
    _frame(spark, values).write.parquet(str(tmp_path / "rows"))
    found = exact_quantiles(spark.read.parquet(str(tmp_path / "rows")), {"v": PROBS})
    assert found.first()["v"] == pytest.approx(np.quantile(values, PROBS), rel=1e-12, abs=0)
    found.collect()  # the plan that ran is this frame's own
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 2
