"""Grouped statistics over job logs, feature frames and scored results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from queuelens.functions.resources import at_least_one
from queuelens.operators.quantiles import approx_quantiles, exact_quantiles, grouped_quantiles
from queuelens.operators.scalars import only_row, unpivot_row


def _quantiles(df: DataFrame, columns: dict, by: Sequence[str] = (), mode: str = "exact") -> DataFrame:
    """`mode='approx'` trades exactness (rank error 1e-4) for a single pass."""
    if mode == "approx":
        return approx_quantiles(df, columns, by)
    return grouped_quantiles(df, columns, by) if by else exact_quantiles(df, columns)


def overrequest_ratio() -> Column:
    """How many times the run time a job asked for."""
    return F.col("wallclock_req") / at_least_one(F.col("run_time"))


def user_stats(df: DataFrame, quantile_mode: str = "exact") -> DataFrame:
    """Per user: run-time spread, request averages and medians, mean over-request ratio."""
    known = df.where(F.col("user").isNotNull())
    means = known.groupBy("user").agg(
        F.avg("run_time").alias("runtime_mean"),
        F.stddev_samp("run_time").alias("runtime_std"),
        F.count("run_time").alias("job_count"),
        F.avg("wallclock_req").alias("wallclock_mean"),
        F.avg("processors_req").alias("processors_mean"),
        F.avg("mem_req").alias("mem_mean"),
        F.avg(overrequest_ratio()).alias("accuracy"),
    )
    middle = _quantiles(
        known,
        {c: [0.5] for c in ("run_time", "wallclock_req", "processors_req", "mem_req")},
        ["user"],
        quantile_mode,
    ).select(
        F.col("user"),
        F.col("run_time")[0].alias("runtime_median"),
        F.col("wallclock_req")[0].alias("wallclock_median"),
        F.col("processors_req")[0].alias("processors_median"),
        F.col("mem_req")[0].alias("mem_median"),
    )
    return means.join(middle, "user", "left").na.fill(0)


def user_accuracy(df: DataFrame) -> DataFrame:
    return df.where(F.col("user").isNotNull()).groupBy("user").agg(F.avg(overrequest_ratio()).alias("accuracy"))


def queue_stats(df: DataFrame, quantile_mode: str = "exact") -> DataFrame:
    """Per partition and submission hour: jobs, mean and median run time, processors asked for."""
    keyed = df.where(F.col("partition").isNotNull()).withColumn("submit_hour", F.hour("submit_time"))
    keys = ["partition", "submit_hour"]
    sums = keyed.groupBy(*keys).agg(
        F.count("job_id").alias("job_count"),
        F.avg("run_time").alias("runtime_mean"),
        F.sum(F.col("processors_req").cast("bigint")).alias("processors_sum"),
    )
    middle = _quantiles(keyed, {"run_time": [0.5]}, keys, quantile_mode).select(
        *keys, F.col("run_time")[0].alias("runtime_median")
    )
    return sums.join(middle, keys, "left").na.fill(0)


def frequency_counts(df: DataFrame, column: str = "user") -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null values of each column, as (column, value), in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("value").isNotNull()).distinct()


def label_encode(df: DataFrame, columns: Sequence[str] = ("partition", "qos")) -> DataFrame:
    """(column, value, code): the distinct values in order, numbered from 0.

    Only the distinct values are numbered, so the window sees one row per category.
    """
    order = Window.partitionBy("column").orderBy("value")
    return distinct_values(df, columns).withColumn("code", F.row_number().over(order) - 1)


def feature_stats(df: DataFrame, columns: Sequence[str], quantile_mode: str = "exact") -> DataFrame:
    """(feature, mean, std, min, max, q25, q50, q75) of many columns from one wide aggregate."""
    aggs = []
    for c in columns:
        v = F.col(f"`{c}`").cast("double")
        aggs += [F.avg(v).alias(f"{c}_mean"), F.stddev_samp(v).alias(f"{c}_std")]
        aggs += [F.min(v).alias(f"{c}_min"), F.max(v).alias(f"{c}_max")]
    parts = {c: [F.col(f"{c}_{s}") for s in ("mean", "std", "min", "max")] for c in columns}
    moments = unpivot_row(df.agg(*aggs), "feature", parts, ["mean", "std", "min", "max"])
    quarters = _quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns}, mode=quantile_mode)
    spread = unpivot_row(
        quarters, "feature", {c: [F.col(c)[i] for i in range(3)] for c in columns}, ["q25", "q50", "q75"]
    )
    return moments.join(spread, "feature")


def column_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    found = exact_quantiles(df, {c: [0.5] for c in columns})
    return found.select(*[F.col(c)[0].alias(c) for c in columns])


def median_fill(df: DataFrame, column: str = "wallclock_req", medians: DataFrame | None = None) -> DataFrame:
    """NULLs of `column` take the median of this frame, or of the frame `medians` came from."""
    middle = only_row(medians if medians is not None else column_medians(df, [column]))
    return df.withColumn(column, F.coalesce(F.col(column), middle[column]))


def batch_summary(results: DataFrame) -> DataFrame:
    """One row over scored results; the most common category breaks ties by name."""
    ok = F.col("prediction_status") == "success"
    per_category = results.groupBy("prediction_status", "runtime_category").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("predicted_runtime").alias("runtime"),
        F.sum("efficiency").alias("eff"),
        F.count("efficiency").alias("eff_n"),
    )
    done = F.when(ok, F.col("n")).otherwise(0)
    most = F.struct((-F.col("n")).alias("n"), F.col("runtime_category"))
    return per_category.agg(
        F.sum("n").alias("total_jobs"),
        F.sum(done).alias("successful"),
        F.sum(F.when(~ok, F.col("n")).otherwise(0)).alias("failed"),
        F.try_divide(F.sum(F.when(ok, F.col("runtime"))), F.sum(done)).alias("avg_predicted_runtime"),
        F.sum(F.when(ok, F.col("runtime"))).alias("total_predicted_runtime"),
        F.try_divide(F.sum(F.when(ok, F.col("eff"))), F.sum(F.when(ok, F.col("eff_n")))).alias("avg_efficiency"),
        F.min(F.when(ok & F.col("runtime_category").isNotNull(), most))["runtime_category"].alias("most_common_category"),
    )


def category_counts(results: DataFrame, column: str = "runtime_category") -> DataFrame:
    counted = results.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), column)


def log_summary(df: DataFrame) -> DataFrame:
    """Rows, time range and GPU jobs, for the whole log and per partition, in one pass."""
    grouped = df.groupingSets([["partition"], []], "partition")
    return grouped.agg(
        F.grouping_id().cast("int").alias("_level"),
        F.count(F.lit(1)).alias("jobs"),
        F.min("submit_time").alias("first_submit"),
        F.max("submit_time").alias("last_submit"),
        F.count_if(F.col("gpus_req") > 0).alias("gpu_jobs"),
    ).select(
        F.when(F.col("_level") == 0, "partition").otherwise("all").alias("scope"),
        "partition", "jobs", "first_submit", "last_submit", "gpu_jobs",
    )


def runtime_histogram(df: DataFrame, column: str = "predicted_runtime", bins: int = 30) -> DataFrame:
    """Equal-width bins between the smallest and the largest value; empty bins are kept."""
    edge = only_row(df.agg(F.min(column).alias("low"), F.max(column).alias("high")))
    width = (edge["high"] - edge["low"]) / F.lit(float(bins))
    at = F.coalesce(F.floor(F.try_divide(F.col(column) - edge["low"], width)), F.lit(0))
    counted = (
        df.where(F.col(column).isNotNull())
        .select(F.least(at, F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counted), "bin", "left").select(
        "bin",
        (edge["low"] + F.col("bin") * width).alias("low"),
        (edge["low"] + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
    )


def efficiency_box(results: DataFrame, by: str = "partition", value: str = "efficiency") -> DataFrame:
    """Per group: smallest, quartiles, largest."""
    found = grouped_quantiles(results, {value: [0.0, 0.25, 0.5, 0.75, 1.0]}, [by])
    names = ["lowest", "q1", "median", "q3", "highest"]
    return found.select(by, *[F.col(value)[i].alias(n) for i, n in enumerate(names)])


def latency_percentiles(requests: DataFrame, quantile_mode: str = "exact") -> DataFrame:
    found = _quantiles(requests, {"latency_s": [0.5, 0.95, 0.99]}, mode=quantile_mode)
    return found.select(*[F.col("latency_s")[i].alias(n) for i, n in enumerate(["p50", "p95", "p99"])])


def error_rate_hourly(requests: DataFrame, limit: float = 1.0) -> DataFrame:
    per_hour = requests.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(
        (F.avg(F.when(F.col("status") == "error", 1.0).otherwise(0.0)) * 100).alias("error_pct")
    )
    return per_hour.withColumn("over_limit", F.col("error_pct") > limit)


def requests_per_minute(requests: DataFrame, points: int = 60) -> DataFrame:
    """Requests in each of the last `points` minutes up to the newest request."""
    last = only_row(requests.agg(F.date_trunc("minute", F.max("ts")).alias("minute")))["minute"]
    back = F.expr(f"INTERVAL {points - 1} MINUTES")
    counted = (
        requests.where(F.col("ts") >= last - back)
        .groupBy(F.date_trunc("minute", "ts").alias("minute"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = requests.agg(F.date_trunc("minute", F.max("ts")).alias("m")).select(
        F.explode(F.sequence(F.col("m") - back, F.col("m"), F.expr("INTERVAL 1 MINUTE"))).alias("minute")
    )
    return grid.join(F.broadcast(counted), "minute", "left").select(
        "minute", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )
