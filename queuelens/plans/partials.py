"""Fitted feature state that grows by a slice of the log without reading the rest again.

A slice (a day, unless asked otherwise) leaves six small tables of counts and sums. Tables of any slices
add up, and the state of the sum is the one that `features.fit` learns from all their rows: thresholds and
quartiles are taken over counted values, so they stay exact. The tables grow with the distinct values of
a slice (users; request shapes; waiting seconds), not with its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from queuelens.functions import calendar as cal, names, resources as res
from queuelens.operators.aggregates import label_encode
from queuelens.operators.scaling import fit_scaler_params
from queuelens.operators.splits import concat
from queuelens.plans import features
from queuelens.session import materialize

SHAPE = ("processors_req", "nodes_req", "mem_req", "wallclock_req")
#: Keys of each part; every other column of a part is a count or a sum.
KEYS = {
    "users": ("user",), "hours": ("partition", "submit_hour"), "qos": ("qos",), "shapes": SHAPE,
    "names": ("name_length", "array_job_size"), "waits": ("queue_wait_time",),
}


def slice_parts(df: DataFrame, by: Column) -> dict[str, DataFrame]:
    """The six tables of every slice that `by` names, as (slice, keys, counts and sums)."""
    asked, run = F.col("wallclock_req"), res.at_least_one(F.col("run_time"))
    named = names.name_features(F.col("name"))
    keyed = df.withColumns(
        {
            "slice": by.cast("string"),
            "submit_hour": F.hour("submit_time"),
            "name_length": named["name_length"],
            "array_job_size": named["array_job_size"],
            "queue_wait_time": cal.queue_wait_time(F.col("start_time"), F.col("submit_time")),
        }
    )
    rows = F.count(F.lit(1)).alias("rows")
    more = {
        # A missing walltime becomes the median, which only the sum of all slices knows.
        "users": [
            F.sum("run_time").alias("runtime_sum"), F.count("run_time").alias("job_count"),
            F.sum(asked / run).alias("ratio_sum"), F.count(asked / run).alias("ratio_count"),
            F.sum(F.when(asked.isNull(), 1 / run)).alias("inverse_sum"), F.count(F.when(asked.isNull(), 1 / run)).alias("inverse_count"),
        ],
        "hours": [F.count("job_id").alias("job_count")],
    }
    return {part: keyed.groupBy("slice", *keys).agg(rows, *more.get(part, [])) for part, keys in KEYS.items()}


def add_slices(df: DataFrame, path: str, by: Column | None = None) -> str:
    """Adds the slices of `df` to the state in `path`; a slice that is there already is replaced.

    `df` holds whole slices. Adding them again after a failure leaves each one once.
    """
    for part, table in slice_parts(df, F.to_date("submit_time") if by is None else by).items():
        writer = table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("slice").parquet(f"{path}/{part}")
    return path


def merged_parts(spark: SparkSession, path: str, slices: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The sum of the chosen slices (all, unless given), a table for each part."""
    found = {}
    for part, keys in KEYS.items():
        stored = spark.read.parquet(f"{path}/{part}")
        schema = T.StructType([f if f.name != "slice" else T.StructField("slice", T.StringType()) for f in stored.schema.fields])
        table = spark.read.schema(schema).parquet(f"{path}/{part}")
        if slices is not None:
            table = table.where(F.col("slice").isin(list(slices)))
        sums = [F.sum(c).alias(c) for c in table.columns if c not in (*keys, "slice")]
        found[part] = materialize(table.groupBy(*keys).agg(*sums), f"merged-{part}")
    return found


def state_of(parts: dict[str, DataFrame]) -> features.FeatureState:
    """The fitted state of merged parts. Thresholds and quartiles alone reach the driver."""
    shapes = parts["shapes"]
    thresholds = features.fit_thresholds(shapes, "rows").first().asDict()
    median = F.lit(thresholds["wallclock_median"]).cast("double")
    filled = F.coalesce(F.col("inverse_sum") * median, F.lit(0.0))
    counted = F.col("ratio_count") + F.when(median.isNotNull(), F.col("inverse_count")).otherwise(0)
    users = materialize(
        parts["users"].select(
            "user", F.try_divide("runtime_sum", "job_count").alias("runtime_mean"), "job_count",
            F.coalesce(F.try_divide(F.coalesce("ratio_sum", F.lit(0.0)) + filled, counted), F.lit(0.0)).alias("accuracy"),
            "runtime_sum", "rows",
        ),
        "users",
    )
    totals = users.agg(F.try_divide(F.sum("runtime_sum"), F.sum("job_count")).alias("mean"), F.sum("rows").alias("rows")).first()
    thresholds["train_mean_runtime"] = totals["mean"]
    thresholds |= features.user_count_quantile(users).first().asDict()
    known = F.col("partition").isNotNull()
    queues = parts["hours"].where(known).select("partition", "submit_hour", "job_count")
    kinds = [parts["hours"].select("partition"), parts["qos"].select("qos")]
    codes = concat([label_encode(kind, kind.columns) for kind in kinds])

    mine = F.col("user").isNotNull()
    default = F.lit(totals["mean"]).cast("double")
    per_user = users.select(
        "rows",
        F.coalesce(F.when(mine, F.col("runtime_mean")), default).alias("user_mean_runtime"),
        F.when(mine, F.col("job_count")).otherwise(1).alias("user_job_count"),
        F.when(mine, F.col("accuracy")).otherwise(1.0).alias("user_accuracy_score"),
    )
    load = F.when(known & F.col("submit_hour").isNotNull(), F.col("job_count")).otherwise(0)
    sources = [
        features._with_rows(shapes, thresholds, True), per_user, parts["hours"].select("rows", load.alias("queue_load")),
        parts["names"], parts["waits"],
    ]
    scaler = {}
    for source in sources:
        columns = [c for c in features.SCALED_COLUMNS if c in source.columns]
        scaler |= fit_scaler_params(source, columns, totals["rows"], "rows")
    ordered = {c: scaler[c] for c in features.SCALED_COLUMNS}
    frequency = users.where(mine).select("user", "runtime_mean", "job_count", "accuracy", "rows")
    return features.FeatureState(thresholds, ordered, frequency, queues, materialize(codes, "codes"))


def merged_state(spark: SparkSession, path: str, slices: Sequence[str] | None = None) -> features.FeatureState:
    """The state of the chosen slices in `path`."""
    return state_of(merged_parts(spark, path, slices))
