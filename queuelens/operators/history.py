"""Rolling history of a user or queue over strictly earlier rows, safe for hot keys.

A range window per key would put a hot key's whole history in one task. Instead the running
totals up to any moment are split into "all earlier time chunks" plus "earlier in this chunk":
chunk totals are pre-aggregated, and windows only run inside one (key, chunk). The history over
the last d is then the difference of two running totals, at t and at t - d. Measures are summed
as bigint, so the difference is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

HOUR = 3_600_000_000
DAY = 24 * HOUR


def rolling_totals(
    df: DataFrame,
    by: str,
    id_column: str,
    time_us: Column,
    measures: dict[str, Column],
    windows: dict[str, int | None],
    chunk_us: int = HOUR // 6,
) -> DataFrame:
    """(id, key, `<measure>_<window>`...) of every row of `df`: sums of bigint measures over [t - window, t).

    A window of None has no start. Rows are first summed per (key, moment); only these sums are questioned and
    carried, and the answers are joined back to the rows. Rows without a time have no history, so their sums are 0.
    """
    names = list(measures)
    offsets = {"now": 0, **{w: d for w, d in windows.items() if d is not None}}
    rows = df.select(
        F.col(id_column).alias("_id"), F.col(by).alias("_by"), time_us.alias("_t"), *[m.cast("bigint").alias(n) for n, m in measures.items()]
    )
    summed = rows.where(F.col("_t").isNotNull()).groupBy("_by", "_t").agg(*[F.sum(n).alias(n) for n in names])
    # A moment asks for the total before its own time and before each window's start. Its question
    # at its own time also carries what it adds; the others add nothing.
    asks = F.array(*[F.struct(F.lit(i).alias("w"), F.lit(d).cast("bigint").alias("d")) for i, d in enumerate(offsets.values())])
    added = [F.when(F.col("q.w") == 0, F.col(n)).otherwise(F.lit(0).cast("bigint")).alias(n) for n in names]
    moments = (
        summed.select("_by", "_t", *names, F.explode(asks).alias("q"))
        .select("_by", "_t", F.col("q.w").alias("_w"), (F.col("_t") - F.col("q.d")).alias("_at"), *added)
        .withColumn("_chunk", F.floor(F.col("_at") / F.lit(chunk_us)))
    )

    # Totals carried into each (key, chunk) that holds a question.
    per_chunk = moments.groupBy("_by", "_chunk").agg(*[F.sum(n).alias(n) for n in names])
    earlier = Window.partitionBy("_by").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.select(
        F.col("_by").alias("_kb"), F.col("_chunk").alias("_kc"), *[F.sum(n).over(earlier).alias(f"_c_{n}") for n in names]
    )
    inside = Window.partitionBy("_by", "_chunk").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    running = moments.select("_by", "_t", "_w", "_chunk", *[F.sum(n).over(inside).alias(n) for n in names])
    answers = running.join(carried, F.col("_by").eqNullSafe(F.col("_kb")) & (F.col("_chunk") == F.col("_kc")))

    zero = F.lit(0).cast("bigint")

    def total(name: str, window: int) -> Column:
        before = F.coalesce(F.col(name), zero) + F.coalesce(F.col(f"_c_{name}"), zero)
        return F.sum(F.when(F.col("_w") == window, before))

    places = {w: i for i, w in enumerate(offsets)}
    found = {f"{n}_{w}": total(n, 0) - total(n, places[w]) if w in places else total(n, 0) for w in windows for n in names}
    told = answers.groupBy(F.col("_by").alias("_tb"), F.col("_t").alias("_tt")).agg(*[c.alias(n) for n, c in found.items()])
    joined = rows.join(told, F.col("_by").eqNullSafe(F.col("_tb")) & (F.col("_t") == F.col("_tt")), "left")
    return joined.select(F.col("_id").alias(id_column), F.col("_by").alias(by), *[F.coalesce(n, zero).alias(n) for n in found])


def user_history(df: DataFrame, days: Sequence[int] = (7, 30, 90)) -> DataFrame:
    """Per job: how many jobs its user submitted in the days before, and their mean run time."""
    totals = rolling_totals(
        df, "user", "job_id", F.unix_micros("submit_time"),
        {"jobs": F.lit(1), "runtime": F.coalesce("run_time", F.lit(0))},
        {f"{d}d": d * DAY for d in days},
    )
    return totals.select(
        "job_id", "user",
        *[F.col(f"jobs_{d}d").alias(f"user_jobs_{d}d") for d in days],
        *[F.try_divide(f"runtime_{d}d", f"jobs_{d}d").alias(f"user_mean_runtime_{d}d") for d in days],
    )


def queue_history(df: DataFrame, hours: Sequence[int] = (1, 6, 24)) -> DataFrame:
    """Per job: jobs and processors its partition was asked for in the hours before."""
    totals = rolling_totals(
        df, "partition", "job_id", F.unix_micros("submit_time"),
        {"jobs": F.lit(1), "processors": F.coalesce("processors_req", F.lit(0))},
        {f"{h}h": h * HOUR for h in hours},
    )
    return totals.select(
        "job_id", "partition",
        *[F.col(f"jobs_{h}h").alias(f"queue_jobs_{h}h") for h in hours],
        *[F.col(f"processors_{h}h").alias(f"queue_processors_{h}h") for h in hours],
    )


def active_connections(requests: DataFrame) -> DataFrame:
    """The number of open requests after each moment at which it changed or was touched.

    Starts and ends are netted per moment, then per minute; the running total over minutes is
    carried into windows that each cover one minute.
    """
    started = F.unix_micros("ts")
    ended = started + F.round(F.col("latency_s") * 1e6).cast("bigint")
    steps = F.array(F.struct(started.alias("at"), F.lit(1).alias("d")), F.struct(ended.alias("at"), F.lit(-1).alias("d")))
    moments = (
        requests.select(F.explode(steps).alias("s"))
        .groupBy(F.col("s.at").alias("at_us"))
        .agg(F.sum("s.d").alias("delta"))
        .withColumn("_minute", F.floor(F.col("at_us") / F.lit(60_000_000)))
    )
    # One row per minute of the log: bounded by its time span, not by its rows.
    before = Window.orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        moments.groupBy("_minute").agg(F.sum("delta").alias("net"))
        .select("_minute", F.coalesce(F.sum("net").over(before), F.lit(0).cast("bigint")).alias("_open"))
    )
    inside = Window.partitionBy("_minute").orderBy("at_us").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        moments.withColumn("_in", F.sum("delta").over(inside))
        .join(carried, "_minute")
        .select("at_us", (F.col("_open") + F.col("_in")).alias("active"))
    )
