"""Request-log metrics: totals, trailing rates, latency histograms and their quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from queuelens.schema import INFERENCE_BOUNDS, LATENCY_BOUNDS

WINDOW_MINUTES = 5
WINDOW_SECONDS = 60.0 * WINDOW_MINUTES
MAX_QUEUE = 10_000


def answered(requests: DataFrame) -> DataFrame:
    """Latency is only recorded for requests that got an answer."""
    return requests.where(F.col("status") == "success")


def requests_total(requests: DataFrame) -> DataFrame:
    return requests.groupBy("method", "status").agg(F.count(F.lit(1)).alias("n"))


def trailing(requests: DataFrame, sums: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Sums over each 5-minute window, sliding by one minute: (window_start, by..., sums...).

    Rows are first summed per minute; only those minute rows are copied into the five windows
    that cover them.
    """
    minutes = requests.groupBy(F.date_trunc("minute", "ts").alias("_minute"), *by).agg(
        *[F.sum(c.cast("bigint")).alias(n) for n, c in sums.items()]
    )
    starts = F.sequence(
        F.col("_minute") - F.expr(f"INTERVAL {WINDOW_MINUTES - 1} MINUTES"), F.col("_minute"), F.expr("INTERVAL 1 MINUTE")
    )
    return (
        minutes.select(F.explode(starts).alias("window_start"), *by, *sums)
        .groupBy("window_start", *by)
        .agg(*[F.sum(n).alias(n) for n in sums])
    )


def rate_by_method(requests: DataFrame) -> DataFrame:
    found = trailing(requests, {"n": F.lit(1)}, ["method"])
    return found.select("window_start", "method", (F.col("n") / F.lit(WINDOW_SECONDS)).alias("per_second"))


def error_rate(requests: DataFrame) -> DataFrame:
    return rate_by_method(requests.where(F.col("status") == "error"))


def retry_rate(requests: DataFrame) -> DataFrame:
    found = trailing(requests, {"n": F.col("retries")}, ["method"])
    return found.select("window_start", "method", (F.col("n") / F.lit(WINDOW_SECONDS)).alias("per_second"))


def cache_hit_rate(requests: DataFrame) -> DataFrame:
    """Percent of cache lookups that hit, per trailing window; NULL without lookups."""
    looked_up = F.col("cache_hit").isNotNull()
    found = trailing(requests, {"hits": F.coalesce(F.col("cache_hit"), F.lit(False)).cast("int"), "lookups": looked_up.cast("int")})
    return found.select(
        "window_start", (F.try_divide(F.col("hits").cast("double"), F.col("lookups").cast("double")) * 100).alias("hit_pct")
    )


def queue_size(requests: DataFrame) -> DataFrame:
    """Streamed requests of the trailing window, and whether a queue of MAX_QUEUE could hold them."""
    found = trailing(requests.where(F.col("method") == "PredictStream"), {"n": F.lit(1)})
    return found.select("window_start", F.col("n").alias("queue_size"), (F.col("n") > MAX_QUEUE).alias("over_capacity"))


def batch_size(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("method") == "PredictBatch").agg(
        F.count("batch_size").alias("batches"),
        F.sum(F.col("batch_size").cast("bigint")).alias("jobs"),
        F.avg("batch_size").alias("avg_batch_size"),
    )


def average_latency(requests: DataFrame) -> DataFrame:
    """Mean latency (ms) of answered single predictions, 0 when there are none."""
    done = (F.col("method") == "Predict") & (F.col("status") == "success")
    mean = F.try_divide(F.sum(F.when(done, F.col("latency_s"))), F.count_if(done))
    return requests.agg(
        F.count_if(done).alias("predictions_served"), F.coalesce(mean * 1000, F.lit(0.0)).alias("average_latency_ms")
    )


def _cumulative(requests: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Per group an array of counts at or below each bound, closed by the total."""
    counts = [F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)]
    wide = requests.groupBy(*by).agg(*counts, F.count(value).alias("_total"))
    return wide.select(*by, F.array(*[f"_{i}" for i in range(len(bounds))], "_total").alias("counts"))


def latency_histogram(
    requests: DataFrame, value: str = "latency_s", bounds: Sequence[float] = LATENCY_BOUNDS, by: Sequence[str] = ("method",)
) -> DataFrame:
    """(by..., le, n): cumulative counts per upper bound, `+Inf` last."""
    labels = F.array(*[F.lit(f"{b:g}") for b in bounds], F.lit("+Inf"))
    rows = F.arrays_zip(labels.alias("le"), F.col("counts").alias("n"))
    return _cumulative(requests, value, bounds, by).select(*by, F.inline(rows).alias("le", "n"))


def histogram_quantiles(
    requests: DataFrame,
    value: str,
    bounds: Sequence[float],
    by: Sequence[str] = (),
    quantiles: Sequence[float] = (0.5, 0.95, 0.99),
) -> DataFrame:
    """Quantiles in ms read off the histogram: linear inside a bucket, capped at the last bound."""
    limits = F.array(*[F.lit(float(b)) for b in bounds])
    counts = F.col("counts")

    def estimate(q: float) -> Column:
        target = F.lit(q) * counts[len(bounds)]
        hit = F.array_position(F.transform(counts, lambda c: c >= target), F.lit(True)).cast("int")
        low = F.when(hit > 1, F.get(limits, hit - 2)).otherwise(0.0)
        seen = F.when(hit > 1, F.get(counts, hit - 2)).otherwise(0)
        inside = F.get(counts, hit - 1) - seen
        value_in = low + (F.get(limits, hit - 1) - low) * F.try_divide(target - seen, inside.cast("double"))
        return F.when(counts[len(bounds)] == 0, F.lit(None)).when(
            hit > len(bounds), F.lit(float(bounds[-1]))
        ).otherwise(value_in)

    table = _cumulative(requests, value, bounds, by)
    return table.select(*by, *[(estimate(q) * 1000).alias(f"p{int(q * 100)}_ms") for q in quantiles])


def latency_quantiles(requests: DataFrame) -> DataFrame:
    return histogram_quantiles(answered(requests), "latency_s", LATENCY_BOUNDS, ["method"])


def inference_quantiles(requests: DataFrame) -> DataFrame:
    return histogram_quantiles(answered(requests), "inference_s", INFERENCE_BOUNDS)
