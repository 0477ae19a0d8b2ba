"""Values shown next to a prediction: efficiency, category, band, texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Runtime categories: upper limits in seconds; anything longer is very long.
CATEGORY_LIMITS = {"short": 3600, "medium": 14_400, "long": 86_400}
OVERESTIMATE_ALERT = 1.5


def efficiency(predicted: Column, requested: Column) -> Column:
    """Predicted share of the requested time in percent, at most 100."""
    share = F.try_divide(predicted, requested) * 100
    return F.when(requested <= 0, F.lit(0.0)).when(share > 100, F.lit(100.0)).otherwise(share)


def walltime_advice(predicted: Column, requested: Column) -> Column:
    share = F.try_divide(predicted, requested) * 100
    return F.when(share < 50, "reduce").when(share > 90, "add buffer")


def overestimation_alert(predicted: Column, requested: Column) -> Column:
    return F.coalesce(F.try_divide(requested, predicted) > OVERESTIMATE_ALERT, F.lit(False))


def band_20pct(predicted: Column) -> tuple[Column, Column]:
    return predicted * F.lit(0.8), predicted * F.lit(1.2)


def runtime_category(predicted: Column) -> Column:
    chain = F
    for name, limit in CATEGORY_LIMITS.items():
        chain = chain.when(predicted < limit, name)
    return chain.when(predicted.isNotNull(), "very_long")


def inverse_log(prediction: Column) -> Column:
    return F.expm1(prediction)


def gauge_band(value: Column, good: float = 80, warning: float = 60) -> Column:
    return F.when(value >= good, "green").when(value >= warning, "orange").otherwise("red")


def accuracy_pct(mape: Column) -> Column:
    return F.lit(100.0) - mape


def latency_recommendation(mean_ms: Column, limit: float = 50) -> Column:
    return F.when(mean_ms > limit, "High Latency").otherwise("System Healthy")


def title_case(text: Column) -> Column:
    return F.initcap(text)


def format_runtime(seconds: Column) -> Column:
    """`12.3s`, `4m 5s`, `2h 3m 4s` or `1d 2h 3m`."""
    whole = F.floor(seconds).cast("bigint")

    def part(size: int, wrap: int | None) -> Column:
        count = F.floor(whole / size).cast("bigint")
        return count % wrap if wrap else count

    second, minute = part(1, 60), part(60, 60)
    hour, day = part(3600, 24), part(86_400, None)
    return (
        F.when(seconds < 60, F.format_string("%.1fs", seconds))
        .when(seconds < 3600, F.format_string("%dm %ds", minute, second))
        .when(seconds < 86_400, F.format_string("%dh %dm %ds", hour, minute, second))
        .when(seconds.isNotNull(), F.format_string("%dd %dh %dm", day, hour, minute))
    )


def feature_key(fields: list[str]) -> Column:
    """Digest of the named fields, independent of their order."""
    return F.md5(F.to_json(F.struct(*[F.col(f) for f in sorted(fields)])))
