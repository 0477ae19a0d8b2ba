"""Robust scaling: centre on the median, divide by the interquartile range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from queuelens.operators.quantiles import exact_quantiles
from queuelens.operators.scalars import unpivot_row

QUARTERS = [0.25, 0.5, 0.75]


def finite(value: Column) -> Column:
    """The value as a double, NULL where it is NaN or infinite."""
    v = value.cast("double")
    return F.when(F.abs(v) < F.lit(float("inf")), v)  # NaN sorts above infinity


def fit_scaler_params(
    df: DataFrame, columns: Sequence[str], rows: int | None = None, weight: str | None = None
) -> dict[str, tuple[float, float]]:
    """{column: (centre, scale)}, the quartiles taken after missing values became the median.

    The search also tells how many values each column holds. Only columns that hold fewer than
    there are rows (counted here unless given) need a second search, over the filled column.
    Three numbers per column reach the driver. With `weight` a row stands for that many, and `rows` is their sum.
    """
    if rows is None:
        rows = df.agg(F.sum(weight)).first()[0] if weight else df.count()
    kept = [weight] if weight else []
    values = df.select(*[finite(F.col(c)).alias(c) for c in columns], *kept)
    first = exact_quantiles(values, {c: QUARTERS for c in columns}, weight=weight, counts_as="_found").first()
    quarters = {c: first[c] for c in columns}
    refit = [c for c, n in zip(columns, first["_found"]) if 0 < n < rows]
    if refit:
        filled = values.select(*[F.coalesce(F.col(c), F.lit(quarters[c][1])).alias(c) for c in refit], *kept)
        again = exact_quantiles(filled, {c: QUARTERS for c in refit}, weight=weight).first()
        quarters |= {c: again[c] for c in refit}
    params = {}
    for c, (q25, q50, q75) in quarters.items():
        spread = 0.0 if q50 is None else q75 - q25
        params[c] = (q50 if q50 is not None else 0.0, spread if spread != 0 else 1.0)
    return params


def fit_robust_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The fitted parameters as (feature, center, scale)."""
    params = fit_scaler_params(df, columns)
    row = df.sparkSession.range(1)
    parts = {c: [F.lit(center), F.lit(scale)] for c, (center, scale) in params.items()}
    return unpivot_row(row, "feature", parts, ["center", "scale"])


def scaled(value: Column, center: float, scale: float) -> Column:
    return (F.coalesce(finite(value), F.lit(center)) - F.lit(center)) / F.lit(scale)


def apply_robust_scaler(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f"{c}_scaled": scaled(F.col(c), *p) for c, p in params.items() if c in df.columns})
