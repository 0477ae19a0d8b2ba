"""Ordered target statistics: a category's value is the mean label of the rows before, so no row sees its own label.

Labels are summed as whole millionths, so that running totals are exact and the same in any order. The running totals come
from `history.rolling_totals`, which carries sums between time chunks; a category that holds half of all rows isn't one
task's work. Rows of one moment don't see each other, and rows without a time get the prior alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from queuelens.operators.history import rolling_totals

UNIT = 1e6


def in_units(label: Column) -> Column:
    return F.round(label * F.lit(UNIT)).cast("bigint")


def smoothed(total: Column, n: Column, prior: float, weight: float = 1.0) -> Column:
    """The mean label of `n` rows, drawn towards the prior as if by `weight` rows more."""
    zero = F.lit(0).cast("bigint")
    return (F.coalesce(total, zero) / F.lit(UNIT) + F.lit(prior * weight)) / (F.coalesce(n, zero) + F.lit(weight))


def prior_label(df: DataFrame, label: Column) -> float:
    """The mean label, the prior of every category; 0 without rows."""
    row = df.agg(F.sum(in_units(label)).alias("total"), F.count(label).alias("n")).first()
    return row["total"] / UNIT / row["n"] if row["n"] else 0.0


def category_totals(df: DataFrame, columns: Sequence[str], label: Column) -> DataFrame:
    """(column, value, n, total) over all rows, in one pass; what rows outside the training rows look up."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    rows = df.select(in_units(label).alias("units"), F.explode(pairs).alias("p")).where(F.col("units").isNotNull())
    return rows.groupBy("p.column", "p.value").agg(F.count("*").alias("n"), F.sum("units").alias("total"))


def ordered_statistics(df: DataFrame, column: str, label: Column, prior: float, weight: float = 1.0, time: str = "submit_time") -> DataFrame:
    """Adds `<column>_target` from strictly earlier rows of the same category (NULL is one)."""
    packed = df.select(F.struct("*").alias("_row"), F.col(column).alias("_category"), F.unix_micros(time).alias("_at"), in_units(label).alias("_units"))
    measures = {"n": F.when(F.col("_units").isNull(), 0).otherwise(1), "total": F.coalesce("_units", F.lit(0))}
    known = rolling_totals(packed, "_category", "_row", F.col("_at"), measures, {"ever": None})
    return known.select("_row.*", smoothed(F.col("total_ever"), F.col("n_ever"), prior, weight).alias(f"{column}_target"))


def looked_up_statistics(df: DataFrame, totals: DataFrame, column: str, prior: float, weight: float = 1.0) -> DataFrame:
    """Adds `<column>_target` from the fitted totals; a value that they lack gets the prior."""
    known = totals.where(F.col("column") == column).select(F.col("value").alias("_value"), F.col("n").alias("_n"), F.col("total").alias("_total"))
    joined = df.join(known, df[column].cast("string").eqNullSafe(known["_value"]), "left")
    return joined.withColumn(f"{column}_target", smoothed(F.col("_total"), F.col("_n"), prior, weight)).drop("_value", "_n", "_total")
