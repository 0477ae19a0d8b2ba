"""Comparing every row with a few numbers computed over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def only_row(df: DataFrame) -> Column:
    """The single row of `df` as a struct column.

    Planned as a scalar subquery: it runs once before the stage that reads it and its fields act
    as constants there, so no join takes place.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns])).scalar()


def unpivot_row(df: DataFrame, label: str, parts: dict[str, list[Column]], names: list[str]) -> DataFrame:
    """Turns one wide row into one row per entry of `parts`: the label, then the named values."""
    rows = [
        F.struct(F.lit(key).alias(label), *[v.alias(n) for v, n in zip(values, names)])
        for key, values in parts.items()
    ]
    return df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
