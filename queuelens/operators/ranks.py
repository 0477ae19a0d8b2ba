"""Row keys at given ranks of a total order, found by refining counts instead of sorting."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

# A bracket this small is ordered with a plain top-k; anything larger is refined further.
SMALL_BRACKET = 200_000


def _bucket_of_rank(histogram: DataFrame, rank: int) -> tuple[Any, int, int]:
    """(bucket, rank inside it, its size). The histogram has one row per bucket, not per row."""
    running = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = histogram.withColumn("after", F.sum("n").over(running))
    row = placed.where(F.col("after") > rank).orderBy("key").limit(1).first()
    return row["key"], rank - (row["after"] - row["n"]), row["n"]


def keys_at_ranks(
    df: DataFrame,
    levels: Sequence[Column],
    order: Sequence[Column],
    ranks: Callable[[int], Sequence[int]],
    small: int = SMALL_BRACKET,
    prune: Callable[[Any], Column] | None = None,
) -> tuple[int, list[tuple | None]]:
    """(row count, for each 0-based rank the `order` key of the row holding it).

    `levels` are ever finer buckets that agree with `order`; each must have a modest number of
    distinct values inside one value of the level before it. Only the last, small bracket is
    sorted, and only one row per rank reaches the driver. A rank past the end gives None.
    `prune` restates a value of the first level as a predicate that a file source can skip by.
    """
    first = df.groupBy(levels[0].alias("key")).agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        found: list[tuple | None] = []
        for rank in ranks(total):
            if not 0 <= rank < total:
                found.append(None)
                continue
            bucket, offset, size = _bucket_of_rank(first, rank)
            bracket = df.where(levels[0].eqNullSafe(F.lit(bucket)))
            if prune is not None:
                bracket = bracket.where(prune(bucket))
            for level in levels[1:]:
                if size <= small:
                    break
                histogram = bracket.groupBy(level.alias("key")).agg(F.count(F.lit(1)).alias("n"))
                bucket, offset, size = _bucket_of_rank(histogram, offset)
                bracket = bracket.where(level.eqNullSafe(F.lit(bucket)))
            keys = [c.alias(f"o{i}") for i, c in enumerate(order)]
            names = [f"o{i}" for i in range(len(order))]
            found.append(tuple(bracket.select(*keys).orderBy(*names).offset(offset).limit(1).first()))
        return total, found
    finally:
        first.unpersist()
