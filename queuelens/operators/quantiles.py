"""Exact interpolated quantiles of many columns, without gathering a group in one task.

The built-in `percentile` keeps every distinct value of a group in one task's map. Here each
value is first counted in a bucket that preserves order; the running count over the buckets
tells which bucket holds each wanted rank. The distinct values of those few buckets are counted
in finer buckets in the same way, and only the values of the finer buckets are ordered. Counting
combines map-side, so a hot group or a hot value costs one counter.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from queuelens.session import materialize

# Coarse buckets are log-spaced: all finite doubles fall into a bounded number of them, few enough
# for map-side counting to shrink a task's rows by orders of magnitude. Fine buckets divide what
# a coarse bucket really spans evenly.
BUCKETS_PER_E = 4096.0
SMALLEST_UNIT = 1e6
FINE_BUCKETS = 4096.0
# Rows of a group up to which one task may hold all its values (some tens of MB).
GROUP_LIMIT = 1_000_000


def _fine_bucket(v: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, F.floor((v - low) / (high - low) * FINE_BUCKETS)).otherwise(F.lit(0))


def _bucket(v: Column) -> Column:
    # log1p of a product above 1e300 saturates, which keeps the order.
    scaled = F.log1p(F.least(F.abs(v), F.lit(1e300)) * SMALLEST_UNIT)
    return (F.signum(v) * F.floor(scaled * BUCKETS_PER_E)).cast("bigint")


def exact_quantiles(
    df: DataFrame,
    columns: dict[str, Sequence[float]],
    by: Sequence[str] = (),
    weight: str | None = None,
    counts_as: str | None = None,
) -> DataFrame:
    """One row per group with one array column per entry of `columns`.

    `columns` maps a numeric column to the probabilities wanted from it; the array holds the
    linearly interpolated quantiles in that order (NULL where the group has no value). NULL,
    NaN and infinite values are left out. With `weight`, a row stands for that many equal rows.
    Without `by` the result is exactly one row. `counts_as` names an extra array column with
    the number of values that were found in each column.
    """
    names = list(columns)
    by = list(by)
    packed = F.array(*[F.col(f"`{c}`").cast("double") for c in names])
    count = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    finite = F.abs("v") < F.lit(float("inf"))  # not NULL, and NaN sorts above infinity
    values = (
        df.select(*by, count.alias("n"), F.posexplode(packed).alias("f", "v"))
        .where(finite)
        .withColumn("v", F.col("v") + F.lit(0.0))  # -0.0 and 0.0 are one value
    )
    if by:
        # Spread a hot group over its distinct values before anything is gathered per group.
        values = values.groupBy(*by, "f", "v").agg(F.sum("n").alias("n"))
    values = values.withColumn("b", _bucket(F.col("v")))

    # The probabilities wanted from the row's column.
    wanted = F.array(*[F.array(*[F.lit(float(p)) for p in columns[c]]) for c in names])
    probabilities = F.get(wanted, F.col("f"))

    def rank(p: Column) -> Column:
        return (F.col("total") - 1) * p

    def holds(at: Column) -> Column:
        return (at >= F.col("before")) & (at < F.col("after"))

    any_rank = F.exists(probabilities, lambda p: holds(F.floor(rank(p))) | holds(F.ceil(rank(p))))

    def running(keys: Sequence[str], order: str) -> Column:
        frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return F.sum("n").over(frame)

    def keep_matching(rows: DataFrame, targets: DataFrame, keys: Sequence[str], *carried: str) -> DataFrame:
        # Without groups there are at most two targets per probability, whatever the input.
        side = targets if by else F.broadcast(targets)
        side = side.select(*[F.col(k).alias(f"_{k}") for k in keys], *carried)
        match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        return rows.join(side, match).drop(*[f"_{k}" for k in keys])

    # Coarse buckets of the rows.
    group, coarse = [*by, "f"], [*by, "f", "b"]
    histogram = values.groupBy(*coarse).agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    placed = histogram.select(
        *coarse, "low", "high", "n",
        running(group, "b").alias("after"),
        F.sum("n").over(Window.partitionBy(*group)).alias("total"),
    ).withColumn("before", F.col("after") - F.col("n"))
    inside = (
        keep_matching(values, placed.where(any_rank), coarse, "before", "total", "low", "high")
        .groupBy(*coarse, "v")
        .agg(
            F.sum("n").alias("n"), F.min("before").alias("base"), F.min("total").alias("total"),
            F.min("low").alias("low"), F.min("high").alias("high"),
        )
        .withColumn("s", _fine_bucket(F.col("v"), F.col("low"), F.col("high")))
    )

    # Fine buckets of the distinct values in the coarse buckets found.
    fine = [*coarse, "s"]
    finer = inside.groupBy(*fine).agg(F.sum("n").alias("n"), F.min("base").alias("base"), F.min("total").alias("total"))
    placed = finer.select(*fine, "base", "total", "n", (F.col("base") + running(coarse, "s")).alias("after")).withColumn(
        "before", F.col("after") - F.col("n")
    )
    targets = placed.where(any_rank).withColumn("skipped", F.col("before") - F.col("base"))
    # Counted from the base, as the fine buckets are: both sides then need the same columns of `inside`, and share its shuffle.
    ranked = keep_matching(inside, targets, fine, "skipped").select(
        *group, "v", "total", "n", (F.col("base") + F.col("skipped") + running(fine, "v")).alias("after")
    ).withColumn("before", F.col("after") - F.col("n"))

    depth = max(len(ps) for ps in columns.values())
    aggs = []
    for j in range(depth):
        at = rank(F.get(probabilities, F.lit(j)))
        aggs += [
            F.max(F.when(holds(F.floor(at)), F.col("v"))).alias(f"lo_{j}"),
            F.max(F.when(holds(F.ceil(at)), F.col("v"))).alias(f"hi_{j}"),
            F.max(at - F.floor(at)).alias(f"fr_{j}"),
        ]
    found = F.array(
        *[F.col(f"lo_{j}") + (F.col(f"hi_{j}") - F.col(f"lo_{j}")) * F.col(f"fr_{j}") for j in range(depth)]
    )
    entry = F.struct("f", F.struct(found.alias("q"), F.col("found").alias("n")))
    per_column = ranked.groupBy(*group).agg(*aggs, F.max("total").alias("found")).select(*by, entry.alias("e"))
    # One entry per column asked for.
    wide = per_column.groupBy(*by).agg(F.map_from_entries(F.collect_list("e")).alias("m"))
    entries = [F.col("m")[i] for i in range(len(names))]
    arrays = [F.array(*[F.get(e["q"], F.lit(j)) for j in range(len(columns[c]))]).alias(c) for e, c in zip(entries, names)]
    if counts_as:
        arrays.append(F.array(*[F.coalesce(e["n"], F.lit(0)) for e in entries]).alias(counts_as))
    return wide.select(*by, *arrays)


def _built_in(df: DataFrame, columns: dict[str, Sequence[float]], by: Sequence[str]) -> DataFrame:
    aggs = []
    for c, ps in columns.items():
        v = F.col(f"`{c}`").cast("double")
        aggs.append(F.percentile(F.when(F.abs(v) < F.lit(float("inf")), v), [float(p) for p in ps]).alias(c))
    none = {c: F.coalesce(F.col(c), F.array(*[F.lit(None).cast("double") for _ in ps])) for c, ps in columns.items()}
    return df.groupBy(*by).agg(*aggs).withColumns(none)


def grouped_quantiles(
    df: DataFrame, columns: dict[str, Sequence[float]], by: Sequence[str], group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """The result of `exact_quantiles` per group, with the built-in aggregate where it is safe.

    Groups are counted first (when this is called). A group of at most `group_limit` rows fits a
    task's map, so the built-in `percentile` serves it in one shuffle; larger groups, of which there
    can only be rows / limit, take the bucket search. Every group gets its exact result.
    """
    by = list(by)
    counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    hot = materialize(counted.where(F.col("_rows") > group_limit).select(*by), "hot-groups")
    if hot.isEmpty():
        return _built_in(df, columns, by)
    same = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"h.{k}")) for k in by])
    small = df.alias("l").join(hot.alias("h"), same, "left_anti")
    large = df.alias("l").join(hot.alias("h"), same, "left_semi")
    # A hot group without any value has no row in the search, but it has one here.
    found = exact_quantiles(large, columns, by).alias("f")
    keys = reduce(lambda a, b: a & b, [F.col(f"f.{k}").eqNullSafe(F.col(f"h.{k}")) for k in by])
    none = {c: F.array(*[F.lit(None).cast("double") for _ in ps]) for c, ps in columns.items()}
    searched = hot.alias("h").join(found, keys, "left").select(
        *[F.col(f"h.{k}") for k in by], *[F.coalesce(F.col(f"f.{c}"), none[c]).alias(c) for c in columns]
    )
    return _built_in(small, columns, by).unionByName(searched)


def approx_quantiles(
    df: DataFrame, columns: dict[str, Sequence[float]], by: Sequence[str] = (), accuracy: int = 10000
) -> DataFrame:
    """The same shape from mergeable sketches: one pass, rank error at most 1/accuracy."""
    aggs = [
        F.percentile_approx(F.col(f"`{c}`").cast("double"), [float(p) for p in ps], accuracy).alias(c)
        for c, ps in columns.items()
    ]
    return df.groupBy(*by).agg(*aggs)
