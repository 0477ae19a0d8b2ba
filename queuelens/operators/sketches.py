"""Stored summaries that add up: quantiles, distinct counts and frequent keys of slices of a log.

A sketch is a value of a grouped table, a few kilobytes for each slice (a day, an hour of a partition), so a
table of them is written once and later merged over any range without the rows. Each has a stated error:

* quantiles (KLL): the rank of an answer is off by at most `rank_error(k)` with 99 % confidence, however
  many rows and slices there are;
* distinct counts (HLL): a standard error of `distinct_error(log_k)` of the count;
* frequent keys: every key with more than `share` of the rows is named if `share` is above `2 * count_error()`.

NULL, NaN and infinite numbers are left out, as the exact operators do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from queuelens.operators.filters import narrow_type

QUANTILE_K = 1000
DISTINCT_LOG_K = 12
#: Keys that a sketch of frequent keys may hold.
TRACKED = 10_000


def rank_error(k: int = QUANTILE_K) -> float:
    """Normalised rank error of a KLL sketch at 99 % confidence (fixed values of the published error curve)."""
    return 2.296 / k**0.9723


def distinct_error(log_k: int = DISTINCT_LOG_K) -> float:
    """Relative standard error of a HyperLogLog estimate."""
    return 1.04 / 2 ** (log_k / 2)


def count_error(tracked: int = TRACKED) -> float:
    """Share of all rows by which a frequent key's count may be off: 3.5 slots of a map at most three quarters full."""
    slots = 1
    while slots * 0.75 < tracked:
        slots *= 2
    return 3.5 / slots


# --- quantiles -----------------------------------------------------------------------------------


def quantile_sketches(df: DataFrame, value: str, by: Sequence[str], k: int = QUANTILE_K) -> DataFrame:
    """(`by`, sketch): one quantile sketch of `value` for each slice. Combined map-side, so a hot slice is no task's work."""
    v = F.col(value).cast("double")
    finite = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return finite.groupBy(*by).agg(F.kll_sketch_agg_double(v, k).alias("sketch"))


def merged_quantiles(sketches: DataFrame, probabilities: Sequence[float], by: Sequence[str] = (), k: int = QUANTILE_K) -> DataFrame:
    """(`by`, p, value, n): quantiles over all slices of a group, from their sketches alone."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))
    answers = F.array(
        *[
            F.struct(
                F.lit(float(p)).alias("p"),
                F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value"),
                F.kll_sketch_get_n_double("sketch").alias("n"),
            )
            for p in probabilities
        ]
    )
    found = merged.where(F.kll_sketch_get_n_double("sketch") > 0)
    return found.select(*by, F.explode(answers).alias("a")).select(*by, "a.*")


def rank_check(df: DataFrame, value: str, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """(`by`, p, n, off): how far the exact rank of each answer is from `p`, by counting the rows below it.

    Equal values share a range of ranks; an answer within it is off by 0.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    counted = rows.join(found.select(*by, "p", "value"), list(by)).groupBy(*by, "p").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_v") < F.col("value")).alias("_below"),
        F.count_if(F.col("_v") <= F.col("value")).alias("_upto"),
    )
    off = F.greatest(F.col("_below") / F.col("n") - F.col("p"), F.col("p") - F.col("_upto") / F.col("n"), F.lit(0.0))
    return counted.select(*by, "p", "n", off.alias("off"))


# --- distinct counts -----------------------------------------------------------------------------


def column_sketches(df: DataFrame, by: Sequence[str], log_k: int = DISTINCT_LOG_K) -> DataFrame:
    """(`by`, column, rows, low, high, sketch): what a schema profile needs of each slice, in one pass without an Expand.

    Numbers have their range, texts a distinct-count sketch; columns of other types are not profiled.
    """
    aggs, parts = [F.count(F.lit(1)).alias("_rows")], {}
    for field in df.schema.fields:
        c, col = field.name, F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.NumericType):
            aggs += [F.min(col).cast("double").alias(f"{c}_low"), F.max(col).cast("double").alias(f"{c}_high")]
            parts[c] = [F.col("_rows"), F.col(f"{c}_low"), F.col(f"{c}_high"), F.lit(None).cast("binary")]
        elif isinstance(field.dataType, T.StringType):
            aggs.append(F.hll_sketch_agg(col, log_k).alias(f"{c}_sketch"))
            none = F.lit(None).cast("double")
            parts[c] = [F.col("_rows"), none, none, F.col(f"{c}_sketch")]
    wide = df.groupBy(*by).agg(*aggs)
    rows = [
        F.struct(F.lit(c).alias("column"), *[v.alias(n) for v, n in zip(values, ("rows", "low", "high", "sketch"))])
        for c, values in parts.items()
    ]
    return wide.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")


def merged_columns(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(`by`, column, rows, low, high, distinct): the slices of each column put together."""
    return sketches.groupBy(*by, "column").agg(
        F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"),
    )


def profile_from_sketches(df: DataFrame, sketches: DataFrame, limit: float = 0.5, sigmas: float = 6.0) -> DataFrame:
    """(column, min_value, max_value, distinct_estimate, suggested): `profile_schema`'s suggestions from stored slices.

    A text column whose estimated share of distinct values is within `sigmas` standard errors of `limit` is counted
    exactly, on its own, from `df`; all others are settled by their sketches without reading a row.
    One row for each column comes to the driver.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    found = merged_columns(sketches)
    margin = sigmas * distinct_error()
    share = F.col("distinct") / F.col("rows")
    close = found.where(share.between(limit / (1 + margin), limit / (1 - margin))).select("column").collect()
    exact = F.lit(None).cast("bigint")
    for name in (r["column"] for r in close):
        n = df.select(F.col(f"`{name}`").alias("v")).where(F.col("v").isNotNull()).distinct().count()
        exact = F.when(F.col("column") == name, F.lit(n).cast("bigint")).otherwise(exact)
    share = F.try_divide(F.coalesce(exact, F.col("distinct")).cast("double"), F.col("rows").cast("double"))
    text = F.when(share < limit, "category").otherwise("string")
    whole = [c for c, kind in kinds.items() if isinstance(kind, T.IntegralType)]
    parts = [c for c, kind in kinds.items() if isinstance(kind, T.FractionalType)]
    suggested = (
        F.when(F.col("column").isin(whole), narrow_type(F.col("low"), F.col("high")))
        .when(F.col("column").isin(parts), "float32")
        .otherwise(text)
    )
    return found.select(
        "column", F.col("low").alias("min_value"), F.col("high").alias("max_value"),
        F.coalesce(exact, F.col("distinct")).alias("distinct_estimate"), suggested.alias("suggested"),
    )


# --- frequent keys -------------------------------------------------------------------------------


def frequent_sketches(df: DataFrame, key: str, by: Sequence[str] = (), tracked: int = TRACKED) -> DataFrame:
    """(`by`, n, sketch): rows and a sketch of the frequent keys of each slice; NULL keys are not counted."""
    known = df.where(F.col(key).isNotNull())
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k_accumulate(`{key}`, {tracked})").alias("sketch")
    )


def heavy_keys(sketches: DataFrame, key: str, share: float = 0.001, tracked: int = TRACKED) -> DataFrame:
    """(`key`, n, share): the keys that hold at least about `share` of all rows, most frequent first.

    At most `1 / (share - count_error())` rows, however many keys there are.
    """
    if share <= 2 * count_error(tracked):
        raise ValueError(f"a share of {share} needs a sketch that tracks more than {tracked} keys")
    merged = sketches.agg(F.sum("n").alias("_all"), F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("_sketch"))
    answer = F.expr(f"approx_top_k_estimate(_sketch, {min(tracked, int(2 / share) + 1)})")
    listed = merged.where(F.col("_all") > 0).select("_all", F.explode(answer).alias("_e"))
    part = F.col("_e.count") / F.col("_all")
    # An estimate may be too low by the error; such a key is named rather than missed.
    named = listed.where(part >= share - count_error(tracked))
    return named.select(F.col("_e.item").alias(key), F.col("_e.count").alias("n"), part.alias("share"))
