"""Temporal train / validation / test split and exact-size sampling."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from queuelens.operators.ranks import keys_at_ranks

HOUR_US = 3_600_000_000
NEVER = 2**62  # stands in for a missing submit time


def nested_cuts(test_size: float = 0.2, val_size: float = 0.1) -> Callable[[int], tuple[int, int]]:
    """Cut ranks where validation is a share of what is left after the test share."""

    def cuts(n: int) -> tuple[int, int]:
        test_from = int(n * (1 - test_size))
        return int(test_from * (1 - val_size)), test_from

    return cuts


def flat_cuts(train_size: float = 0.7, val_size: float = 0.15) -> Callable[[int], tuple[int, int]]:
    """Cut ranks where each share is of all rows."""
    return lambda n: (int(n * train_size), int(n * (train_size + val_size)))


def temporal_split(df: DataFrame, cuts: Callable[[int], tuple[int, int]] | None = None) -> DataFrame:
    """Adds `split` by submission order (ties by job id); see `split_label`."""
    return df.withColumn("split", split_label(df, cuts))


def split_label(df: DataFrame, cuts: Callable[[int], tuple[int, int]] | None = None) -> Column:
    """The part of a split by submission order that a row of `df` belongs to.

    Two key searches run when this is called; the returned column only compares each row with two
    constants, so it neither sorts nor shuffles. Rows without a submit time come last.
    """
    cuts = cuts or nested_cuts()
    micros = F.coalesce(F.unix_micros("submit_time"), F.lit(NEVER))

    def in_hour(hour: int) -> Column:
        if hour > NEVER // HOUR_US - 2:
            return F.col("submit_time").isNull()
        start = F.timestamp_micros(F.lit(hour * HOUR_US))
        return (F.col("submit_time") >= start) & (F.col("submit_time") < start + F.expr("INTERVAL 1 HOUR"))

    levels = [
        F.floor(micros / F.lit(HOUR_US)),
        F.floor(micros / F.lit(1_000_000)),
        micros,
        F.shiftright("job_id", 40),
        F.shiftright("job_id", 20),
        F.col("job_id"),
    ]
    total, keys = keys_at_ranks(df, levels, [micros, F.col("job_id")], cuts, prune=in_hour)

    def before(key: tuple | None) -> Column:
        if key is None:
            return F.lit(True)
        at, job = (F.lit(k).cast("bigint") for k in key)
        return (micros < at) | ((micros == at) & (F.col("job_id") < job))

    train_end, val_end = (before(k) for k in keys)
    return F.when(train_end, "train").when(val_end, "val").otherwise("test")


def _hash_levels(digest: Column) -> list[Column]:
    return [F.substring(digest, 1, n) for n in (3, 6, 9, 12, 32)]


def sample_n(df: DataFrame, n: int, seed: int = 42, key: str = "job_id") -> DataFrame:
    """Exactly `n` rows (all, if there are fewer), the same ones for the same seed.

    Rows are ordered by a digest of key and seed; the digest at rank n is searched for, and the
    returned plan is a filter against it.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    levels = [*_hash_levels(digest), F.col(key)]
    _, (cut,) = keys_at_ranks(df, levels, [digest, F.col(key)], lambda total: (n,))
    if cut is None:
        return df
    at, last = F.lit(cut[0]), F.lit(cut[1])
    return df.where((digest < at) | ((digest == at) & (F.col(key) < last)))


def concat(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b), parts)
