"""Lookups of fitted statistics.

None of the looked-up tables is broadcast by hint: they grow with the number of users or queues.
Saved as tables they carry their real size, so Catalyst broadcasts them below the session's
threshold and otherwise shuffles both sides, where adaptive execution splits a hot user.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from queuelens.functions.reports import feature_key
from queuelens.operators.scalars import only_row
from queuelens.schema import REQUEST_KEY


def join_user_stats(
    df: DataFrame, users: DataFrame, train_mean_runtime: Column | float, heavy: DataFrame | None = None, spread: Sequence[str] = ("job_id",)
) -> DataFrame:
    """Adds a user's mean run time, job count, accuracy and, where the table has it, frequency.

    Unseen users take the defaults. With `heavy` (see `salted_lookup`) the rows of frequent users are dealt to many tasks.
    """
    default = train_mean_runtime if isinstance(train_mean_runtime, Column) else F.lit(train_mean_runtime)
    looked_up = {
        "runtime_mean": ("user_mean_runtime", default),
        "job_count": ("user_job_count", F.lit(1).cast("bigint")),
        "accuracy": ("user_accuracy_score", F.lit(1.0)),
    }
    if "rows" in users.columns:
        looked_up["rows"] = ("user_frequency", F.lit(1).cast("bigint"))
    found = users.select("user", *[F.col(c).alias(f"_{c}") for c in looked_up])
    joined = df.join(found, "user", "left") if heavy is None else salted_lookup(df, found, "user", heavy, spread)
    return joined.withColumns(
        {name: F.coalesce(f"_{c}", fallback) for c, (name, fallback) in looked_up.items()}
    ).drop(*[f"_{c}" for c in looked_up])


def _salts(heavy: DataFrame, key: str, partitions: int) -> DataFrame:
    # Sixteen salts for each partition that the key would fill: hashed salts then fill the partitions evenly.
    salts = F.greatest(F.ceil(F.col("share") * 16 * partitions), F.lit(1)).cast("int")
    named = heavy.groupBy(key).agg(F.max("share").alias("share")).select(F.col(key).alias("_key"), salts.alias("_salts"))
    return F.broadcast(named)  # bounded: a sketch names at most some thousand keys


def dealt_rows(df: DataFrame, key: str, heavy: DataFrame, spread: Sequence[str], partitions: int) -> DataFrame:
    """Adds `_salt`: the rows of a frequent key, and those without a key, get many by a hash of `spread`, others 0.

    `heavy` (`key`, share) names the frequent keys, as `sketches.heavy_keys` finds them. A task run again deals its rows alike.
    """
    named = df.join(_salts(heavy, key, partitions), df[key] == F.col("_key"), "left").drop("_key")
    salts = F.when(F.col(key).isNull(), F.lit(16 * partitions)).otherwise(F.coalesce("_salts", F.lit(1)))
    return named.withColumn("_salt", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop("_salts")


def copied_rows(table: DataFrame, key: str, heavy: DataFrame, partitions: int) -> DataFrame:
    """`table` with a copy for each `_salt` that `dealt_rows` gives its key: together at most 16 a partition more."""
    named = table.join(_salts(heavy, key, partitions), table[key] == F.col("_key"), "left").drop("_key")
    return named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")


def dealt_join(dealt: DataFrame, copied: DataFrame, key: str) -> DataFrame:
    """The left join of rows that were dealt with a table that was copied."""
    right = copied.withColumnsRenamed({key: "_looked", "_salt": "_copy"})
    same = (F.col(key) == F.col("_looked")) & (F.col("_salt") == F.col("_copy"))
    return dealt.join(right, same, "left").drop("_looked", "_salt", "_copy")


def salted_lookup(
    df: DataFrame, table: DataFrame, key: str, heavy: DataFrame, spread: Sequence[str], partitions: int | None = None
) -> DataFrame:
    """`df` left-joined with `table` (one row for each `key`), where no frequent key is one task's work.

    `heavy` only steers the work: keys that it misses, or names wrongly, get the same rows.
    """
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt_join(dealt_rows(df, key, heavy, spread, partitions), copied_rows(table, key, heavy, partitions), key)


def join_queue_load(df: DataFrame, queues: DataFrame) -> DataFrame:
    """Adds how many jobs the queue got in that hour of the day; 0 if never seen."""
    found = queues.select("partition", "submit_hour", F.col("job_count").alias("_load"))
    keyed = df.withColumn("submit_hour", F.hour("submit_time"))
    return keyed.join(found, ["partition", "submit_hour"], "left").withColumn(
        "queue_load", F.coalesce("_load", F.lit(0).cast("bigint"))
    ).drop("_load")


def join_dictionary(
    df: DataFrame, codes: DataFrame, column: str, output: str, unknown: int = -1
) -> DataFrame:
    """Replaces a value by its code from a (column, value, code) table."""
    found = codes.where(F.col("column") == column).select(F.col("value").alias(column), F.col("code").alias("_code"))
    return df.join(found, column, "left").withColumn(output, F.coalesce("_code", F.lit(unknown))).drop("_code")


def join_thresholds(df: DataFrame, thresholds: DataFrame, flags: dict[str, tuple[str, str]]) -> DataFrame:
    """0/1 flags `name: (column, threshold)` against a one-row table of thresholds."""
    cut = only_row(thresholds)
    return df.withColumns(
        {name: F.coalesce((F.col(c) > cut[t]).cast("int"), F.lit(0)) for name, (c, t) in flags.items()}
    )


def score_distinct(
    df: DataFrame, score: Callable[[DataFrame], DataFrame], outputs: Sequence[str], key: Sequence[str] = REQUEST_KEY
) -> DataFrame:
    """Scores each distinct request once and gives the answer to all its copies."""
    keyed = df.withColumn("feature_key", feature_key(list(key)))
    once = keyed.select("feature_key", *key).distinct()  # the key fields determine the digest
    answers = score(once).select("feature_key", *outputs)
    return keyed.join(answers, "feature_key", "left")


def reuse_ratio(df: DataFrame, key: Sequence[str] = REQUEST_KEY) -> DataFrame:
    """Requests, distinct requests, and the share that an earlier answer could serve."""
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    totals = per_key.agg(F.sum("n").alias("requests"), F.count(F.lit(1)).alias("distinct_requests"))
    share = F.lit(1.0) - F.try_divide(F.col("distinct_requests").cast("double"), F.col("requests").cast("double"))
    return totals.withColumn("hit_ratio", share)
