"""Layouts that later reads profit from: files a lookup can skip, and buckets that a join needs no shuffle for."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from queuelens.operators.joins import copied_rows, dealt_join, dealt_rows
from queuelens.session import TIMESTAMP_TYPE, scratch_path


def clustered_parquet(
    df: DataFrame, path: str, files: int, key: str = "user", time: str = "submit_time", unit: str = "day",
    filtered: Sequence[str] = ("user", "job_id"), distinct: int = 100_000, row_group_mb: int = 128,
) -> str:
    """Writes a log as about `files` files, ranged by (`unit` of `time`, `key`, `time`), with Bloom filters on `filtered`.

    A time range is a run of files; a key has its rows of a day side by side, so the smallest and largest key of a row
    group tell nearly all others apart; a value that no order helps with, such as a job id, is told by the
    filters. `distinct` is the number of values that a row group's filter is sized for (1 % are wrongly read there).
    Ranges are cut by all of the columns, so neither a day nor a key has to fit a file.
    """
    ordered = [F.date_trunc(unit, time), F.col(key), F.col(time)]
    writer = df.repartitionByRange(files, *ordered).sortWithinPartitions(*ordered).write.mode("errorifexists")
    for column in filtered:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", distinct)
    conf = df.sparkSession.conf
    before = conf.get(TIMESTAMP_TYPE)
    conf.set(TIMESTAMP_TYPE, "TIMESTAMP_MICROS")  # whatever the session's own; 96-bit times can't be skipped by
    try:
        writer.option("parquet.block.size", row_group_mb << 20).parquet(path)
    finally:
        conf.set(TIMESTAMP_TYPE, before)
    return path


def bucketed(df: DataFrame, label: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Stores `df` in the shared folder as a table of buckets by `keys`, one file each, and reads it back.

    Two tables with as many buckets by the keys of a join are joined without a shuffle. The table is known to the
    session's catalog alone; its files stay until `session.discard`.
    """
    spark = df.sparkSession
    name = f"queuelens_{label}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", scratch_path(spark, label)).saveAsTable(name)
    return spark.table(name)


def colocated(
    df: DataFrame, table: DataFrame, key: str, heavy: DataFrame, spread: Sequence[str], buckets: int
) -> tuple[DataFrame, DataFrame]:
    """A log and a table (one row for each `key`), stored so that looking the key up moves neither: see `colocated_lookup`.

    A bucket is read by one task, so the rows of frequent keys (`heavy`, from `sketches.heavy_keys`) are dealt to many
    buckets and their row of the table is copied there.
    """
    keys = [key, "_salt"]
    return (
        bucketed(dealt_rows(df, key, heavy, spread, buckets), "log", keys, buckets),
        bucketed(copied_rows(table, key, heavy, buckets), "lookup", keys, buckets),
    )


def colocated_lookup(log: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The left join of what `colocated` stored."""
    return dealt_join(log, table, key)
