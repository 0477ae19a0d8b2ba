"""Sinks for job logs, scored rows and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from queuelens.sources.readers import scan_csv

# Text formats cut timestamps to milliseconds unless told otherwise.
MICROSECONDS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def sink_parquet(df: DataFrame, path: str, by_month: bool = False, mode: str = "errorifexists") -> str:
    """Writes a job log, optionally one folder per submission month so that readers can prune."""
    if by_month:
        df = df.withColumn("submit_month", F.date_format("submit_time", "yyyy-MM"))
        df.write.mode(mode).partitionBy("submit_month").parquet(path)
    else:
        df.write.mode(mode).parquet(path)
    return path


def csv_to_parquet(spark: SparkSession, source: str, target: str, epoch_times: bool = False) -> str:
    """Converts a CSV log, plain or compressed, to Parquet by submission month."""
    return sink_parquet(scan_csv(spark, source, epoch_times), target, by_month=True)


def sink_csv(df: DataFrame, path: str, compression: str | None = None, mode: str = "errorifexists") -> str:
    writer = df.write.mode(mode).option("header", True).option("timestampFormat", MICROSECONDS)
    if compression:
        writer = writer.option("compression", compression)
    writer.csv(path)
    return path


def sink_json(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.write.mode(mode).option("timestampFormat", MICROSECONDS).json(path)
    return path


def sink_results_csv(results: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Scored rows as CSV; nested columns become JSON text."""
    flat = [
        F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("map", "struct", "array") else F.col(f"`{f.name}`")
        for f in results.schema.fields
    ]
    return sink_csv(results.select(*flat), path, mode=mode)


def stream_sink(df: DataFrame, path: str, checkpoint: str, drain: bool = True) -> StreamingQuery:
    """Appends each micro-batch to a Parquet folder, exactly once per file commit log."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if drain:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def ledger_sink(df: DataFrame, path: str, checkpoint: str, run: str, kind: str = "parquet", drain: bool = True) -> StreamingQuery:
    """Puts each micro-batch, exactly once, into a folder of `kind` that has no commit log of its own.

    A batch overwrites its own folder, `rows/run=<run>/batch=<id>`, and is then entered in the ledger with its
    row count. If a run fails anywhere in between, Spark gives it the same batch again: the same folder is
    overwritten and the entry renewed. `read_ledgered` shows entered batches alone. `run` names the checkpoint:
    batch ids begin again with a new one, which needs a name of its own.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        target = f"{path}/rows/run={run}/batch={batch_id}"
        batch.write.mode("overwrite").format(kind).save(target)
        written = batch.sparkSession.read.schema(batch.schema).format(kind).load(target)
        _enter(written.agg(F.count(F.lit(1)).alias("n_rows")), f"{path}/ledger/run={run}/batch={batch_id}")

    writer = df.writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint)
    if drain:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _enter(entry: DataFrame, path: str) -> None:
    entry.withColumn("entered_at", F.current_timestamp()).write.mode("overwrite").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(run, batch, n_rows, entered_at): one row per batch that `ledger_sink` has finished."""
    entries = spark.read.schema("n_rows bigint, entered_at timestamp, run string, batch bigint").parquet(f"{path}/ledger")
    return entries.select("run", "batch", "n_rows", "entered_at")


def read_ledgered(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet") -> DataFrame:
    """The rows of the batches in the ledger, with their `run` and `batch`."""
    placed = T.StructType([*schema.fields, T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())])
    rows = spark.read.schema(placed).format(kind).load(f"{path}/rows")
    return rows.join(read_ledger(spark, path).select("run", "batch"), ["run", "batch"], "left_semi")


def dropped_late(query: StreamingQuery) -> int:
    """How many rows came later than the watermark, over the progress reports that Spark still holds.

    Spark counts what reaches the state: for windowed counts, the late rows after partial aggregation.
    """
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
