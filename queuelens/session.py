"""Session settings and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# The feature recipe compiles to methods over 8,000 bytecodes, which the JVM otherwise leaves to
# its interpreter (about half the speed on wide feature frames).
JVM_OPTIONS = "-XX:-DontCompileHugeMethods"

TIMESTAMP_TYPE = "spark.sql.parquet.outputTimestampType"

SESSION_CONF = {
    "spark.driver.extraJavaOptions": JVM_OPTIONS,
    "spark.executor.extraJavaOptions": JVM_OPTIONS,
    "spark.sql.session.timeZone": "UTC",
    # The older 96-bit times carry no smallest and largest value, so no reader could skip by time.
    TIMESTAMP_TYPE: "TIMESTAMP_MICROS",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app_name: str = "queuelens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; keyword settings win (dots as `__`)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by `spark.checkpoint.dir`.

    A machine-local folder is only used where the setting is missing and Spark itself runs
    in one process; on a cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="queuelens-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path for an intermediate table in the shared folder."""
    return f"{shared_folder(spark)}/queuelens/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of any executor, and gives Catalyst real
    file sizes, so a later join is broadcast only when the table is under the session's
    broadcast threshold.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def side_by_side(spark: SparkSession, *work: Callable[[], object]) -> list:
    """The results of independent pieces of work that are run at the same time; short jobs alone leave most cores idle."""
    run = inheritable_thread_target(spark)(lambda piece: piece())
    with ThreadPoolExecutor(len(work)) as pool:
        return list(pool.map(run, work))


def over_cores(df: DataFrame) -> DataFrame:
    """The rows of a scan, dealt out if its splits are fewer than the cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of queries that nothing refers to any more, which it does as the driver's memory is cleared."""
    spark._jvm.System.gc()
