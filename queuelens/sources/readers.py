"""Readers of job logs and scoring requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from queuelens.schema import JOB_SCHEMA, REQUEST_SCHEMA

TIME_COLUMNS = ("submit_time", "start_time", "end_time")


def path_exists(spark: SparkSession, path: str) -> bool:
    """True if the path or glob names at least one file, on any file system Hadoop can reach."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def is_file(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(hadoop_path) and system.getFileStatus(hadoop_path).isFile()


def _must_exist(spark: SparkSession, path: str) -> None:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"data file not found: {path}")


def conform(df: DataFrame, schema: T.StructType = JOB_SCHEMA) -> DataFrame:
    """Casts the known columns a table has; whole numbers in time columns are epoch seconds."""
    columns = []
    for f in schema.fields:
        if f.name not in df.columns:
            continue
        c = F.col(f"`{f.name}`")
        if f.name in TIME_COLUMNS and isinstance(df.schema[f.name].dataType, (T.IntegralType, T.FractionalType)):
            c = F.timestamp_seconds(c)
        columns.append(c.cast(f.dataType).alias(f.name))
    return df.select(*columns)


def scan_jobs(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet job log; an absent path is an error. Columns a log lacks stay absent."""
    _must_exist(spark, path)
    return conform(spark.read.parquet(path))


def _csv_schema(epoch_times: bool) -> T.StructType:
    def kind(f: T.StructField) -> T.DataType:
        return T.LongType() if epoch_times and f.name in TIME_COLUMNS else f.dataType

    return T.StructType([T.StructField(f.name, kind(f)) for f in JOB_SCHEMA.fields])


def scan_csv(spark: SparkSession, path: str, epoch_times: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """A CSV job log with a header, plain or compressed (bz2 files are split between tasks)."""
    _must_exist(spark, path)
    wanted = schema or _csv_schema(epoch_times)
    return conform(spark.read.option("header", True).option("enforceSchema", False).schema(wanted).csv(path))


def scan_json(spark: SparkSession, path: str, schema: T.StructType = JOB_SCHEMA) -> DataFrame:
    _must_exist(spark, path)
    return spark.read.schema(schema).json(path)


def scan_request_csv(spark: SparkSession, path: str) -> DataFrame:
    """An uploaded request file; a row that cannot be read keeps its text in `_corrupt`."""
    _must_exist(spark, path)
    schema = T.StructType([*REQUEST_SCHEMA.fields, T.StructField("_corrupt", T.StringType())])
    return (
        spark.read.option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .schema(schema)
        .csv(path)
    )


def pick_source(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    """The best log in a data folder: full Parquet, full compressed CSV, then a sample CSV."""
    choices = [
        ("full", f"{folder}/full/*.parquet", scan_jobs),
        ("full-csv", f"{folder}/full/*.csv.bz2", scan_csv),
        ("sample", f"{folder}/sample/*.csv", scan_csv),
    ]
    for kind, path, read in choices:
        if path_exists(spark, path):
            return kind, read(spark, path)
    raise FileNotFoundError(f"no suitable data files in {folder}")


def stream_source(
    spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files_per_trigger: int = 64, **options: str
) -> DataFrame:
    """A folder that receives request files (or one such file), as a stream.

    Files come by modification time, `files_per_trigger` a micro-batch; `in_time_order` writes a folder whose
    files are then in event order. `kind='kafka'` reads JSON messages from a topic instead.
    """
    reader = spark.readStream
    if kind == "kafka":
        raw = reader.format("kafka").options(**options).option("subscribe", path).load()
        return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")
    if is_file(spark, path):
        path, _, name = path.rpartition("/")
        reader = reader.option("pathGlobFilter", name)
    return reader.schema(schema).option("maxFilesPerTrigger", files_per_trigger).options(**options).format(kind).load(path)


def in_time_order(df: DataFrame, time: str, path: str, files: int) -> str:
    """Writes `df` as about `files` Parquet files that `stream_source` reads in the order of `time`.

    Each file holds a range of times, and rows of one time share a file. A parallel write leaves modification
    times in any order, so they are set afterwards, one call a file; a file system that doesn't keep them
    is refused, as a watermark would drop rows there.
    """
    df.repartitionByRange(files, time).write.mode("errorifexists").parquet(path)
    spark = df.sparkSession
    parts = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/part-*")
    system = parts.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def listed():
        return sorted(system.globStatus(parts), key=lambda f: int(f.getPath().getName().split("-")[1]))

    found = listed()
    first = max((f.getModificationTime() for f in found), default=0)
    for i, f in enumerate(found):
        system.setTimes(f.getPath(), first + 10 * i, -1)
    times = [f.getModificationTime() for f in listed()]
    if any(later <= earlier for earlier, later in zip(times, times[1:])):
        raise RuntimeError(f"the file system of {path} keeps no modification times, so files can't be put in order")
    return path
