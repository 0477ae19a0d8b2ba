"""Cleaning, validation and shaping of job logs and scoring requests."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from queuelens.operators.quantiles import exact_quantiles
from queuelens.operators.scalars import only_row, unpivot_row

# Default cleaning bounds (seconds, quantile).
MIN_RUNTIME = 10
MAX_RUNTIME = 604_800
TRIM_QUANTILE = 0.995

# What an uploaded request file must hold.
REQUEST_COLUMNS = {
    "cpus_req": "int",
    "nodes_req": "int",
    "mem_req": "float",
    "walltime_req": "float",
    "partition": "str",
    "qos": "str",
}


# --- uploaded requests ---------------------------------------------------------------------


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """`df` itself, or one error that names every missing column. No data is read."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def required_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Per required column: is it there, and in how many rows is it filled."""
    present = set(df.columns)
    counts = df.agg(
        *[(F.count(F.col(f"`{c}`")) if c in present else F.lit(0).cast("bigint")).alias(c) for c in required],
        F.count(F.lit(1)).alias("_rows"),
    )
    parts = {c: [F.lit(c in present), F.col(c)] for c in required}
    return unpivot_row(counts, "column", parts, ["present", "filled"])


def coerce_numeric(df: DataFrame, ints: Sequence[str] = (), floats: Sequence[str] = ()) -> DataFrame:
    """Unreadable numbers become 0; whole-number columns drop their fraction."""
    number = {c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in (*ints, *floats)}
    return df.withColumns(
        {**{c: number[c].try_cast("bigint") for c in ints}, **{c: number[c] for c in floats}}
    )


def csv_check_report(df: DataFrame, columns: dict[str, str] = REQUEST_COLUMNS) -> DataFrame:
    """One row per column of an uploaded file: bad values and whether it passes, in one pass."""
    bad = {}
    for c, kind in columns.items():
        if c not in df.columns:
            continue
        if kind == "str":
            bad[c] = F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(False))
        else:
            number = F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
            bad[c] = (F.floor(number) if kind == "int" else number) <= 0
    counts = df.agg(*[F.count_if(b).alias(c) for c, b in bad.items()], F.count(F.lit(1)).alias("_rows"))
    message = {
        "int": "must contain positive integers",
        "float": "must contain positive numbers",
        "str": "cannot contain empty values",
    }
    parts = {}
    for c, kind in columns.items():
        if c in bad:
            parts[c] = [F.col(c), F.col(c) == 0, F.when(F.col(c) > 0, F.lit(message[kind]))]
        else:
            parts[c] = [F.lit(None).cast("bigint"), F.lit(False), F.lit("missing")]
    return unpivot_row(counts, "column", parts, ["bad", "passes", "error"])


def normalise_request(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Uploaded names to job-log names, with the client's defaults for what is not given."""
    as_of = as_of if as_of is not None else F.current_timestamp()

    def given(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)

    submitted = F.coalesce(F.col("submit_time"), as_of) if "submit_time" in df.columns else as_of
    renamed = {"cpus_req", "walltime_req", "nodes_req", "mem_req", "partition", "qos", "submit_time"}
    return df.select(
        *[c for c in df.columns if c not in renamed],
        given("cpus_req", 1).cast("int").alias("processors_req"),
        given("nodes_req", 1).cast("int").alias("nodes_req"),
        given("mem_req", 1.0).alias("mem_req"),
        given("walltime_req", 3600.0).alias("wallclock_req"),
        given("partition", "default").alias("partition"),
        given("qos", "normal").alias("qos"),
        submitted.alias("submit_time"),
    )


def convert_units(df: DataFrame, mem_gb: str = "mem_gb", hours: str = "walltime_hours") -> DataFrame:
    """Memory in GB to MB, and hours to whole seconds."""
    return df.withColumns(
        {"mem_req": F.col(mem_gb) * F.lit(1024.0), "walltime_req": (F.col(hours) * F.lit(3600.0)).cast("int")}
    )


def serving_defaults(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """A request as a full job row; what the request itself gives (user, times) is kept.

    Its index in the batch serves as job id, 0 where it has none.
    """
    as_of = as_of if as_of is not None else F.current_timestamp()
    fixed = {
        "user": F.lit("unknown"),
        "account": F.lit("default"),
        "name": F.lit("job"),
        "gpus_req": F.lit(0),
        "state": F.lit("PENDING"),
        "run_time": F.lit(0).cast("bigint"),
        "submit_time": as_of,
    }
    df = df.withColumns({c: F.coalesce(F.col(c), d) if c in df.columns else d for c, d in fixed.items()})
    if "start_time" not in df.columns:
        df = df.withColumn("start_time", F.col("submit_time"))
    if "job_id" not in df.columns:
        df = df.withColumn("job_id", (F.col("idx") if "idx" in df.columns else F.lit(0)).cast("bigint"))
    return df


def valid_request() -> Column:
    """True where a request may be scored; a missing value makes it invalid."""
    rule = (
        (F.col("processors_req") > 0)
        & (F.col("nodes_req") > 0)
        & (F.col("mem_req") >= 0)
        & (F.col("wallclock_req") > 0)
        & (F.col("partition") != "")
        & (F.col("qos") != "")
    )
    return F.coalesce(rule, F.lit(False))


def skip_invalid(df: DataFrame) -> DataFrame:
    return df.where(valid_request())


def invalid_only(df: DataFrame) -> DataFrame:
    return df.where(~valid_request())


def batch_verdicts(df: DataFrame, batch: str = "batch_id", index: str = "idx") -> DataFrame:
    """Per batch: size, lowest bad index (NULL if none), accepted or not."""
    return df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("batch_size"),
        F.min(F.when(~valid_request(), F.col(index))).alias("first_bad_index"),
    ).withColumn("accepted", F.col("first_bad_index").isNull())


def reject_batches(df: DataFrame, batch: str = "batch_id", index: str = "idx") -> DataFrame:
    """Rows of the batches that hold no bad row."""
    bad = df.where(~valid_request()).select(batch).distinct()
    return df.join(bad, batch, "left_anti")


# --- job log -------------------------------------------------------------------------------


def positive_runtime(df: DataFrame) -> DataFrame:
    return df.where(F.col("run_time") > 0)


def runtime_bounds(df: DataFrame, low: int = MIN_RUNTIME, high: int = MAX_RUNTIME) -> DataFrame:
    return df.where(F.col("run_time").between(low, high))


def _resources_ok() -> Column:
    return (F.col("processors_req") > 0) & (F.col("nodes_req") > 0) & (F.col("mem_req") >= 0)


def resource_bounds(df: DataFrame) -> DataFrame:
    return df.where(_resources_ok())


def trim_thresholds(df: DataFrame, q_processors: float = TRIM_QUANTILE, q_memory: float = TRIM_QUANTILE) -> DataFrame:
    """One row: the largest processor and memory requests kept."""
    found = exact_quantiles(df, {"processors_req": [q_processors], "mem_req": [q_memory]})
    return found.select(F.col("processors_req")[0].alias("max_processors"), F.col("mem_req")[0].alias("max_mem"))


def _trim(df: DataFrame, max_processors: Column, max_mem: Column) -> DataFrame:
    return df.where((F.col("processors_req") <= max_processors) & (F.col("mem_req") <= max_mem))


def trim_percentile(
    df: DataFrame,
    q_processors: float = TRIM_QUANTILE,
    q_memory: float = TRIM_QUANTILE,
) -> DataFrame:
    """Drops oversized requests; both cuts are taken before either is applied."""
    cut = only_row(trim_thresholds(df, q_processors, q_memory))
    return _trim(df, cut["max_processors"], cut["max_mem"])


def completed_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("state") == "COMPLETED") if "state" in df.columns else df


def sane_jobs(df: DataFrame, low: int = MIN_RUNTIME, high: int = MAX_RUNTIME) -> DataFrame:
    """The row-local part of cleaning."""
    return resource_bounds(runtime_bounds(positive_runtime(df), low, high))


def clean_jobs(
    df: DataFrame,
    low: int = MIN_RUNTIME,
    high: int = MAX_RUNTIME,
    q_processors: float = TRIM_QUANTILE,
    q_memory: float = TRIM_QUANTILE,
) -> DataFrame:
    """Run-time bounds, resource bounds, trimming, then completed jobs only."""
    return completed_only(trim_percentile(sane_jobs(df, low, high), q_processors, q_memory))


def fixed_cuts(df: DataFrame, low: int = MIN_RUNTIME, high: int = MAX_RUNTIME) -> dict[str, Column]:
    """The trimming cuts of a log, looked up now and set as constants; 0 where no row has a finite request, so that none is kept."""
    cut = trim_thresholds(sane_jobs(df, low, high)).first()
    return {name: F.lit(0.0 if cut[name] is None else cut[name]) for name in ("max_processors", "max_mem")}


def clean_jobs_fixed(
    df: DataFrame, low: int = MIN_RUNTIME, high: int = MAX_RUNTIME, cuts: dict[str, Column] | None = None
) -> DataFrame:
    """The same rows, with the trimming cuts looked up now (or given) and set as constants.

    For a caller that reads the result several times: every read is then a plain filtered scan.
    """
    cuts = cuts or fixed_cuts(df, low, high)
    return completed_only(_trim(sane_jobs(df, low, high), cuts["max_processors"], cuts["max_mem"]))


def _funnel_counts(df: DataFrame, low: int, high: int, cut) -> dict[str, Column]:
    """How many rows each cleaning stage leaves, as aggregates by the stage's name."""
    stages = {
        "input": F.lit(True),
        "positive_runtime": F.col("run_time") > 0,
        "runtime_bounds": F.col("run_time").between(low, high),
        "resource_bounds": _resources_ok(),
        "trim_percentile": (F.col("processors_req") <= cut["max_processors"]) & (F.col("mem_req") <= cut["max_mem"]),
    }
    if "state" in df.columns:
        stages["completed_only"] = F.col("state") == "COMPLETED"
    passed, counts = F.lit(True), {}
    for name, rule in stages.items():
        passed = passed & rule
        counts[name] = F.count_if(passed).alias(name)
    return counts


def clean_funnel(df: DataFrame, low: int = MIN_RUNTIME, high: int = MAX_RUNTIME) -> DataFrame:
    """Rows left after each cleaning stage, counted in one pass."""
    counts = _funnel_counts(df, low, high, only_row(trim_thresholds(sane_jobs(df, low, high))))
    parts = {name: [F.lit(i), F.col(name)] for i, name in enumerate(counts)}
    return unpivot_row(df.agg(*counts.values()), "stage", parts, ["position", "rows_kept"])


def observed_clean(
    df: DataFrame, cuts: dict[str, Column], low: int = MIN_RUNTIME, high: int = MAX_RUNTIME
) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """The cleaned rows, and a function for the funnel (stage, position, rows_kept).

    The stages are counted by the first job that reads the rows to their end, usually the one that stores them; the
    function waits for that job and costs no scan of its own. Spark observes nothing where a plan is empty from the start; that is 0.
    """
    counts, seen = _funnel_counts(df, low, high, cuts), Observation()
    rows = clean_jobs_fixed(df.observe(seen, *counts.values()), low, high, cuts)

    def funnel() -> DataFrame:
        found = {} if df.isEmpty() else seen.get
        left = [(name, i, found.get(name, 0)) for i, name in enumerate(counts)]
        return df.sparkSession.createDataFrame(left, "stage string, position int, rows_kept bigint")

    return rows, funnel


def quality_report(df: DataFrame, longest: int = 30 * 86_400) -> DataFrame:
    """Rows that break each documented data-quality rule, in one pass."""
    required = [
        "job_id", "user", "account", "name", "state", "partition", "qos", "submit_time", "start_time",
        "end_time", "run_time", "wallclock_req", "nodes_req", "processors_req", "mem_req",
    ]
    rules = {f"missing_{c}": F.col(f"`{c}`").isNull() for c in required if c in df.columns}
    rules |= {
        "runtime_not_positive": F.col("run_time") <= 0,
        "runtime_over_30_days": F.col("run_time") > longest,
        "start_before_submit": F.col("start_time") < F.col("submit_time"),
        "end_before_start": F.col("end_time") < F.col("start_time"),
        "processors_not_positive": F.col("processors_req") <= 0,
        "nodes_not_positive": F.col("nodes_req") <= 0,
        "memory_negative": F.col("mem_req") < 0,
        "walltime_not_positive": F.col("wallclock_req") <= 0,
        "gpus_negative": F.col("gpus_req") < 0,
    }
    counts = df.agg(*[F.count_if(r).alias(n) for n, r in rules.items()], F.count(F.lit(1)).alias("total"))
    return unpivot_row(counts, "rule", {n: [F.col(n), F.col("total")] for n in rules}, ["bad", "total"])


def select_features(df: DataFrame, wanted: Sequence[str], keep: Sequence[str] = (), fill_missing: bool = False) -> DataFrame:
    """The wanted columns in order. Absent ones are left out, or 0 when scoring."""
    have = set(df.columns)
    columns = [F.col(c) if c in have else F.lit(0).alias(c) for c in wanted if c in have or fill_missing]
    return df.select(*keep, *columns)


def log_target(df: DataFrame, target: str = "run_time", use_log: bool = True, name: str = "label") -> DataFrame:
    y = F.col(target).cast("double")
    return df.withColumn(name, F.log1p(y) if use_log else y)


def narrow_type(lo: Column, hi: Column) -> Column:
    """The narrowest integer type that holds a range."""
    unsigned = F.when(hi < 255, "uint8").when(hi < 65535, "uint16").when(hi < 4294967295, "uint32").otherwise("int64")
    signed = (
        F.when((lo > -128) & (hi < 127), "int8")
        .when((lo > -32768) & (hi < 32767), "int16")
        .when((lo > -2147483648) & (hi < 2147483647), "int32")
        .otherwise("int64")
    )
    return F.when(lo >= 0, unsigned).otherwise(signed)


def profile_schema(df: DataFrame) -> DataFrame:
    """Per column: range, share of distinct text values, and the narrowest fitting type."""
    aggs, parts = [F.count(F.lit(1)).alias("_rows")], {}
    none = F.lit(None).cast("double")
    for field in df.schema.fields:
        c, kind = field.name, field.dataType
        col = F.col(f"`{c}`")
        if isinstance(kind, T.IntegralType):
            aggs += [F.min(col).alias(f"{c}_min"), F.max(col).alias(f"{c}_max")]
            lo, hi = F.col(f"{c}_min"), F.col(f"{c}_max")
            parts[c] = [lo.cast("double"), hi.cast("double"), none, narrow_type(lo, hi)]
        elif isinstance(kind, T.FractionalType):
            aggs += [F.min(col).alias(f"{c}_min"), F.max(col).alias(f"{c}_max")]
            parts[c] = [F.col(f"{c}_min").cast("double"), F.col(f"{c}_max").cast("double"), none, F.lit("float32")]
        elif isinstance(kind, T.StringType):
            aggs.append(F.count_distinct(col).alias(f"{c}_distinct"))
            share = F.try_divide(F.col(f"{c}_distinct").cast("double"), F.col("_rows").cast("double"))
            parts[c] = [none, none, share, F.when(share < 0.5, "category").otherwise("string")]
    return unpivot_row(df.agg(*aggs), "column", parts, ["min_value", "max_value", "distinct_share", "suggested"])
