"""Reading, writing, validating, cleaning and shaping the job log."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from queuelens import views
from queuelens.operators import aggregates, filters, reports, sketches, splits
from queuelens.operators.nested import flatten_request, nest_request
from queuelens.plans import partials, scoring
from queuelens.registry.catalog import (
    clean, jobs, out, query, rounded, sample_results, service_requests, split_funnel, split_table, state,
    train_rows, trained,
)
from queuelens.schema import JOB_SCHEMA, REQUEST_SCHEMA
from queuelens.session import materialize, scratch_path
from queuelens.sources import layout, models as model_store, readers, state as state_store, writers

JOB_COLUMNS = [f.name for f in JOB_SCHEMA.fields]
JOB_SQL = ", ".join(f'"{c}"' for c in JOB_COLUMNS)


def _store_jobs(spark, sf, kind):
    path = scratch_path(spark, f"log-{kind}")
    df = jobs(spark, sf)
    if kind == "parquet":
        return writers.sink_parquet(df, path)
    if kind == "json":
        return writers.sink_json(df, path)
    return writers.sink_csv(df, path, compression="bzip2")


# --- sources and sinks: each writes the whole derived log with a sink and reads it back -------


@query("scan_jobs", f"SELECT {JOB_SQL} FROM jobs")
def scan_jobs(spark, sf):
    return out(readers.scan_jobs(spark, _store_jobs(spark, sf, "parquet")), JOB_COLUMNS)


# An empty text field and a missing one are the same in CSV.
@query("scan_csv", f"SELECT {JOB_SQL} FROM jobs".replace('"qos"', "nullif(qos, '') AS qos"))
def scan_csv(spark, sf):
    return out(readers.scan_csv(spark, _store_jobs(spark, sf, "csv")), JOB_COLUMNS)


@query("scan_json", f"SELECT {JOB_SQL} FROM jobs")
def scan_json(spark, sf):
    return out(readers.scan_json(spark, _store_jobs(spark, sf, "json")), JOB_COLUMNS)


@query(
    "scan_request_csv",
    'SELECT processors_req AS cpus_req, nodes_req, mem_req, wallclock_req AS walltime_req, "partition", nullif(qos, \'\') AS qos FROM service_requests',
)
def scan_request_csv(spark, sf):
    columns = [f.name for f in REQUEST_SCHEMA.fields]
    path = writers.sink_csv(views.job_requests_from_jobs(jobs(spark, sf)).select(*columns), scratch_path(spark, "requests-csv"))
    return readers.scan_request_csv(spark, path).where(F.col("_corrupt").isNull()).select(*columns)


@query("pick_source", "SELECT 'full-csv' AS source, count(*) AS n, sum(CAST(run_time AS BIGINT))::BIGINT AS run_time FROM jobs")
def pick_source(spark, sf):
    folder = scratch_path(spark, "raw")
    writers.sink_csv(jobs(spark, sf), f"{folder}/full/jobs.csv.bz2", compression="bzip2")
    kind, df = readers.pick_source(spark, folder)
    return df.agg(F.lit(kind).alias("source"), F.count(F.lit(1)).alias("n"), F.sum("run_time").alias("run_time"))


@query(
    "csv_to_parquet",
    "SELECT strftime(submit_time, '%Y-%m') AS submit_month, job_id, run_time, submit_time FROM jobs",
)
def csv_to_parquet(spark, sf):
    target = writers.csv_to_parquet(spark, _store_jobs(spark, sf, "csv"), scratch_path(spark, "log-by-month"))
    stored = spark.read.schema(T.StructType([*JOB_SCHEMA.fields, T.StructField("submit_month", T.StringType())])).parquet(target)
    return out(stored, ["submit_month", "job_id", "run_time", "submit_time"])


@query(
    "clustered_layout",
    """SELECT date_trunc('day', submit_time)::DATE AS day, "user", count(*) AS jobs, CAST(sum(run_time) AS BIGINT) AS run_time
       FROM jobs GROUP BY 1, 2""",
)
def clustered_layout(spark, sf):
    path = layout.clustered_parquet(jobs(spark, sf), scratch_path(spark, "log-clustered"), spark.sparkContext.defaultParallelism)
    by_day = spark.read.schema(JOB_SCHEMA).parquet(path).groupBy(F.to_date("submit_time").alias("day"), "user")
    return by_day.agg(F.count(F.lit(1)).alias("jobs"), F.sum("run_time").alias("run_time"))


@query("sink_parquet", "SELECT job_id, state, run_time, mem_req, submit_time FROM jobs")
def sink_parquet(spark, sf):
    path = writers.sink_parquet(jobs(spark, sf), scratch_path(spark, "log"), by_month=True)
    return out(spark.read.parquet(path), ["job_id", "state", "run_time", "mem_req", "submit_time"])


@query(
    "sink_results_csv",
    "SELECT request_id, prediction_status, round(predicted_runtime, 6) AS predicted_runtime, runtime_category, error FROM sample_results",
)
def sink_results_csv(spark, sf):
    names = ["request_id", "prediction_status", "predicted_runtime", "runtime_category", "error"]
    path = writers.sink_results_csv(sample_results(spark, sf).select(*names), scratch_path(spark, "results"))
    schema = "request_id bigint, prediction_status string, predicted_runtime double, runtime_category string, error string"
    return rounded(spark.read.option("header", True).schema(schema).csv(path), "predicted_runtime")


@query(
    "save_load_features",
    """SELECT 'users' AS part, count(*) AS entries, round(sum(runtime_mean), 6) AS total FROM user_table
       UNION ALL SELECT 'queues', count(*), round(sum(job_count), 6) FROM queue_table
       UNION ALL SELECT 'codes', count(*), round(sum(code), 6) FROM code_table
       UNION ALL SELECT 'scaler', count(*), round(sum(center), 6) FROM scaler_params""",
)
def save_load_features(spark, sf):
    path = state_store.save_features(spark, state(spark, sf), scratch_path(spark, "feature-state"))
    loaded = state_store.load_features(spark, path)
    parts = {
        "users": (loaded.users, "runtime_mean"),
        "queues": (loaded.queues, "job_count"),
        "codes": (loaded.codes, "code"),
        "scaler": (state_store.scaler_table(spark, loaded), "center"),
    }
    rows = [
        df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("entries"), F.sum(F.col(c).cast("double")).alias("total"))
        for name, (df, c) in parts.items()
    ]
    return rounded(splits.concat(rows), "total")


@query(
    "merge_feature_state",
    """SELECT 'user' AS part, "user" AS entry, round(runtime_mean, 6) AS a, round(accuracy, 6) AS b FROM user_table WHERE "user" IS NOT NULL
       UNION ALL SELECT 'queue', concat("partition", '/', submit_hour), job_count, NULL FROM queue_table WHERE "partition" IS NOT NULL
       UNION ALL SELECT 'code', concat("column", '/', value), code, NULL FROM code_table
       UNION ALL SELECT 'scaler', feature, round(center, 6), round(scale, 6) FROM scaler_params""",
)
def merge_feature_state(spark, sf):
    """The state of all training days, each added on its own, as one table."""
    path = partials.add_slices(train_rows(spark, sf), scratch_path(spark, "state-slices"))
    merged = partials.merged_state(spark, path)
    rows = [
        merged.users.select(F.lit("user").alias("part"), F.col("user").alias("entry"), F.col("runtime_mean").alias("a"), F.col("accuracy").alias("b")),
        merged.queues.selectExpr("'queue' AS part", "concat(`partition`, '/', submit_hour) AS entry", "job_count AS a", "NULL AS b"),
        merged.codes.selectExpr("'code' AS part", "concat(column, '/', value) AS entry", "code AS a", "NULL AS b"),
        state_store.scaler_table(spark, merged).selectExpr("'scaler' AS part", "feature AS entry", "center AS a", "scale AS b"),
    ]
    return rounded(splits.concat([r.withColumns({c: F.col(c).cast("double") for c in "ab"}) for r in rows]), "a", "b")


@query("save_load_models")
def save_load_models(spark, sf):
    path = model_store.save_models(spark, trained(spark, sf), scratch_path(spark, "model"))
    scored = scoring.score_batch(service_requests(spark, sf), model_store.load_models(spark, path))
    return scored.select("request_id", "predicted_runtime", "model_version", "features_used")


# --- validation and shaping -------------------------------------------------------------------


@query(
    "required_columns",
    """SELECT c.name AS "column", c.name <> 'gpus_req' AS present,
         CASE c.name WHEN 'cpus_req' THEN count(processors_req) WHEN 'nodes_req' THEN count(nodes_req)
           WHEN 'mem_req' THEN count(mem_req) WHEN 'walltime_req' THEN count(wallclock_req)
           WHEN 'partition' THEN count("partition") WHEN 'qos' THEN count(qos) ELSE 0 END AS filled
       FROM service_requests CROSS JOIN (VALUES ('cpus_req'), ('nodes_req'), ('mem_req'), ('walltime_req'),
         ('partition'), ('qos'), ('gpus_req')) AS c(name) GROUP BY c.name""",
)
def required_columns(spark, sf):
    return filters.required_columns(views.job_requests_from_jobs(jobs(spark, sf)), [*filters.REQUEST_COLUMNS, "gpus_req"])


def _uploaded(spark, sf):
    """Requests as untyped text, with unreadable entries."""
    return views.job_requests_from_jobs(jobs(spark, sf)).select(
        "request_id",
        F.when(F.col("request_id") % 31 == 0, "n/a").otherwise(F.concat(F.col("cpus_req"), F.lit(".5"))).alias("cpus_req"),
        F.col("nodes_req").cast("string").alias("nodes_req"),
        F.when(F.col("request_id") % 37 == 0, "lots").otherwise(F.col("mem_req").cast("bigint").cast("string")).alias("mem_req"),
        F.col("walltime_req").cast("bigint").cast("string").alias("walltime_req"),
        "partition",
        F.when(F.col("qos") == "", "  ").otherwise(F.col("qos")).alias("qos"),
    )


UPLOADED = """SELECT request_id, CASE WHEN request_id % 31 = 0 THEN 'n/a' ELSE concat(processors_req, '.5') END AS cpus_req,
  CAST(nodes_req AS VARCHAR) AS nodes_req,
  CASE WHEN request_id % 37 = 0 THEN 'lots' ELSE CAST(CAST(mem_req AS BIGINT) AS VARCHAR) END AS mem_req,
  CAST(CAST(wallclock_req AS BIGINT) AS VARCHAR) AS walltime_req, "partition",
  CASE WHEN qos = '' THEN '  ' ELSE qos END AS qos FROM service_requests"""


@query(
    "coerce_numeric",
    f"""SELECT request_id, CAST(trunc(coalesce(try_cast(cpus_req AS DOUBLE), 0)) AS BIGINT) AS cpus_req,
          CAST(trunc(coalesce(try_cast(nodes_req AS DOUBLE), 0)) AS BIGINT) AS nodes_req,
          coalesce(try_cast(mem_req AS DOUBLE), 0) AS mem_req, coalesce(try_cast(walltime_req AS DOUBLE), 0) AS walltime_req
        FROM ({UPLOADED})""",
)
def coerce_numeric(spark, sf):
    df = filters.coerce_numeric(_uploaded(spark, sf), ["cpus_req", "nodes_req"], ["mem_req", "walltime_req"])
    return df.select("request_id", "cpus_req", "nodes_req", "mem_req", "walltime_req")


def _check_sql(column, bad, message):
    return f"""SELECT '{column}' AS "column", count(*) FILTER (WHERE {bad}) AS bad, count(*) FILTER (WHERE {bad}) = 0 AS passes,
      CASE WHEN count(*) FILTER (WHERE {bad}) > 0 THEN '{message}' END AS error FROM ({UPLOADED})"""


_number = "coalesce(try_cast({0} AS DOUBLE), 0)".format


@query(
    "csv_check_report",
    " UNION ALL ".join(
        [
            _check_sql("cpus_req", f"floor({_number('cpus_req')}) <= 0", "must contain positive integers"),
            _check_sql("nodes_req", f"floor({_number('nodes_req')}) <= 0", "must contain positive integers"),
            _check_sql("mem_req", f"{_number('mem_req')} <= 0", "must contain positive numbers"),
            _check_sql("walltime_req", f"{_number('walltime_req')} <= 0", "must contain positive numbers"),
            _check_sql("partition", "trim(\"partition\") = ''", "cannot contain empty values"),
            _check_sql("qos", "trim(qos) = ''", "cannot contain empty values"),
        ]
    ),
)
def csv_check_report(spark, sf):
    return filters.csv_check_report(_uploaded(spark, sf))


@query("valid_request", "SELECT request_id, valid FROM service_requests")
def valid_request(spark, sf):
    return service_requests(spark, sf).select("request_id", filters.valid_request().alias("valid"))


@query(
    "reject_batch",
    """SELECT batch_id, count(*) AS batch_size, min(CASE WHEN NOT valid THEN idx END) AS first_bad_index,
         count(*) FILTER (WHERE NOT valid) = 0 AS accepted FROM service_requests GROUP BY batch_id""",
)
def reject_batch(spark, sf):
    return filters.batch_verdicts(service_requests(spark, sf))


@query(
    "accepted_batches",
    """SELECT request_id, request_id // 10 AS batch_id FROM service_requests
       WHERE request_id // 10 NOT IN (SELECT request_id // 10 FROM service_requests WHERE NOT valid)""",
)
def accepted_batches(spark, sf):
    """Batches of ten, so that some hold no bad row."""
    small = service_requests(spark, sf).withColumn("batch_id", F.expr("request_id div 10"))
    return filters.reject_batches(small).select("request_id", "batch_id")


@query("skip_invalid", "SELECT request_id, batch_id, idx FROM service_requests WHERE valid")
def skip_invalid(spark, sf):
    return filters.skip_invalid(service_requests(spark, sf)).select("request_id", "batch_id", "idx")


@query("invalid_side_output", "SELECT request_id, batch_id, idx FROM service_requests WHERE NOT valid")
def invalid_side_output(spark, sf):
    return filters.invalid_only(service_requests(spark, sf)).select("request_id", "batch_id", "idx")


@query("positive_runtime", "SELECT job_id, run_time FROM jobs WHERE run_time > 0")
def positive_runtime(spark, sf):
    return filters.positive_runtime(jobs(spark, sf)).select("job_id", "run_time")


@query("runtime_bounds", "SELECT job_id, run_time FROM jobs WHERE run_time BETWEEN 10 AND 604800")
def runtime_bounds(spark, sf):
    return filters.runtime_bounds(jobs(spark, sf)).select("job_id", "run_time")


@query(
    "resource_bounds",
    "SELECT job_id, processors_req, nodes_req, mem_req FROM jobs WHERE processors_req > 0 AND nodes_req > 0 AND mem_req >= 0",
)
def resource_bounds(spark, sf):
    return filters.resource_bounds(jobs(spark, sf)).select("job_id", "processors_req", "nodes_req", "mem_req")


@query(
    "trim_percentile",
    """SELECT job_id, processors_req, mem_req, state FROM sane_jobs, trim_cut
       WHERE processors_req <= max_processors AND mem_req <= max_mem""",
)
def trim_percentile(spark, sf):
    kept = filters.trim_percentile(filters.sane_jobs(jobs(spark, sf)))
    return kept.select("job_id", "processors_req", "mem_req", "state")


@query("completed_only", "SELECT job_id, state FROM jobs WHERE state = 'COMPLETED'")
def completed_only(spark, sf):
    return filters.completed_only(jobs(spark, sf)).select("job_id", "state")


@query("clean_jobs", f"SELECT {JOB_SQL} FROM clean_jobs")
def clean_jobs(spark, sf):
    return out(filters.clean_jobs(jobs(spark, sf)), JOB_COLUMNS)


_FUNNEL_SQL = """SELECT 'input' AS stage, CAST(0 AS INTEGER) AS position, count(*) AS rows_kept FROM jobs
   UNION ALL SELECT 'positive_runtime', 1, count(*) FROM jobs WHERE run_time > 0
   UNION ALL SELECT 'runtime_bounds', 2, count(*) FROM jobs WHERE run_time BETWEEN 10 AND 604800
   UNION ALL SELECT 'resource_bounds', 3, count(*) FROM sane_jobs
   UNION ALL SELECT 'trim_percentile', 4, count(*) FROM sane_jobs, trim_cut WHERE processors_req <= max_processors AND mem_req <= max_mem
   UNION ALL SELECT 'completed_only', 5, count(*) FROM clean_jobs"""


@query("clean_funnel", _FUNNEL_SQL)
def clean_funnel(spark, sf):
    return filters.clean_funnel(jobs(spark, sf))


@query("observed_funnel", _FUNNEL_SQL)
def observed_funnel(spark, sf):
    return split_funnel(spark, sf)


_missing = [
    "job_id", "user", "account", "name", "state", "partition", "qos", "submit_time", "start_time",
    "end_time", "run_time", "wallclock_req", "nodes_req", "processors_req", "mem_req",
]
_rules = {f"missing_{c}": f'"{c}" IS NULL' for c in _missing} | {
    "runtime_not_positive": "run_time <= 0",
    "runtime_over_30_days": "run_time > 2592000",
    "start_before_submit": "start_time < submit_time",
    "end_before_start": "end_time < start_time",
    "processors_not_positive": "processors_req <= 0",
    "nodes_not_positive": "nodes_req <= 0",
    "memory_negative": "mem_req < 0",
    "walltime_not_positive": "wallclock_req <= 0",
    "gpus_negative": "gpus_req < 0",
}


@query(
    "quality_report",
    " UNION ALL ".join(
        f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {r}) AS bad, count(*) AS total FROM jobs" for n, r in _rules.items()
    ),
)
def quality_report(spark, sf):
    return filters.quality_report(jobs(spark, sf))


@query("select_features", "SELECT job_id, run_time, nodes_req, CAST(0 AS INTEGER) AS licences_req, mem_req FROM jobs")
def select_features(spark, sf):
    wanted = ["run_time", "nodes_req", "licences_req", "mem_req"]
    return filters.select_features(jobs(spark, sf), wanted, keep=["job_id"], fill_missing=True)


@query("log_target", "SELECT job_id, round(ln(1 + CAST(run_time AS DOUBLE)), 6) AS label FROM jobs WHERE run_time > 0")
def log_target(spark, sf):
    return rounded(filters.log_target(filters.positive_runtime(jobs(spark, sf))).select("job_id", "label"), "label")


@query(
    "normalise_request",
    """SELECT request_id, processors_req, nodes_req, mem_req, coalesce(wallclock_req, 3600e0) AS wallclock_req,
         "partition", qos, submit_time FROM service_requests""",
)
def normalise_request(spark, sf):
    names = ["request_id", "processors_req", "nodes_req", "mem_req", "wallclock_req", "partition", "qos", "submit_time"]
    return out(filters.normalise_request(views.job_requests_from_jobs(jobs(spark, sf))), names)


@query(
    "convert_units",
    """SELECT request_id, (mem_req / 1000) * 1024e0 AS mem_req, CAST(trunc((wallclock_req / 7200) * 3600e0) AS INTEGER) AS walltime_req
       FROM service_requests""",
)
def convert_units(spark, sf):
    df = views.job_requests_from_jobs(jobs(spark, sf)).select(
        "request_id", (F.col("mem_req") / 1000).alias("mem_gb"), (F.col("walltime_req") / 7200).alias("walltime_hours")
    )
    return filters.convert_units(df).select("request_id", "mem_req", "walltime_req")


@query(
    "serving_defaults",
    """SELECT request_id, "user", 'default' AS account, 'job' AS name, CAST(0 AS INTEGER) AS gpus_req, 'PENDING' AS state,
         CAST(0 AS BIGINT) AS run_time, submit_time, submit_time AS start_time, processors_req,
         CAST(idx AS BIGINT) AS job_id FROM service_requests""",
)
def serving_defaults(spark, sf):
    names = ["request_id", "user", "account", "name", "gpus_req", "state", "run_time", "submit_time", "start_time", "processors_req", "job_id"]
    return out(filters.serving_defaults(service_requests(spark, sf)), names)


def _range_sql(c, kind):
    lo, hi = f'min("{c}")', f'max("{c}")'
    if kind == "text":
        share = f'count(DISTINCT "{c}") / CAST(count(*) AS DOUBLE)'
        return f"""SELECT '{c}' AS "column", CAST(NULL AS DOUBLE) AS min_value, CAST(NULL AS DOUBLE) AS max_value, {share} AS distinct_share,
          CASE WHEN {share} < 0.5 THEN 'category' ELSE 'string' END AS suggested FROM jobs"""
    narrow = "'float32'" if kind == "float" else f"""CASE
          WHEN {lo} >= 0 THEN CASE WHEN {hi} < 255 THEN 'uint8' WHEN {hi} < 65535 THEN 'uint16' WHEN {hi} < 4294967295 THEN 'uint32' ELSE 'int64' END
          WHEN {lo} > -128 AND {hi} < 127 THEN 'int8' WHEN {lo} > -32768 AND {hi} < 32767 THEN 'int16'
          WHEN {lo} > -2147483648 AND {hi} < 2147483647 THEN 'int32' ELSE 'int64' END"""
    return f"""SELECT '{c}' AS "column", CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE), CAST(NULL AS DOUBLE), {narrow} FROM jobs"""


_kinds = {f.name: {"bigint": "int", "int": "int", "double": "float", "string": "text"}.get(f.dataType.simpleString()) for f in JOB_SCHEMA.fields}


_PROFILE_SQL = " UNION ALL ".join(_range_sql(c, k) for c, k in sorted(_kinds.items(), key=lambda p: p[1] != "text") if k)


@query("profile_schema", _PROFILE_SQL)
def profile_schema(spark, sf):
    return filters.profile_schema(jobs(spark, sf))


@query("profile_sketched", f'SELECT "column", min_value, max_value, suggested FROM ({_PROFILE_SQL})')
def profile_sketched(spark, sf):
    df = jobs(spark, sf)
    days = sketches.column_sketches(df.withColumn("day", F.to_date("submit_time")), ["day"])
    found = sketches.profile_from_sketches(df, materialize(days, "column-sketches"))
    return found.select("column", "min_value", "max_value", "suggested")


@query(
    "sample_n",
    "SELECT job_id, run_time FROM jobs ORDER BY md5(concat(job_id, '-42')), job_id LIMIT (SELECT count(*) // 5 FROM jobs)",
)
def sample_n(spark, sf):
    df = jobs(spark, sf)
    return splits.sample_n(df, df.count() // 5).select("job_id", "run_time")


@query("temporal_split", "SELECT job_id, submit_time, split FROM split_jobs")
def temporal_split(spark, sf):
    return out(splits.temporal_split(clean(spark, sf)), ["job_id", "submit_time", "split"])


@query(
    "temporal_split_70_15_15",
    f"""SELECT job_id, CASE WHEN rk < floor(n * 0.7e0) THEN 'train' WHEN rk < floor(n * {0.7 + 0.15}e0) THEN 'val' ELSE 'test' END AS split
        FROM ranked_jobs""",
)
def temporal_split_70_15_15(spark, sf):
    return splits.temporal_split(clean(spark, sf), splits.flat_cuts()).select("job_id", "split")


@query("union_all_splits", "SELECT split, job_id, run_time FROM split_jobs")
def union_all_splits(spark, sf):
    table = split_table(spark, sf)
    return splits.concat([table.where(F.col("split") == s) for s in ("train", "val", "test")]).select("split", "job_id", "run_time")


@query(
    "sort_jobs",
    'SELECT job_id, submit_time, "partition" FROM jobs ORDER BY submit_time, job_id',
)
def sort_jobs(spark, sf):
    return out(jobs(spark, sf).orderBy("submit_time", "job_id"), ["job_id", "submit_time", "partition"])


@query(
    "preview",
    'SELECT request_id, processors_req, nodes_req, mem_req, wallclock_req, "partition", qos FROM service_requests ORDER BY request_id LIMIT 10',
)
def preview(spark, sf):
    names = ["request_id", "processors_req", "nodes_req", "mem_req", "wallclock_req", "partition", "qos"]
    return service_requests(spark, sf).select(*names).orderBy("request_id").limit(10)


@query(
    "collect_errors",
    """SELECT batch_id, count(*) AS total_predictions, count(*) FILTER (WHERE NOT valid) AS failed_predictions
       FROM service_requests GROUP BY batch_id""",
)
def collect_errors(spark, sf):
    return reports.collect_errors(service_requests(spark, sf))


@query(
    "error_texts",
    """SELECT batch_id, idx, concat('Job ', idx, ': Invalid job features provided') AS error FROM service_requests WHERE NOT valid""",
)
def error_texts(spark, sf):
    return reports.error_texts(service_requests(spark, sf), F.lit("Invalid job features provided"))


@query(
    "request_nested",
    """SELECT CAST(request_id AS VARCHAR) AS request_id, processors_req, nodes_req, mem_req, wallclock_req, "partition", qos,
         date_trunc('second', submit_time) AS submit_time, "user", 'batch' AS source FROM service_requests""",
)
def request_nested(spark, sf):
    flat = flatten_request(nest_request(service_requests(spark, sf)))
    return out(flat, flat.columns)


@query(
    "log_summary",
    """SELECT 'partition' AS scope, "partition", count(*) AS jobs, min(submit_time) AS first_submit, max(submit_time) AS last_submit,
         count(*) FILTER (WHERE gpus_req > 0) AS gpu_jobs FROM jobs GROUP BY "partition"
       UNION ALL SELECT 'all', NULL, count(*), min(submit_time), max(submit_time), count(*) FILTER (WHERE gpus_req > 0) FROM jobs""",
)
def log_summary(spark, sf):
    found = aggregates.log_summary(jobs(spark, sf))
    return out(found, found.columns)
