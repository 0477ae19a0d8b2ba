"""Calendar, resource, name, user, queue and report values of single rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from queuelens.functions import calendar as cal, names, reports as R, resources as res
from queuelens.operators import joins, reports, scaling, sketches
from queuelens.operators.aggregates import batch_summary, frequency_counts, label_encode
from queuelens.operators.scalars import unpivot_row
from queuelens.plans import features
from queuelens.registry.catalog import (
    jobs, out, query, requests, rounded, sample_results, service_requests, split_table, state, train_rows,
    with_sample_prediction,
)
from queuelens.registry.ctes import runtime_text
from queuelens.schema import MODEL_FEATURES, REQUEST_KEY, SCALED_COLUMNS
from queuelens.session import materialize

# --- calendar: over the log, and over order dates, which cover seven years ---------------------

SUBMIT, DAYS = "submit_time", "o_orderdate"


def _orders(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderdate")


def _log_feature(name, expression, sql):
    @query(name, f"SELECT job_id, {sql} AS {name} FROM jobs")
    def run(spark, sf):
        return jobs(spark, sf).select("job_id", expression().alias(name))


def _order_feature(name, expression, sql):
    @query(name, f"SELECT o_orderkey, {sql} AS {name} FROM orders")
    def run(spark, sf):
        return _orders(spark, sf).select("o_orderkey", expression().alias(name))


_log_feature("hour_of_day", lambda: cal.hour_of_day(F.col(SUBMIT)), "CAST(hour(submit_time) AS INTEGER)")
_log_feature("day_of_week", lambda: cal.day_of_week(F.col(SUBMIT)), "CAST(isodow(submit_time) - 1 AS INTEGER)")
_log_feature("is_weekend", lambda: cal.is_weekend(F.col(SUBMIT)), "CAST(isodow(submit_time) >= 6 AS INTEGER)")
_log_feature("is_night", lambda: cal.is_night(F.col(SUBMIT)), "CAST(hour(submit_time) >= 20 OR hour(submit_time) < 6 AS INTEGER)")
_log_feature(
    "is_business_hours", lambda: cal.is_business_hours(F.col(SUBMIT)),
    "CAST(hour(submit_time) BETWEEN 9 AND 16 AND isodow(submit_time) < 6 AS INTEGER)",
)
_order_feature("month", lambda: F.month(DAYS), "CAST(month(o_orderdate) AS INTEGER)")
_order_feature("quarter", lambda: F.quarter(DAYS), "CAST(quarter(o_orderdate) AS INTEGER)")
_order_feature("day_of_month", lambda: F.dayofmonth(DAYS), "CAST(day(o_orderdate) AS INTEGER)")
_order_feature("week_of_year", lambda: F.weekofyear(DAYS), "CAST(weekofyear(o_orderdate) AS INTEGER)")


@query("submit_hour_date", "SELECT job_id, CAST(hour(submit_time) AS INTEGER) AS submit_hour, CAST(submit_time AS DATE) AS submit_date FROM jobs")
def submit_hour_date(spark, sf):
    return jobs(spark, sf).select("job_id", F.hour(SUBMIT).alias("submit_hour"), F.to_date(SUBMIT).alias("submit_date"))


_log_feature(
    "queue_wait_time", lambda: cal.queue_wait_time(F.col("start_time"), F.col(SUBMIT)),
    "greatest(coalesce((epoch_us(start_time) - epoch_us(submit_time)) / 1e6, 0e0), 0e0)",
)


@query(
    "epoch_to_timestamp",
    """SELECT job_id, CAST(floor(epoch(submit_time)) AS BIGINT) AS epoch_seconds, date_trunc('second', submit_time) AS at FROM jobs""",
)
def epoch_to_timestamp(spark, sf):
    df = jobs(spark, sf).select("job_id", F.unix_timestamp(SUBMIT).alias("epoch_seconds"))
    return out(df.withColumn("at", cal.epoch_to_timestamp(F.col("epoch_seconds"))), ["job_id", "epoch_seconds", "at"])


# --- resources --------------------------------------------------------------------------------

UNITS = "CAST(processors_req AS BIGINT) * nodes_req"

_log_feature("cpu_memory_ratio", lambda: res.cpu_memory_ratio(F.col("processors_req"), F.col("mem_req")), "processors_req / greatest(mem_req, 1e0)")
_log_feature("resource_intensity", lambda: F.round(res.resource_intensity(F.col("processors_req"), F.col("nodes_req")), 6), f"round(ln(1 + {UNITS}), 6)")
_log_feature("memory_per_node", lambda: res.memory_per_node(F.col("mem_req"), F.col("nodes_req")), "mem_req / greatest(nodes_req, 1)")
_log_feature("total_compute_units", lambda: res.total_compute_units(F.col("processors_req"), F.col("nodes_req")), UNITS)
_log_feature("walltime_resource_ratio", lambda: res.walltime_resource_ratio(F.col("wallclock_req"), F.col("processors_req"), F.col("nodes_req")), f"wallclock_req / greatest({UNITS}, 1)")
_log_feature("memory_per_cpu", lambda: res.memory_per_cpu(F.col("mem_req"), F.col("processors_req")), "mem_req / greatest(processors_req, 1)")
_log_feature("cpu_efficiency_score", lambda: res.cpu_efficiency_score(F.col("processors_req"), F.col("nodes_req")), "processors_req / greatest(CAST(nodes_req AS BIGINT) * 32, 1)")
_log_feature(
    "job_complexity_score", lambda: F.round(res.job_complexity_score(F.col("processors_req"), F.col("nodes_req"), F.col("wallclock_req")), 6), f"round(ln(1 + {UNITS}) * wallclock_req / 3600, 6)"
)


def _fitted_feature(name, *columns, real=()):
    shown = ", ".join(f"round({c}, 6) AS {c}" if c in real else c for c in columns)

    @query(name, f"SELECT job_id, {shown} FROM raw_features")
    def run(spark, sf):
        return rounded(features.transform(split_table(spark, sf), state(spark, sf)).select("job_id", *columns), *real)


_fitted_feature("is_high_memory_job", "is_high_memory_job")
_fitted_feature("is_large_job", "is_large_job")
_fitted_feature("resource_balance", "resource_balance", real=("resource_balance",))
_fitted_feature("peak_hour_large_job", "peak_hour_large_job")
_fitted_feature("user_tendency", "user_overestimate_tendency", "user_underestimate_tendency")
_fitted_feature("user_is_frequent", "user_job_count", "user_is_frequent")
_fitted_feature("user_frequency", "user_frequency")


# --- names ------------------------------------------------------------------------------------

_n = "coalesce(name, '')"
_log_feature("name_length", lambda: names.name_length(F.col("name")), f"CAST(length({_n}) AS INTEGER)")
for _flag, _pattern in names.NAME_PATTERNS.items():
    _log_feature(_flag, lambda flag=_flag: names.name_flag(F.col("name"), flag), f"CAST(regexp_matches({_n}, '{_pattern}') AS INTEGER)")
_log_feature(
    "array_job_size", lambda: names.array_job_size(F.col("name")),
    f"""coalesce(try_cast(regexp_extract({_n}, '{names.ARRAY_RANGE}', 2) AS BIGINT)
        - try_cast(regexp_extract({_n}, '{names.ARRAY_RANGE}', 1) AS BIGINT) + 1, 0)""",
)
_log_feature("user_partition_pair", lambda: res.user_partition_pair(F.col("user"), F.col("partition")), "concat(\"user\", '_', \"partition\")")


# --- report values ----------------------------------------------------------------------------

PRED_SQL = "wallclock_req * ((3 + request_id % 10) / 10e0)"


def _report_value(name, sql, *columns):
    fields = ", ".join(f"{s} AS {c}" for s, c in zip(sql if isinstance(sql, tuple) else (sql,), [n for n, _ in columns]))

    @query(name, f"SELECT request_id, {fields} FROM (SELECT *, {PRED_SQL} AS predicted_runtime FROM service_requests)")
    def run(spark, sf):
        df = with_sample_prediction(service_requests(spark, sf))
        return df.select("request_id", *[c().alias(n) for n, c in columns])


_report_value(
    "efficiency",
    "round(CASE WHEN wallclock_req <= 0 THEN 0 WHEN wallclock_req IS NULL THEN NULL ELSE least(predicted_runtime / wallclock_req * 100, 100e0) END, 6)",
    ("efficiency", lambda: F.round(R.efficiency(F.col("predicted_runtime"), F.col("wallclock_req")), 6)),
)
_report_value(
    "walltime_advice",
    "CASE WHEN predicted_runtime / wallclock_req * 100 < 50 THEN 'reduce' WHEN predicted_runtime / wallclock_req * 100 > 90 THEN 'add buffer' END",
    ("advice", lambda: R.walltime_advice(F.col("predicted_runtime"), F.col("wallclock_req"))),
)
_report_value(
    "overestimation_alert", "coalesce(wallclock_req / predicted_runtime > 1.5, FALSE)",
    ("alert", lambda: R.overestimation_alert(F.col("predicted_runtime"), F.col("wallclock_req"))),
)
_report_value(
    "confidence_band", ("round(predicted_runtime * 0.8e0, 6)", "round(predicted_runtime * 1.2e0, 6)"),
    ("confidence_lower", lambda: F.round(R.band_20pct(F.col("predicted_runtime"))[0], 6)), ("confidence_upper", lambda: F.round(R.band_20pct(F.col("predicted_runtime"))[1], 6)),
)
_report_value(
    "runtime_category",
    "CASE WHEN predicted_runtime < 3600 THEN 'short' WHEN predicted_runtime < 14400 THEN 'medium' WHEN predicted_runtime < 86400 THEN 'long' WHEN predicted_runtime IS NOT NULL THEN 'very_long' END",
    ("runtime_category", lambda: R.runtime_category(F.col("predicted_runtime"))),
)
_report_value(
    "title_case",
    "CASE WHEN predicted_runtime < 3600 THEN 'Short' WHEN predicted_runtime < 14400 THEN 'Medium' WHEN predicted_runtime < 86400 THEN 'Long' WHEN predicted_runtime IS NOT NULL THEN 'Very_long' END",
    ("category", lambda: R.title_case(R.runtime_category(F.col("predicted_runtime")))),
)
_report_value(
    "gauge_band",
    "CASE WHEN (request_id % 10) * 10 + 15 >= 80 THEN 'green' WHEN (request_id % 10) * 10 + 15 >= 60 THEN 'orange' ELSE 'red' END",
    ("band", lambda: R.gauge_band((F.col("request_id") % 10) * 10 + 15)),
)

_log_feature(
    "inverse_log", lambda: F.round(R.inverse_log(F.log1p(F.abs("run_time").cast("double") / 7)), 6),
    "round(exp(ln(1 + abs(run_time) / 7)) - 1, 6)",
)
_log_feature(
    "format_runtime", lambda: R.format_runtime((F.col("run_time") * F.col("run_time") / 1000).cast("double")),
    runtime_text("(CAST(run_time AS DOUBLE) * run_time / 1000)"),
)


def _json_field(name: str, value: str) -> str:
    """A JSON member, NULL where the value is."""
    return f"""'"{name}":' || {value}"""


_mem = "CASE WHEN mem_req >= 1e7 THEN CAST(mem_req / 1e7 AS VARCHAR) || 'E7' ELSE CAST(mem_req AS VARCHAR) END"
_json = ", ".join(
    _json_field(name, value)
    for name, value in {
        "mem_req": _mem, "nodes_req": "nodes_req", "partition": """'"' || "partition" || '"'""", "processors_req": "processors_req",
        "qos": """'"' || qos || '"'""", "wallclock_req": "CAST(wallclock_req AS VARCHAR)",
    }.items()
)


@query("feature_key", f"SELECT request_id, md5('{{' || concat_ws(',', {_json}) || '}}') AS feature_key FROM service_requests")
def feature_key(spark, sf):
    """The digest that distinct scoring and the reuse stream go by."""
    return service_requests(spark, sf).select("request_id", R.feature_key(REQUEST_KEY).alias("feature_key"))


@query(
    "feature_key_groups",
    """SELECT count(*) AS requests, count(DISTINCT (processors_req, nodes_req, mem_req, coalesce(wallclock_req, -1), "partition", qos)) AS distinct_keys
       FROM service_requests""",
)
def feature_key_groups(spark, sf):
    """The JSON digest tells the same requests apart as the six fields do."""
    keyed = service_requests(spark, sf).groupBy(R.feature_key(REQUEST_KEY).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return keyed.agg(F.sum("n").alias("requests"), F.count(F.lit(1)).alias("distinct_keys"))


_ok = "prediction_status = 'success'"
_avg, _total = f"avg(predicted_runtime) FILTER (WHERE {_ok})", f"sum(predicted_runtime) FILTER (WHERE {_ok})"


@query(
    "summary_text",
    f"""SELECT concat_ws(chr(10), 'Runtime Prediction Summary Report', 'File: jobs.csv', concat('Total Jobs: ', total),
          concat('Successful Predictions: ', good), concat('Failed Predictions: ', total - good),
          concat('Average Predicted Runtime: ', {runtime_text('mean')}), concat('Total Predicted Runtime: ', {runtime_text('everything')}),
          printf('Average Efficiency: %.1f%%', eff)) AS report
        FROM (SELECT count(*) AS total, count(*) FILTER (WHERE {_ok}) AS good, {_avg} AS mean, {_total} AS everything,
                avg(efficiency) AS eff FROM sample_results)""",
)
def summary_text(spark, sf):
    return reports.summary_text(batch_summary(sample_results(spark, sf)))


@query(
    "union_results",
    """SELECT request_id, prediction_status, round(predicted_runtime, 6) AS predicted_runtime, round(efficiency, 6) AS efficiency,
         runtime_category, error, processors_req FROM sample_results""",
)
def union_results(spark, sf):
    names_ = ["request_id", "prediction_status", "predicted_runtime", "efficiency", "runtime_category", "error", "processors_req"]
    return rounded(sample_results(spark, sf).select(*names_), "predicted_runtime", "efficiency")


@query(
    "walltime_report_rows",
    f"""SELECT request_id, {runtime_text('predicted_runtime')} AS runtime_formatted, {runtime_text('wallclock_req')} AS walltime_formatted,
          prediction_status FROM sample_results WHERE {_ok}""",
)
def walltime_report_rows(spark, sf):
    found = sample_results(spark, sf).where(F.col("prediction_status") == "success")
    return found.select("request_id", "runtime_formatted", "walltime_formatted", "prediction_status")


@query(
    "service_rows",
    f"""SELECT request_id, CASE WHEN {_ok} THEN '2.0' ELSE 'error' END AS model_version,
          CASE WHEN {_ok} THEN 0.8e0 ELSE 0e0 END AS confidence_score FROM sample_results""",
)
def service_rows(spark, sf):
    return reports.service_rows(sample_results(spark, sf)).select("request_id", "model_version", "confidence_score")


# --- fitted statistics and the whole recipe ----------------------------------------------------


_USER_LOOKUP_SQL = """SELECT s.job_id, round(coalesce(u.runtime_mean, train_mean_runtime), 6) AS user_mean_runtime,
     coalesce(u.job_count, 1) AS user_job_count, round(coalesce(u.accuracy, 1e0), 6) AS user_accuracy_score
   FROM split_jobs s CROSS JOIN fit_cut LEFT JOIN user_table u ON s."user" = u."user" """


def _user_lookup(df):
    return rounded(df.select("job_id", "user_mean_runtime", "user_job_count", "user_accuracy_score"), "user_mean_runtime", "user_accuracy_score")


@query("join_user_stats", _USER_LOOKUP_SQL)
def join_user_stats(spark, sf):
    fitted = state(spark, sf)
    return _user_lookup(joins.join_user_stats(split_table(spark, sf), fitted.users, fitted.thresholds["train_mean_runtime"]))


@query("join_user_stats_salted", _USER_LOOKUP_SQL)
def join_user_stats_salted(spark, sf):
    fitted, df = state(spark, sf), split_table(spark, sf)
    heavy = sketches.heavy_keys(sketches.frequent_sketches(df, "user"), "user")
    heavy = materialize(heavy, "heavy-users")
    return _user_lookup(joins.join_user_stats(df, fitted.users, fitted.thresholds["train_mean_runtime"], heavy))


@query(
    "join_queue_load",
    """SELECT s.job_id, coalesce(q.job_count, 0) AS queue_load FROM split_jobs s
       LEFT JOIN queue_table q ON s."partition" = q."partition" AND hour(s.submit_time) = q.submit_hour""",
)
def join_queue_load(spark, sf):
    return joins.join_queue_load(split_table(spark, sf), state(spark, sf).queues).select("job_id", "queue_load")


@query(
    "join_dictionary",
    """SELECT j.job_id, CAST(coalesce(c.code, -1) AS INTEGER) AS qos_encoded FROM jobs j
       LEFT JOIN code_table c ON c."column" = 'qos' AND c.value = j.qos""",
)
def join_dictionary(spark, sf):
    return joins.join_dictionary(jobs(spark, sf), state(spark, sf).codes, "qos", "qos_encoded").select("job_id", "qos_encoded")


@query(
    "join_thresholds",
    """SELECT job_id, CAST(coalesce(mem_req / greatest(processors_req, 1) > mem_per_cpu_q75, FALSE) AS INTEGER) AS is_high_memory_job,
         CAST(CAST(processors_req AS DOUBLE) * nodes_req > total_compute_q90 AS INTEGER) AS is_large_job
       FROM split_jobs, fit_cut""",
)
def join_thresholds(spark, sf):
    table = split_table(spark, sf)
    cuts = features.fit_thresholds(table.where(F.col("split") == "train"))
    sized = table.select(
        "job_id", res.memory_per_cpu(F.col("mem_req"), F.col("processors_req")).alias("memory_per_cpu"), res.total_compute_units(F.col("processors_req"), F.col("nodes_req")).alias("total_compute_units")
    )
    flags = {"is_high_memory_job": ("memory_per_cpu", "mem_per_cpu_q75"), "is_large_job": ("total_compute_units", "total_compute_q90")}
    return joins.join_thresholds(sized, cuts, flags).select("job_id", *flags)


@query(
    "fit_thresholds",
    """SELECT round(wallclock_median, 6) AS wallclock_median, round(mem_per_cpu_q75, 6) AS mem_per_cpu_q75,
         round(total_compute_q90, 6) AS total_compute_q90, round(cpu_mem_median, 6) AS cpu_mem_median, user_count_q75 FROM fit_cut, user_cut""",
)
def fit_thresholds(spark, sf):
    rows = train_rows(spark, sf)
    cuts = features.fit_thresholds(rows)
    per_user = rows.groupBy("user").agg(F.count("run_time").alias("job_count"), F.count(F.lit(1)).alias("rows"))
    frequent = features.user_count_quantile(per_user)
    found = cuts.select("*", frequent.scalar().alias("user_count_q75"))
    return rounded(found, "wallclock_median", "mem_per_cpu_q75", "total_compute_q90", "cpu_mem_median")


@query("label_encode", 'SELECT "column", value, CAST(code AS INTEGER) AS code FROM code_table')
def label_encode_query(spark, sf):
    return label_encode(train_rows(spark, sf))


@query("frequency_counts", 'SELECT "user", count(*) AS n FROM train_jobs GROUP BY "user"')
def frequency(spark, sf):
    return frequency_counts(train_rows(spark, sf))


@query("fit_robust_scaler", "SELECT feature, round(center, 6) AS center, round(scale, 6) AS scale FROM scaler_params")
def fit_robust_scaler(spark, sf):
    fitted = state(spark, sf)
    raw = features.transform(train_rows(spark, sf), fitted)
    return rounded(scaling.fit_robust_scaler(raw, SCALED_COLUMNS), "center", "scale")


_scaled = [f"{c}_scaled" for c in SCALED_COLUMNS]


@query("apply_robust_scaler", f"SELECT job_id, {', '.join(_scaled)} FROM model_features")
def apply_robust_scaler(spark, sf):
    return rounded(features.transform(split_table(spark, sf), state(spark, sf)).select("job_id", *_scaled), *_scaled)


_features_sql = ", ".join(MODEL_FEATURES)


@query("fit_transform", f"SELECT job_id, {_features_sql} FROM model_features WHERE split = 'train'")
def fit_transform(spark, sf):
    done, fitted = features.fit_transform(train_rows(spark, sf))
    return rounded(done.select("job_id", *MODEL_FEATURES), *_scaled)


@query("transform", f"SELECT job_id, {_features_sql} FROM model_features WHERE split <> 'train'")
def transform(spark, sf):
    later = split_table(spark, sf).where(F.col("split") != "train")
    return rounded(features.transform(later, state(spark, sf)).select("job_id", *MODEL_FEATURES), *_scaled)


@query(
    "feature_columns",
    " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS feature, count({c}) AS filled FROM model_features WHERE split = 'train'"
        for i, c in enumerate(MODEL_FEATURES)
    ),
)
def feature_columns(spark, sf):
    done = features.transform(train_rows(spark, sf), state(spark, sf))
    counts = done.agg(*[F.count(c).alias(c) for c in state(spark, sf).features])
    parts = {c: [F.lit(i), F.col(c)] for i, c in enumerate(state(spark, sf).features)}
    return unpivot_row(counts, "feature", parts, ["position", "filled"]).select("position", "feature", "filled")
