"""The SQL side of the derived inputs: one named table expression each (DuckDB spelling)."""

from __future__ import annotations

from queuelens.functions.names import ARRAY_RANGE, NAME_PATTERNS
from queuelens.schema import MODEL_FEATURES, SCALED_COLUMNS

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

CTES: dict[str, str] = {}

CTES["jobs"] = f"""
SELECT job_id, "user", account, name, state, "partition", qos, submit_time, start_time,
       start_time + to_seconds(run_time) AS end_time, run_time, wallclock_req, nodes_req,
       CAST(CASE WHEN job_id % 97 = 0 THEN 0
            ELSE nodes_req * CASE k % 4 WHEN 0 THEN 16 WHEN 1 THEN 24 WHEN 2 THEN 32 ELSE 48 END END AS INTEGER) AS processors_req,
       CASE WHEN job_id % 101 = 0 THEN -1e0
            ELSE CAST(nodes_req * CASE k % 3 WHEN 0 THEN 32000 WHEN 1 THEN 64000 ELSE 128000 END AS DOUBLE) END AS mem_req,
       CAST(gpus_req AS INTEGER) AS gpus_req, CAST(exit_code AS INTEGER) AS exit_code,
       CAST(exit_code AS INTEGER) AS derived_exit_code
FROM (
  SELECT event_id AS job_id, {K} AS k,
    concat('user_', lpad(CAST(user_id AS VARCHAR), 3, '0')) AS "user",
    concat('proj_', lpad(CAST(user_id % 20 AS VARCHAR), 2, '0')) AS account,
    CASE WHEN event_id % 23 = 0 THEN NULL ELSE concat(
      CASE event_id % 8 WHEN 0 THEN 'wind_map' WHEN 1 THEN 'tide_model' WHEN 2 THEN 'net_fit' WHEN 3 THEN 'log_sift'
        WHEN 4 THEN 'grid_tune' WHEN 5 THEN 'ray_walk' WHEN 6 THEN 'heat_flow' ELSE 'fold_scan' END,
      CASE {K} % 10 WHEN 0 THEN '_MPI' WHEN 1 THEN '_cuda' WHEN 2 THEN concat('[0-', CAST({K} AS VARCHAR), ']')
        WHEN 3 THEN '_debug' WHEN 4 THEN '_prod' WHEN 5 THEN '_3of8' WHEN 6 THEN '[7]' ELSE '' END) END AS name,
    CASE WHEN event_id % 20 < 17 THEN 'COMPLETED' WHEN event_id % 20 < 19 THEN 'FAILED' ELSE 'TIMEOUT' END AS state,
    CASE event_type WHEN 'view' THEN 'compute' WHEN 'click' THEN 'standard' WHEN 'purchase' THEN 'gpu'
      WHEN 'signup' THEN 'debug' WHEN 'error' THEN 'bigmem' END AS "partition",
    CASE WHEN event_id % 211 = 0 THEN '' WHEN {K} % 20 < 12 THEN 'normal' WHEN {K} % 20 < 16 THEN 'high'
      WHEN {K} % 20 < 19 THEN 'low' ELSE 'debug' END AS qos,
    ts AS submit_time,
    ts + to_seconds((event_id * 7919) % 3600 - 60) AS start_time,
    CAST(floor(value * 200) AS BIGINT) - 5 AS run_time,
    CASE WHEN {K} % 29 = 0 THEN NULL
      WHEN user_id % 10 = 0 THEN CAST(floor(value * 120) AS DOUBLE) + 1
      WHEN user_id % 10 = 1 THEN CAST(floor(value * 240) AS DOUBLE) + 1
      WHEN value * (150 + 100 * ({K} % 6)) <= 3600 THEN 3600e0
      WHEN value * (150 + 100 * ({K} % 6)) <= 7200 THEN 7200e0
      WHEN value * (150 + 100 * ({K} % 6)) <= 14400 THEN 14400e0
      WHEN value * (150 + 100 * ({K} % 6)) <= 28800 THEN 28800e0
      WHEN value * (150 + 100 * ({K} % 6)) <= 43200 THEN 43200e0
      WHEN value * (150 + 100 * ({K} % 6)) <= 86400 THEN 86400e0
      ELSE 172800e0 END AS wallclock_req,
    CAST(CASE WHEN event_id % 250 = 7 THEN 128 ELSE pow(2, event_id % 6) END AS INTEGER) AS nodes_req,
    CASE WHEN event_type <> 'purchase' THEN 0
      ELSE CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END END AS gpus_req,
    CASE WHEN event_id % 20 < 17 THEN 0
      ELSE CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 127 END END AS exit_code
  FROM events
)"""

CTES["service_requests"] = """
SELECT job_id AS request_id, job_id // 100 AS batch_id, CAST(job_id % 100 AS INTEGER) AS idx, processors_req,
       nodes_req, mem_req, wallclock_req, "partition", qos, submit_time, "user",
       coalesce(processors_req > 0 AND nodes_req > 0 AND mem_req >= 0 AND wallclock_req > 0
                AND "partition" <> '' AND qos <> '', FALSE) AS valid
FROM jobs"""

CTES["requests"] = f"""
SELECT event_id AS request_seq, ts,
       CASE event_id % 3 WHEN 0 THEN 'Predict' WHEN 1 THEN 'PredictBatch' ELSE 'PredictStream' END AS method,
       CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'invalid' ELSE 'success' END AS status,
       value / 200 AS latency_s, value / 2000 AS inference_s,
       CASE event_type WHEN 'view' THEN TRUE WHEN 'click' THEN FALSE END AS cache_hit,
       greatest({K} % 4 - 1, 0) AS retries,
       CASE WHEN event_id % 3 = 1 THEN {K} + 1 END AS batch_size
FROM events"""

CTES["sane_jobs"] = """
SELECT * FROM jobs WHERE run_time > 0 AND run_time >= 10 AND run_time <= 604800
  AND processors_req > 0 AND nodes_req > 0 AND mem_req >= 0"""

CTES["trim_cut"] = """
SELECT quantile_cont(CAST(processors_req AS DOUBLE), 0.995) AS max_processors, quantile_cont(mem_req, 0.995) AS max_mem
FROM sane_jobs"""

CTES["clean_jobs"] = """
SELECT j.* FROM sane_jobs j, trim_cut t
WHERE j.processors_req <= t.max_processors AND j.mem_req <= t.max_mem AND j.state = 'COMPLETED'"""

CTES["ranked_jobs"] = """
SELECT *, row_number() OVER (ORDER BY submit_time, job_id) - 1 AS rk, count(*) OVER () AS n FROM clean_jobs"""

CTES["split_jobs"] = """
SELECT *, CASE WHEN rk < floor(floor(n * 0.8e0) * 0.9e0) THEN 'train'
               WHEN rk < floor(n * 0.8e0) THEN 'val' ELSE 'test' END AS split
FROM ranked_jobs"""

CTES["train_jobs"] = "SELECT * FROM split_jobs WHERE split = 'train'"

CTES["fit_cut"] = """
SELECT quantile_cont(wallclock_req, 0.5) AS wallclock_median,
       quantile_cont(mem_req / greatest(processors_req, 1), 0.75) AS mem_per_cpu_q75,
       quantile_cont(CAST(processors_req AS DOUBLE) * nodes_req, 0.9) AS total_compute_q90,
       quantile_cont(processors_req / greatest(mem_req, 1e0), 0.5) AS cpu_mem_median,
       avg(run_time) AS train_mean_runtime
FROM train_jobs"""

CTES["user_table"] = """
SELECT "user", avg(run_time) AS runtime_mean, count(run_time) AS job_count,
       avg(coalesce(wallclock_req, wallclock_median) / greatest(run_time, 1)) AS accuracy
FROM train_jobs, fit_cut GROUP BY "user" """

CTES["queue_table"] = """
SELECT "partition", hour(submit_time) AS submit_hour, count(job_id) AS job_count
FROM train_jobs GROUP BY 1, 2"""

CTES["code_table"] = """
SELECT 'partition' AS "column", value, row_number() OVER (ORDER BY value) - 1 AS code
FROM (SELECT DISTINCT "partition" AS value FROM train_jobs WHERE "partition" IS NOT NULL)
UNION ALL
SELECT 'qos' AS "column", value, row_number() OVER (ORDER BY value) - 1 AS code
FROM (SELECT DISTINCT qos AS value FROM train_jobs WHERE qos IS NOT NULL)"""

CTES["user_cut"] = """
SELECT quantile_cont(CAST(u.job_count AS DOUBLE), 0.75) AS user_count_q75
FROM train_jobs t JOIN user_table u ON t."user" = u."user" """

_name = "coalesce(name, '')"
_flags = ",\n".join(
    f"       CAST(regexp_matches({_name}, '{pattern}') AS INTEGER) AS {flag}" for flag, pattern in NAME_PATTERNS.items()
)
_size = f"""coalesce(try_cast(regexp_extract({_name}, '{ARRAY_RANGE}', 2) AS BIGINT)
         - try_cast(regexp_extract({_name}, '{ARRAY_RANGE}', 1) AS BIGINT) + 1, 0)"""

CTES["filled_jobs"] = """
SELECT s.* EXCLUDE (wallclock_req), coalesce(wallclock_req, wallclock_median) AS wallclock_req FROM split_jobs s, fit_cut"""

CTES["row_features"] = f"""
SELECT *, CAST(hour(submit_time) AS INTEGER) AS hour_of_day, CAST(isodow(submit_time) - 1 AS INTEGER) AS day_of_week,
       CAST(isodow(submit_time) >= 6 AS INTEGER) AS is_weekend,
       CAST(month(submit_time) AS INTEGER) AS month, CAST(quarter(submit_time) AS INTEGER) AS quarter,
       CAST(hour(submit_time) >= 20 OR hour(submit_time) < 6 AS INTEGER) AS is_night,
       CAST(hour(submit_time) BETWEEN 9 AND 16 AND isodow(submit_time) < 6 AS INTEGER) AS is_business_hours,
       CAST(day(submit_time) AS INTEGER) AS day_of_month, CAST(weekofyear(submit_time) AS INTEGER) AS week_of_year,
       CAST(submit_time AS DATE) AS submit_date, CAST(hour(submit_time) AS INTEGER) AS submit_hour,
       processors_req / greatest(mem_req, 1e0) AS cpu_memory_ratio,
       ln(1 + CAST(processors_req AS DOUBLE) * nodes_req) AS resource_intensity,
       mem_req / greatest(nodes_req, 1) AS memory_per_node,
       CAST(processors_req AS BIGINT) * nodes_req AS total_compute_units,
       wallclock_req / greatest(CAST(processors_req AS BIGINT) * nodes_req, 1) AS walltime_resource_ratio,
       mem_req / greatest(processors_req, 1) AS memory_per_cpu,
       processors_req / greatest(CAST(nodes_req AS BIGINT) * 32, 1) AS cpu_efficiency_score,
       ln(1 + CAST(processors_req AS DOUBLE) * nodes_req) * wallclock_req / 3600 AS job_complexity_score,
       CAST(length({_name}) AS INTEGER) AS name_length,
{_flags},
       {_size} AS array_job_size,
       greatest(coalesce((epoch_us(start_time) - epoch_us(submit_time)) / 1e6, 0e0), 0e0) AS queue_wait_time,
       concat("user", '_', "partition") AS user_partition_pair
FROM filled_jobs"""

CTES["raw_features"] = """
SELECT f.*, CAST(memory_per_cpu > mem_per_cpu_q75 AS INTEGER) AS is_high_memory_job,
       CAST(total_compute_units > total_compute_q90 AS INTEGER) AS is_large_job,
       abs(cpu_memory_ratio - cpu_mem_median) AS resource_balance,
       is_business_hours * CAST(total_compute_units > total_compute_q90 AS INTEGER) AS peak_hour_large_job,
       coalesce(u.runtime_mean, train_mean_runtime) AS user_mean_runtime,
       coalesce(u.job_count, 1) AS user_job_count,
       coalesce(u.accuracy, 1e0) AS user_accuracy_score,
       CAST(coalesce(u.accuracy, 1e0) > 1.5 AS INTEGER) AS user_overestimate_tendency,
       CAST(coalesce(u.accuracy, 1e0) < 0.8 AS INTEGER) AS user_underestimate_tendency,
       CAST(coalesce(u.job_count, 1) > user_count_q75 AS INTEGER) AS user_is_frequent,
       coalesce(u.job_count, 1) AS user_frequency,
       coalesce(q.job_count, 0) AS queue_load,
       CAST(coalesce(cp.code, -1) AS INTEGER) AS partition_encoded,
       CAST(coalesce(cq.code, -1) AS INTEGER) AS qos_encoded
FROM row_features f CROSS JOIN fit_cut CROSS JOIN user_cut
LEFT JOIN user_table u ON f."user" = u."user"
LEFT JOIN queue_table q ON f."partition" = q."partition" AND f.submit_hour = q.submit_hour
LEFT JOIN code_table cp ON cp."column" = 'partition' AND cp.value = f."partition"
LEFT JOIN code_table cq ON cq."column" = 'qos' AND cq.value = f.qos"""

CTES["scaler_wide"] = "SELECT " + ",\n       ".join(
    f"quantile_cont(CAST({c} AS DOUBLE), [0.25, 0.5, 0.75]) AS {c}" for c in SCALED_COLUMNS
) + " FROM raw_features WHERE split = 'train'"

CTES["scaler_params"] = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, {c}[2] AS center, CASE WHEN {c}[3] = {c}[1] THEN 1e0 ELSE {c}[3] - {c}[1] END AS scale FROM scaler_wide"
    for c in SCALED_COLUMNS
)


def _feature(name: str) -> str:
    if name.endswith("_scaled"):
        c = name.removesuffix("_scaled")
        spread = f"CASE WHEN s.{c}[3] = s.{c}[1] THEN 1e0 ELSE s.{c}[3] - s.{c}[1] END"
        return f"round((r.{c} - s.{c}[2]) / ({spread}), 6) AS {name}"
    return f"r.{name}"


CTES["model_features"] = (
    "SELECT r.job_id, r.split, " + ",\n       ".join(_feature(c) for c in MODEL_FEATURES) + "\nFROM raw_features r, scaler_wide s"
)

CTES["sample_scored"] = """
SELECT *, wallclock_req * ((3 + request_id % 10) / 10e0) AS predicted_runtime,
       least(wallclock_req * ((3 + request_id % 10) / 10e0) / wallclock_req * 100, 100e0) AS efficiency
FROM service_requests WHERE valid"""

CTES["sample_results"] = """
SELECT request_id, "partition", wallclock_req, predicted_runtime, efficiency,
       CASE WHEN predicted_runtime < 3600 THEN 'short' WHEN predicted_runtime < 14400 THEN 'medium'
            WHEN predicted_runtime < 86400 THEN 'long' ELSE 'very_long' END AS runtime_category,
       'success' AS prediction_status, NULL AS error, processors_req, nodes_req
FROM sample_scored
UNION ALL
SELECT request_id, NULL, NULL, 0e0, NULL, NULL, 'failed', 'Invalid job features provided', processors_req, nodes_req
FROM service_requests WHERE NOT valid"""

_wall = "coalesce(wallclock_req, 14400e0)"
CTES["sample_predictions"] = "\nUNION ALL\n".join(
    f"SELECT job_id, split, ln(1 + CAST(run_time AS DOUBLE)) AS label, '{m}' AS model, {p} AS prediction FROM split_jobs"
    for m, p in {
        "a": f"ln(1 + {_wall} * 0.55e0)",
        "b": f"ln(1 + ({_wall} * 0.25e0 + 900e0))",
        "c": f"ln(1 + {_wall}) * 0.6e0 + 2.5e0",
    }.items()
)

CTES["sample_errors"] = """
SELECT model, split, exp(label) - 1 AS a, (exp(label) - 1) - (exp(prediction) - 1) AS e FROM sample_predictions"""

CTES["sample_metrics"] = """
SELECT model, split, count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse,
       1 - sum(e * e) / (var_pop(a) * count(*)) AS r2, avg(abs(e) / greatest(a, 1)) * 100 AS mape
FROM sample_errors GROUP BY model, split"""

CTES["sample_weights"] = """
SELECT model, (1 / mae) / sum(1 / mae) OVER () AS weight FROM sample_metrics WHERE split = 'val'"""


def runtime_text(seconds: str) -> str:
    """SQL for the human-readable form of a number of seconds."""
    whole = f"CAST(floor({seconds}) AS BIGINT)"
    return f"""CASE WHEN {seconds} < 60 THEN printf('%.1fs', {seconds})
         WHEN {seconds} < 3600 THEN printf('%dm %ds', {whole} // 60, {whole} % 60)
         WHEN {seconds} < 86400 THEN printf('%dh %dm %ds', {whole} // 3600, ({whole} // 60) % 60, {whole} % 60)
         WHEN {seconds} IS NOT NULL THEN printf('%dd %dh %dm', {whole} // 86400, ({whole} // 3600) % 24, ({whole} // 60) % 60) END"""
