"""Grouped statistics, rolling history, evaluation and nested records."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from queuelens.functions import reports as R
from queuelens.operators import aggregates, evaluation, history, joins, nested, sketches
from queuelens.operators.filters import skip_invalid
from queuelens.operators.scalars import only_row
from queuelens.plans import features
from queuelens.registry.catalog import (
    clean, jobs, query, requests, rounded, sample_predictions, sample_results, service_requests, split_table,
    state, train_rows,
)
from queuelens.session import materialize
from queuelens.sources import layout

_medians = {"runtime": "run_time", "wallclock": "wallclock_req", "processors": "processors_req", "mem": "mem_req"}


@query(
    "user_stats",
    """SELECT "user", round(coalesce(avg(run_time), 0), 6) AS runtime_mean, round(coalesce(stddev_samp(run_time), 0), 6) AS runtime_std,
         count(run_time) AS job_count, round(coalesce(avg(wallclock_req), 0), 6) AS wallclock_mean,
         round(avg(processors_req), 6) AS processors_mean, round(avg(mem_req), 6) AS mem_mean,
         round(coalesce(avg(wallclock_req / greatest(run_time, 1)), 0), 6) AS accuracy,
         round(coalesce(quantile_cont(CAST(run_time AS DOUBLE), 0.5), 0), 6) AS runtime_median,
         round(coalesce(quantile_cont(wallclock_req, 0.5), 0), 6) AS wallclock_median,
         round(quantile_cont(CAST(processors_req AS DOUBLE), 0.5), 6) AS processors_median,
         round(quantile_cont(mem_req, 0.5), 6) AS mem_median
       FROM clean_jobs GROUP BY "user" """,
)
def user_stats(spark, sf):
    found = aggregates.user_stats(clean(spark, sf))
    return rounded(found, *[c for c in found.columns if c not in ("user", "job_count")])


@query(
    "user_accuracy",
    'SELECT "user", round(avg(wallclock_req / greatest(run_time, 1)), 6) AS accuracy FROM jobs GROUP BY "user"',
)
def user_accuracy(spark, sf):
    return rounded(aggregates.user_accuracy(jobs(spark, sf)), "accuracy")


@query(
    "queue_stats",
    """SELECT "partition", CAST(hour(submit_time) AS INTEGER) AS submit_hour, count(job_id) AS job_count, round(avg(run_time), 6) AS runtime_mean,
         CAST(sum(processors_req) AS BIGINT) AS processors_sum, round(quantile_cont(CAST(run_time AS DOUBLE), 0.5), 6) AS runtime_median
       FROM clean_jobs GROUP BY 1, 2""",
)
def queue_stats(spark, sf):
    return rounded(aggregates.queue_stats(clean(spark, sf)), "runtime_mean", "runtime_median")


@query(
    "distinct_values",
    """SELECT DISTINCT 'partition' AS "column", "partition" AS value FROM jobs UNION ALL SELECT DISTINCT 'qos', qos FROM jobs
       UNION ALL SELECT DISTINCT 'state', state FROM jobs""",
)
def distinct_values(spark, sf):
    return aggregates.distinct_values(jobs(spark, sf), ["partition", "qos", "state"])


STAT_COLUMNS = [
    "run_time", "wallclock_req", "nodes_req", "processors_req", "mem_req", "gpus_req", "hour_of_day", "cpu_memory_ratio",
    "resource_intensity", "memory_per_node", "total_compute_units", "walltime_resource_ratio", "memory_per_cpu",
    "cpu_efficiency_score", "job_complexity_score", "name_length", "array_job_size", "queue_wait_time", "user_job_count", "queue_load",
]


@query(
    "feature_stats",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min,
          round(CAST(max({c}) AS DOUBLE), 6) AS max, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25,
          round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75
        FROM raw_features WHERE split = 'train'"""
        for c in STAT_COLUMNS
    ),
)
def feature_stats(spark, sf):
    done = features.transform(train_rows(spark, sf), state(spark, sf))
    found = aggregates.feature_stats(done, STAT_COLUMNS)
    return rounded(found, "mean", "std", "min", "max", "q25", "q50", "q75")


@query(
    "median_fill",
    """SELECT job_id, coalesce(wallclock_req, (SELECT quantile_cont(wallclock_req, 0.5) FROM clean_jobs)) AS wallclock_req FROM clean_jobs""",
)
def median_fill(spark, sf):
    return aggregates.median_fill(clean(spark, sf)).select("job_id", "wallclock_req")


_ok = "prediction_status = 'success'"


@query(
    "batch_summary",
    f"""SELECT count(*) AS total_jobs, count(*) FILTER (WHERE {_ok}) AS successful, count(*) FILTER (WHERE NOT {_ok}) AS failed,
          round(avg(predicted_runtime) FILTER (WHERE {_ok}), 6) AS avg_predicted_runtime,
          round(sum(predicted_runtime) FILTER (WHERE {_ok}), 6) AS total_predicted_runtime,
          round(avg(efficiency), 6) AS avg_efficiency,
          (SELECT runtime_category FROM sample_results WHERE runtime_category IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_common_category
        FROM sample_results""",
)
def batch_summary(spark, sf):
    return rounded(
        aggregates.batch_summary(sample_results(spark, sf)), "avg_predicted_runtime", "total_predicted_runtime", "avg_efficiency"
    )


@query(
    "category_counts",
    "SELECT runtime_category, count(*) AS n FROM sample_results WHERE runtime_category IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1",
)
def category_counts(spark, sf):
    return aggregates.category_counts(sample_results(spark, sf))


@query(
    "runtime_histogram",
    f"""WITH_E SELECT b.bin, round(low + b.bin * width, 6) AS low, round(low + (b.bin + 1) * width, 6) AS high, coalesce(n, 0) AS n
        FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(30)) b
        CROSS JOIN (SELECT min(predicted_runtime) AS low, (max(predicted_runtime) - min(predicted_runtime)) / 30e0 AS width FROM sample_scored) e
        LEFT JOIN (SELECT CAST(least(floor((predicted_runtime - low) / width), 29) AS INTEGER) AS bin, count(*) AS n
                   FROM sample_scored CROSS JOIN (SELECT min(predicted_runtime) AS low, (max(predicted_runtime) - min(predicted_runtime)) / 30e0 AS width FROM sample_scored)
                   GROUP BY 1) c ON b.bin = c.bin""".replace("WITH_E ", ""),
)
def runtime_histogram(spark, sf):
    scored = sample_results(spark, sf).where(F.col("prediction_status") == "success")
    return rounded(aggregates.runtime_histogram(scored), "low", "high")


@query(
    "efficiency_box",
    """SELECT "partition", round(min(efficiency), 6) AS lowest, round(quantile_cont(efficiency, 0.25), 6) AS q1,
         round(quantile_cont(efficiency, 0.5), 6) AS median, round(quantile_cont(efficiency, 0.75), 6) AS q3, round(max(efficiency), 6) AS highest
       FROM sample_scored GROUP BY "partition" """,
)
def efficiency_box(spark, sf):
    scored = sample_results(spark, sf).where(F.col("prediction_status") == "success")
    found = aggregates.efficiency_box(scored)
    return rounded(found, *[c for c in found.columns if c != "partition"])


@query(
    "latency_percentiles",
    """SELECT round(quantile_cont(latency_s, 0.5), 6) AS p50, round(quantile_cont(latency_s, 0.95), 6) AS p95,
         round(quantile_cont(latency_s, 0.99), 6) AS p99 FROM requests""",
)
def latency_percentiles(spark, sf):
    return rounded(aggregates.latency_percentiles(requests(spark, sf)), "p50", "p95", "p99")


@query(
    "latency_sketch_ranks",
    """SELECT method, p, count(latency_s) AS n, true AS within_bound
       FROM requests, (VALUES (0.5e0), (0.95e0), (0.99e0)) v(p) WHERE latency_s IS NOT NULL GROUP BY method, p""",
)
def latency_sketch_ranks(spark, sf):
    # The ranks of answers from hourly sketches, counted over all rows; twice the 99 % bound is 5 standard errors.
    df = requests(spark, sf)
    hours = sketches.quantile_sketches(df.withColumn("hour", F.date_trunc("hour", "ts")), "latency_s", ["method", "hour"])
    found = sketches.merged_quantiles(materialize(hours, "latency-sketches"), [0.5, 0.95, 0.99], ["method"])
    ranks = sketches.rank_check(df, "latency_s", found, ["method"])
    return ranks.select("method", "p", "n", (F.col("off") <= 2 * sketches.rank_error()).alias("within_bound"))


@query(
    "heavy_users",
    """SELECT "user", count(*) AS n FROM split_jobs GROUP BY "user" HAVING count(*) >= 0.005e0 * (SELECT count("user") FROM split_jobs)""",
)
def heavy_users(spark, sf):
    # The sketches name candidates; their exact counts decide.
    df = split_table(spark, sf)
    days = sketches.frequent_sketches(df.withColumn("day", F.to_date("submit_time")), "user", ["day"])
    named = sketches.heavy_keys(materialize(days, "user-sketches"), "user", share=0.005)
    counted = df.join(F.broadcast(named.select("user")), "user").groupBy("user").agg(F.count(F.lit(1)).alias("n"))
    least = only_row(df.agg((F.count("user") * 0.005).alias("n")))["n"]
    return counted.where(F.col("n") >= least)


@query(
    "colocated_lookup",
    """SELECT j.job_id, a.accuracy FROM jobs j LEFT JOIN
         (SELECT "user", round(avg(wallclock_req / greatest(run_time, 1)), 6) AS accuracy FROM jobs WHERE state = 'COMPLETED' GROUP BY 1) a
       ON j."user" = a."user" """,
)
def colocated_lookup(spark, sf):
    df = jobs(spark, sf).select("job_id", "user", "state", "wallclock_req", "run_time")
    heavy = materialize(sketches.heavy_keys(sketches.frequent_sketches(df, "user"), "user"), "heavy-users")
    known = aggregates.user_accuracy(df.where(F.col("state") == "COMPLETED"))
    log, table = layout.colocated(df, known, "user", heavy, ["job_id"], spark.sparkContext.defaultParallelism)
    return rounded(layout.colocated_lookup(log, table, "user").select("job_id", "accuracy"), "accuracy")


# --- evaluation -------------------------------------------------------------------------------

_metric_names = ["mae", "rmse", "r2", "mape"]


@query(
    "regression_metrics",
    "SELECT model, split, n, " + ", ".join(f"round({m}, 6) AS {m}" for m in _metric_names) + " FROM sample_metrics",
)
def regression_metrics(spark, sf):
    return rounded(evaluation.regression_metrics(sample_predictions(spark, sf)), *_metric_names)


@query(
    "error_percentiles",
    """SELECT model, round(quantile_cont(abs(e), 0.5), 6) AS p50_error, round(quantile_cont(abs(e), 0.9), 6) AS p90_error,
         round(quantile_cont(abs(e), 0.95), 6) AS p95_error FROM sample_errors WHERE split = 'test' GROUP BY model""",
)
def error_percentiles(spark, sf):
    found = evaluation.error_percentiles(sample_predictions(spark, sf))
    return rounded(found, "p50_error", "p90_error", "p95_error")


@query("ensemble_weights", "SELECT model, round(weight, 6) AS weight FROM sample_weights")
def ensemble_weights(spark, sf):
    metrics = evaluation.regression_metrics(sample_predictions(spark, sf))
    return rounded(evaluation.ensemble_weights(metrics), "weight")


@query(
    "ensemble_rows",
    """SELECT job_id, split, round(max(label), 6) AS label, round(sum(prediction * weight), 6) AS prediction
       FROM sample_predictions JOIN sample_weights USING (model) GROUP BY job_id, split""",
)
def ensemble_rows(spark, sf):
    scored = sample_predictions(spark, sf)
    weights = evaluation.ensemble_weights(evaluation.regression_metrics(scored))
    found = evaluation.ensemble_rows(scored, weights)
    return rounded(found.select("job_id", "split", "label", "prediction"), "label", "prediction")


@query(
    "best_model",
    """SELECT min_by(model, mae) AS best_model, min_by(model, mae) AS best_single, round(min(mae), 6) AS best_single_mae
       FROM sample_metrics WHERE split = 'val'""",
)
def best_model(spark, sf):
    return rounded(evaluation.best_model(evaluation.regression_metrics(sample_predictions(spark, sf))), "best_single_mae")


@query("accuracy_pct", "SELECT model, round(100 - mape, 6) AS accuracy_pct FROM sample_metrics WHERE split = 'val'")
def accuracy_pct(spark, sf):
    metrics = evaluation.regression_metrics(sample_predictions(spark, sf)).where(F.col("split") == "val")
    return metrics.select("model", F.round(R.accuracy_pct(F.col("mape")), 6).alias("accuracy_pct"))


# --- nested records ---------------------------------------------------------------------------


@query(
    "metrics_long",
    " UNION ALL ".join(f"SELECT model, '{m}' AS metric, round({m}, 6) AS value FROM sample_metrics WHERE split = 'val'" for m in _metric_names),
)
def metrics_long(spark, sf):
    metrics = evaluation.regression_metrics(sample_predictions(spark, sf)).where(F.col("split") == "val")
    return rounded(nested.metrics_long(nested.metrics_json(metrics, _metric_names)), "value")


@query(
    "importance_long",
    """SELECT model, CAST(row_number() OVER (PARTITION BY model ORDER BY share DESC, feature DESC) - 1 AS INTEGER) AS rank, feature, round(share, 6) AS importance
       FROM (SELECT split AS model, "partition" AS feature, count(*) / CAST(sum(count(*)) OVER (PARTITION BY split) AS DOUBLE) AS share
             FROM split_jobs GROUP BY split, "partition")""",
)
def importance_long(spark, sf):
    """Shares of each queue per split stand in for importances: {split: [{queue, share}]}."""
    counted = split_table(spark, sf).groupBy(F.col("split").alias("model"), F.col("partition").alias("feature")).agg(
        F.count(F.lit(1)).alias("n")
    )
    share = F.col("n") / F.sum("n").over(Window.partitionBy("model"))
    table = counted.select("model", "feature", share.alias("importance"))
    return rounded(nested.importance_long(nested.importance_json(table)), "importance")


@query(
    "weights_map",
    """SELECT round(max(weight) FILTER (WHERE model = 'a'), 6) AS weight_a, round(max(weight) FILTER (WHERE model = 'b'), 6) AS weight_b,
         round(max(weight) FILTER (WHERE model = 'c'), 6) AS weight_c, CAST(count(*) AS INTEGER) AS members FROM sample_weights""",
)
def weights_map(spark, sf):
    weights = evaluation.ensemble_weights(evaluation.regression_metrics(sample_predictions(spark, sf)))
    found = nested.weights_map(weights)
    m = F.col("ensemble_weights")
    return found.select(*[F.round(m[k], 6).alias(f"weight_{k}") for k in "abc"], F.size(m).alias("members"))


# --- reuse and history ------------------------------------------------------------------------


@query(
    "reuse_ratio",
    """SELECT CAST(sum(n) AS BIGINT) AS requests, count(*) AS distinct_requests, round(1 - count(*) / CAST(sum(n) AS DOUBLE), 6) AS hit_ratio
       FROM (SELECT count(*) AS n FROM service_requests WHERE valid
             GROUP BY processors_req, nodes_req, mem_req, wallclock_req, "partition", qos)""",
)
def reuse_ratio(spark, sf):
    return rounded(joins.reuse_ratio(skip_invalid(service_requests(spark, sf))), "hit_ratio")


_user_window = "(PARTITION BY \"user\" ORDER BY submit_time RANGE BETWEEN INTERVAL {0} DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)".format
_queue_window = "(PARTITION BY \"partition\" ORDER BY submit_time RANGE BETWEEN INTERVAL {0} HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)".format


@query(
    "user_history",
    'SELECT job_id, "user", '
    + ", ".join(f"count(*) OVER {_user_window(d)} AS user_jobs_{d}d" for d in (7, 30, 90))
    + ", "
    + ", ".join(f"round(avg(run_time) OVER {_user_window(d)}, 6) AS user_mean_runtime_{d}d" for d in (7, 30, 90))
    + " FROM jobs",
)
def user_history(spark, sf):
    found = history.user_history(jobs(spark, sf))
    return rounded(found, *[c for c in found.columns if "mean" in c])


@query(
    "queue_history",
    'SELECT job_id, "partition", '
    + ", ".join(f"count(*) OVER {_queue_window(h)} AS queue_jobs_{h}h" for h in (1, 6, 24))
    + ", "
    + ", ".join(f"CAST(coalesce(sum(processors_req) OVER {_queue_window(h)}, 0) AS BIGINT) AS queue_processors_{h}h" for h in (1, 6, 24))
    + " FROM jobs",
)
def queue_history(spark, sf):
    return history.queue_history(jobs(spark, sf))


@query(
    "active_connections",
    """SELECT at_us, CAST(sum(delta) OVER (ORDER BY at_us) AS BIGINT) AS active FROM (
         SELECT at_us, sum(delta) AS delta FROM (
           SELECT epoch_us(ts) AS at_us, 1 AS delta FROM requests
           UNION ALL SELECT epoch_us(ts) + CAST(round(latency_s * 1e6) AS BIGINT), -1 FROM requests) GROUP BY at_us)""",
)
def active_connections(spark, sf):
    return history.active_connections(requests(spark, sf))
