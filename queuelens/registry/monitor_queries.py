"""Request-log metrics and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from queuelens import views
from queuelens.functions import reports as R
from queuelens.operators import aggregates, monitoring
from queuelens.operators.filters import skip_invalid
from queuelens.registry.catalog import out, query, replayed, requests, rounded, service_requests, state, trained
from queuelens.schema import LATENCY_BOUNDS
from queuelens.session import scratch_path
from queuelens.sources import readers, writers
from queuelens.streaming import requests as streams


@query("requests_total", "SELECT method, status, count(*) AS n FROM requests GROUP BY 1, 2")
def requests_total(spark, sf):
    return monitoring.requests_total(requests(spark, sf))


_sliding = "(SELECT *, unnest(generate_series(0, 4)) AS back FROM {0})".format
_start = "date_trunc('minute', ts) - to_minutes(back)"


@query(
    "rate_by_method",
    f"SELECT {_start} AS window_start, method, round(count(*) / 300.0e0, 6) AS per_second FROM {_sliding('requests')} GROUP BY 1, 2",
)
def rate_by_method(spark, sf):
    found = rounded(monitoring.rate_by_method(requests(spark, sf)), "per_second")
    return out(found, found.columns)


@query(
    "error_rate",
    f"""SELECT {_start} AS window_start, method, round(count(*) / 300.0e0, 6) AS per_second
        FROM {_sliding('requests')} WHERE status = 'error' GROUP BY 1, 2""",
)
def error_rate(spark, sf):
    found = rounded(monitoring.error_rate(requests(spark, sf)), "per_second")
    return out(found, found.columns)


@query(
    "retry_rate",
    f"SELECT {_start} AS window_start, method, round(sum(retries) / 300.0e0, 6) AS per_second FROM {_sliding('requests')} GROUP BY 1, 2",
)
def retry_rate(spark, sf):
    found = rounded(monitoring.retry_rate(requests(spark, sf)), "per_second")
    return out(found, found.columns)


@query(
    "cache_hit_rate",
    f"""SELECT {_start} AS window_start, round(100e0 * count(*) FILTER (WHERE cache_hit) / nullif(count(cache_hit), 0), 6) AS hit_pct
        FROM {_sliding('requests')} GROUP BY 1""",
)
def cache_hit_rate(spark, sf):
    found = rounded(monitoring.cache_hit_rate(requests(spark, sf)), "hit_pct")
    return out(found, found.columns)


@query(
    "queue_size",
    f"""SELECT {_start} AS window_start, count(*) AS queue_size, count(*) > 10000 AS over_capacity
        FROM {_sliding('requests')} WHERE method = 'PredictStream' GROUP BY 1""",
)
def queue_size(spark, sf):
    found = monitoring.queue_size(requests(spark, sf))
    return out(found, found.columns)


@query(
    "batch_size",
    """SELECT count(batch_size) AS batches, CAST(sum(batch_size) AS BIGINT) AS jobs, round(avg(batch_size), 6) AS avg_batch_size
       FROM requests WHERE method = 'PredictBatch'""",
)
def batch_size(spark, sf):
    return rounded(monitoring.batch_size(requests(spark, sf)), "avg_batch_size")


_served = "method = 'Predict' AND status = 'success'"


@query(
    "average_latency",
    f"""SELECT count(*) FILTER (WHERE {_served}) AS predictions_served,
          round(coalesce(sum(latency_s) FILTER (WHERE {_served}) / nullif(count(*) FILTER (WHERE {_served}), 0) * 1000, 0), 6) AS average_latency_ms
        FROM requests""",
)
def average_latency(spark, sf):
    return rounded(monitoring.average_latency(requests(spark, sf)), "average_latency_ms")


@query(
    "latency_recommendation",
    f"SELECT CASE WHEN avg(latency_s) * 1000 > 50 THEN 'High Latency' ELSE 'System Healthy' END AS recommendation FROM requests WHERE {_served}",
)
def latency_recommendation(spark, sf):
    found = monitoring.average_latency(requests(spark, sf))
    return found.select(R.latency_recommendation(F.col("average_latency_ms")).alias("recommendation"))


_bounds = [*[f"{b:g}" for b in LATENCY_BOUNDS], "+Inf"]


@query(
    "latency_histogram",
    " UNION ALL ".join(
        f"SELECT method, '{b}' AS le, count(*) FILTER (WHERE {'TRUE' if b == '+Inf' else f'latency_s <= {b}'}) AS n "
        "FROM requests WHERE status = 'success' GROUP BY method"
        for b in _bounds
    ),
)
def latency_histogram(spark, sf):
    return monitoring.latency_histogram(monitoring.answered(requests(spark, sf)))


def _quantile_sql(value: str, bounds: list[str], by: str) -> str:
    """Reads quantiles off the histogram with one row per bucket."""
    edges = ", ".join(f"({i}, {b}e0)" if "e" not in b else f"({i}, {b})" for i, b in enumerate(bounds))
    group = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    total = f"(SELECT {group}count(*) AS total FROM requests WHERE status = 'success' {'GROUP BY ' + by if by else ''})"
    counted = f"""(SELECT {group}i, b, count(*) FILTER (WHERE {value} <= b) AS c FROM requests CROSS JOIN (VALUES {edges}) e(i, b)
        WHERE status = 'success' GROUP BY {group}i, b)"""
    lagged = f"""(SELECT *, lag(c, 1, 0) OVER ({part} ORDER BY i) AS pc, lag(b, 1, 0e0) OVER ({part} ORDER BY i) AS pb FROM {counted})"""
    on = f"USING ({by})" if by else "ON TRUE"
    picks = ", ".join(
        f"round(1000 * coalesce(min(CASE WHEN c >= {q} * total AND pc < {q} * total THEN pb + (b - pb) * ({q} * total - pc) / (c - pc) END), {bounds[-1]}), 6) AS p{int(q * 100)}_ms"
        for q in (0.5, 0.95, 0.99)
    )
    return f"SELECT {group}{picks} FROM {lagged} JOIN {total} {on} {'GROUP BY ' + by if by else ''}"


@query("latency_quantiles", _quantile_sql("latency_s", [f"{b:g}" for b in LATENCY_BOUNDS], "method"))
def latency_quantiles(spark, sf):
    return rounded(monitoring.latency_quantiles(requests(spark, sf)), "p50_ms", "p95_ms", "p99_ms")


@query("inference_quantiles", _quantile_sql("inference_s", ["0.001", "0.005", "0.01", "0.025", "0.05", "0.1", "0.25"], ""))
def inference_quantiles(spark, sf):
    return rounded(monitoring.inference_quantiles(requests(spark, sf)), "p50_ms", "p95_ms", "p99_ms")


@query(
    "error_rate_hourly",
    """SELECT date_trunc('hour', ts) AS hour, round(100 * avg(CASE WHEN status = 'error' THEN 1e0 ELSE 0e0 END), 6) AS error_pct,
         100 * avg(CASE WHEN status = 'error' THEN 1e0 ELSE 0e0 END) > 1 AS over_limit FROM requests GROUP BY 1""",
)
def error_rate_hourly(spark, sf):
    found = rounded(aggregates.error_rate_hourly(requests(spark, sf)), "error_pct")
    return out(found, found.columns)


@query(
    "requests_per_minute",
    """SELECT minute, count(r.ts) AS n FROM (
         SELECT unnest(generate_series(m - INTERVAL 59 MINUTE, m, INTERVAL 1 MINUTE)) AS minute
         FROM (SELECT date_trunc('minute', max(ts)) AS m FROM requests)) g
       LEFT JOIN requests r ON date_trunc('minute', r.ts) = g.minute GROUP BY minute""",
)
def requests_per_minute(spark, sf):
    found = aggregates.requests_per_minute(requests(spark, sf))
    return out(found, found.columns)


# --- streams: each replays the events in their order, two micro-batches or more, to the end -----


def _event_stream(spark, sf):
    source, a_batch = views.events(spark, sf), spark.sparkContext.defaultParallelism
    path = replayed(spark, sf, source, files=max(2 * a_batch, source.rdd.getNumPartitions()))
    return readers.stream_source(spark, path, source.schema, files_per_trigger=a_batch)


def _request_stream(spark, sf):
    jobs = views.jobs_from_events(_event_stream(spark, sf))
    return views.job_requests_from_jobs(jobs).withColumnsRenamed({"cpus_req": "processors_req", "walltime_req": "wallclock_req"})


def _drained(spark, df, label):
    """Runs the stream to its end into Parquet and reads what arrived."""
    path, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
    writers.stream_sink(df, path, checkpoint).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


#: Only windows that the watermark has passed are appended.
_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM requests)"


@query("stream_source", "SELECT request_seq, ts, method, status, latency_s FROM requests")
def stream_source(spark, sf):
    log = views.requests_from_events(_event_stream(spark, sf)).select("request_seq", "ts", "method", "status", "latency_s")
    return out(_drained(spark, log, "stream-log"), log.columns)


@query("stream_sink", "SELECT request_id, processors_req, nodes_req, mem_req FROM service_requests WHERE valid")
def stream_sink(spark, sf):
    valid = skip_invalid(_request_stream(spark, sf)).select("request_id", "processors_req", "nodes_req", "mem_req")
    return _drained(spark, valid, "stream-valid")


@query("stream_ledger_sink", "SELECT request_id, processors_req, nodes_req, mem_req FROM service_requests WHERE valid")
def stream_ledger_sink(spark, sf):
    valid = skip_invalid(_request_stream(spark, sf)).select("request_id", "processors_req", "nodes_req", "mem_req")
    path, checkpoint = scratch_path(spark, "stream-ledger"), scratch_path(spark, "stream-ledger-checkpoint")
    writers.ledger_sink(valid, path, checkpoint, "replay").awaitTermination()
    return writers.read_ledgered(spark, path, valid.schema).select(*valid.columns)


@query("stream_invalid_side_output", "SELECT request_id, batch_id, idx FROM service_requests WHERE NOT valid")
def stream_invalid_side_output(spark, sf):
    bad = streams.stream_invalid(_request_stream(spark, sf)).select("request_id", "batch_id", "idx")
    return _drained(spark, bad, "stream-invalid")


@query(
    "stream_static_enrich",
    """SELECT r.request_id, coalesce(u.job_count, 1) AS user_job_count, round(coalesce(u.runtime_mean, train_mean_runtime), 6) AS user_mean_runtime,
         coalesce(q.job_count, 0) AS queue_load
       FROM service_requests r CROSS JOIN fit_cut LEFT JOIN user_table u ON r."user" = u."user"
       LEFT JOIN queue_table q ON r."partition" = q."partition" AND hour(r.submit_time) = q.submit_hour""",
)
def stream_static_enrich(spark, sf):
    rich = streams.stream_enrich(_request_stream(spark, sf), state(spark, sf))
    found = _drained(spark, rich.select("request_id", "user_job_count", "user_mean_runtime", "queue_load"), "stream-rich")
    return rounded(found, "user_mean_runtime")


@query("stream_score")
def stream_score(spark, sf):
    scored = streams.stream_score(_request_stream(spark, sf), trained(spark, sf))
    return _drained(spark, scored.select("request_id", "predicted_runtime", "confidence_lower", "confidence_upper"), "stream-scored")


@query(
    "stream_dedup_ttl",
    """SELECT request_id, submit_time, reused FROM (
         WITH RECURSIVE in_order AS (
           SELECT request_id, submit_time, key, row_number() OVER (PARTITION BY key ORDER BY submit_time, request_id) AS rn
           FROM (SELECT *, md5(concat_ws('~', processors_req, nodes_req, mem_req, wallclock_req, "partition", qos)) AS key
                 FROM service_requests WHERE valid)),
         chain AS (
           SELECT *, submit_time AS answered, FALSE AS reused FROM in_order WHERE rn = 1
           UNION ALL
           SELECT n.*, CASE WHEN n.submit_time <= c.answered + INTERVAL 300 SECOND THEN c.answered ELSE n.submit_time END,
                  n.submit_time <= c.answered + INTERVAL 300 SECOND
           FROM chain c JOIN in_order n ON n.key = c.key AND n.rn = c.rn + 1)
         SELECT * FROM chain)""",
)
def stream_dedup_ttl(spark, sf):
    answered = streams.stream_reuse(_request_stream(spark, sf))
    return out(_drained(spark, answered, "stream-reuse"), ["request_id", "submit_time", "reused"])


@query(
    "stream_request_rate",
    f"""SELECT window_start, method, count(*) AS n
        FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, method FROM requests)
        WHERE window_start + INTERVAL 5 MINUTE <= {_CLOSED} GROUP BY 1, 2""",
)
def stream_request_rate(spark, sf):
    rates = streams.request_rate(views.requests_from_events(_event_stream(spark, sf)))
    return out(_drained(spark, rates, "stream-rate"), ["window_start", "method", "n"])


@query(
    "stream_sliding_rate",
    f"""SELECT window_start, method, round(count(*) / 300.0e0, 6) AS per_second
        FROM (SELECT {_start} AS window_start, method FROM {_sliding('requests')})
        WHERE window_start + INTERVAL 5 MINUTE <= {_CLOSED} GROUP BY 1, 2""",
)
def stream_sliding_rate(spark, sf):
    rates = streams.sliding_rate(views.requests_from_events(_event_stream(spark, sf)))
    return out(rounded(_drained(spark, rates, "stream-sliding"), "per_second"), ["window_start", "method", "per_second"])
