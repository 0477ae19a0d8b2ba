from datetime import datetime, timedelta, timezone

import pytest

from queuelens.operators import aggregates, monitoring

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def _log(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp, method string, status string, latency_s double, cache_hit boolean, retries int, batch_size int")


def _row(seconds=0, method="Predict", status="success", latency=0.01, hit=None, retries=0, batch=None):
    return (T0 + timedelta(seconds=seconds), method, status, latency, hit, retries, batch)


def test_histogram_quantile_inside_a_bucket_and_in_the_last(spark):
    log = _log(spark, [_row(latency=v) for v in (0.02, 0.02, 0.02, 0.2)])
    row = monitoring.latency_quantiles(log).first()
    # Rank 2 of 3 in (0.01, 0.025]; rank 3.8 and 3.96 lie in (0.1, 0.25].
    assert row["p50_ms"] == pytest.approx(1000 * (0.01 + 0.015 * 2 / 3))
    assert row["p95_ms"] == pytest.approx(1000 * (0.1 + 0.15 * 0.8))
    slow = monitoring.latency_quantiles(_log(spark, [_row(latency=99.0)])).first()
    assert (slow["p50_ms"], slow["p99_ms"]) == (2500.0, 2500.0)
    first = monitoring.latency_quantiles(_log(spark, [_row(latency=0.0005)])).first()
    assert first["p50_ms"] == pytest.approx(0.5)


def test_empty_histogram_is_null(spark):
    empty = _log(spark, [_row(status="error")])
    row = monitoring.histogram_quantiles(monitoring.answered(empty), "latency_s", [0.1, 1.0]).first()
    assert row["p50_ms"] is None


def test_histogram_is_cumulative_and_closed(spark):
    rows = {r["le"]: r["n"] for r in monitoring.latency_histogram(_log(spark, [_row(latency=0.005), _row(latency=9.0)])).collect()}
    assert rows["0.001"] == 0 and rows["0.005"] == 1 and rows["2.5"] == 1 and rows["+Inf"] == 2


def test_trailing_rate_slides_by_a_minute(spark):
    rates = {r["window_start"].minute: r["per_second"] for r in monitoring.rate_by_method(_log(spark, [_row(600), _row(661)])).collect()}
    assert rates == pytest.approx({6: 1 / 300, 7: 2 / 300, 8: 2 / 300, 9: 2 / 300, 10: 2 / 300, 11: 1 / 300})


def test_cache_rate_without_lookups_is_null(spark):
    assert {r["hit_pct"] for r in monitoring.cache_hit_rate(_log(spark, [_row()])).collect()} == {None}
    hits = monitoring.cache_hit_rate(_log(spark, [_row(hit=True), _row(hit=True), _row(hit=False), _row()])).first()
    assert hits["hit_pct"] == pytest.approx(100 * 2 / 3)


def test_average_latency_without_answers_is_zero(spark):
    assert monitoring.average_latency(_log(spark, [_row(status="error")])).first()["average_latency_ms"] == 0.0
    row = monitoring.average_latency(_log(spark, [_row(latency=0.2), _row(latency=0.4), _row(method="PredictBatch", latency=9.0)])).first()
    assert tuple(row) == (2, pytest.approx(300.0))


def test_last_hour_has_every_minute(spark):
    rows = aggregates.requests_per_minute(_log(spark, [_row(7200), _row(7201), _row(7140), _row(0)])).orderBy("minute").collect()
    assert len(rows) == 60 and [r["n"] for r in rows[-2:]] == [1, 2] and sum(r["n"] for r in rows) == 3


def test_batch_summary_ties_by_name(spark):
    df = spark.createDataFrame(
        [("success", "short", 10.0, 50.0), ("success", "long", 30.0, 100.0), ("failed", None, 0.0, None)],
        "prediction_status string, runtime_category string, predicted_runtime double, efficiency double",
    )
    row = aggregates.batch_summary(df).first()
    assert (row["total_jobs"], row["successful"], row["failed"]) == (3, 2, 1)
    assert (row["avg_predicted_runtime"], row["total_predicted_runtime"], row["avg_efficiency"]) == (20.0, 40.0, 75.0)
    assert row["most_common_category"] == "long"
    nothing = aggregates.batch_summary(df.where("prediction_status = 'failed'")).first()
    assert nothing["avg_predicted_runtime"] is None and nothing["most_common_category"] is None


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([(5.0,)] * 4, "predicted_runtime double")
    bins = aggregates.runtime_histogram(df).orderBy("bin").collect()
    assert len(bins) == 30 and bins[0]["n"] == 4 and sum(b["n"] for b in bins) == 4


def test_queue_size_is_not_clipped(spark):
    df = spark.range(20_001).selectExpr("timestamp'2024-01-01 00:00:30' AS ts", "'PredictStream' AS method")
    found = {(r["queue_size"], r["over_capacity"]) for r in monitoring.queue_size(df).collect()}
    assert found == {(20_001, True)}
