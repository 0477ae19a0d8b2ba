import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from queuelens import views
from queuelens.operators.filters import skip_invalid
from queuelens.plans import scoring
from queuelens.registry import QUERIES, catalog
from queuelens.sources import readers, writers
from queuelens.streaming import requests as streams


def test_stream_scores_equal_batch_scores(spark, sf):
    streamed = {r["request_id"]: r["predicted_runtime"] for r in QUERIES["stream_score"](spark, sf).collect()}
    batch = scoring.score_batch(catalog.service_requests(spark, sf), catalog.trained(spark, sf))
    assert streamed == {r["request_id"]: r["predicted_runtime"] for r in batch.collect()}


def test_every_request_goes_to_one_sink(spark, sf):
    good = {r["request_id"] for r in QUERIES["stream_sink"](spark, sf).collect()}
    bad = {r["request_id"] for r in QUERIES["stream_invalid_side_output"](spark, sf).collect()}
    assert not good & bad and len(good) + len(bad) == views.events(spark, sf).count()


REQUEST = "request_id bigint, processors_req int, nodes_req int, mem_req double, wallclock_req double, partition string, qos string, submit_time timestamp"


def _at(second):
    return None if second is None else datetime(2024, 1, 3, tzinfo=timezone.utc) + timedelta(seconds=second)


def _request(request_id, second, cpus=4):
    return (request_id, cpus, 1, 100.0, 60.0, "gpu", "normal", _at(second))


def _streamed(spark, folder, batches, schema, make, **options):
    """The result of a stream that reads one file per micro-batch, and its query."""
    source = f"{folder}/in"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = make(readers.stream_source(spark, source, spark.createDataFrame([], schema).schema, files_per_trigger=1))
    running = writers.stream_sink(stream, f"{folder}/out", f"{folder}/checkpoint")
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out"), running


def _reused(spark, folder, batches):
    found, _ = _streamed(spark, folder, batches, REQUEST, streams.stream_reuse)
    rows = found.collect()
    assert len(rows) == len({r["request_id"] for r in rows})
    return {r["request_id"]: r["reused"] for r in rows}


def test_an_answer_serves_300_seconds_from_its_request(spark, tmp_path):
    rows = [_request(0, 0), _request(1, 299), _request(2, 300), _request(3, 301), _request(4, 601), _request(5, 602)]
    rows += [_request(6, 10, cpus=8), _request(7, 20, cpus=0), _request(8, None)]
    want = {0: False, 1: True, 2: True, 3: False, 4: True, 5: False, 6: False, 8: False}
    assert _reused(spark, tmp_path, [rows]) == want


def test_reuse_is_the_same_for_any_cut_into_micro_batches(spark, tmp_path):
    rows = [_request(i, 97 * i + 40 * (i % 3), cpus=1 + i % 3) for i in range(100)]
    rows.sort(key=lambda r: r[-1])
    whole = _reused(spark, tmp_path / "one", [rows])
    cut = _reused(spark, tmp_path / "five", [rows[i : i + 20] for i in range(0, 100, 20)])
    assert whole == cut and len(whole) == 100 and 0 < sum(whole.values()) < 97


def test_reuse_calls_and_stores_per_group_of_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "KEY_GROUPS", 3, raising=False)
    # 40 keys in 3 groups over 3 micro-batches; a key's own answer alone decides.
    rows = [_request(i, 50 * (i // 40), cpus=1 + i % 40) for i in range(400)]
    schema, folder = REQUEST, tmp_path
    found, running = _streamed(spark, folder, [rows[:150], rows[150:290], rows[290:]], schema, streams.stream_reuse)
    assert {r["request_id"]: r["reused"] for r in found.collect()} == {i: (i // 40) % 7 != 0 for i in range(400)}
    states = [sum(o.numRowsTotal for o in p.stateOperators) for p in running.recentProgress]
    assert 0 < max(states) <= 3


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    def calls(seconds):
        return [(_at(s), "Predict") for s in seconds]

    day = 86_400
    # A batch is late by the watermark that the batch before it had closed windows with.
    batches = [calls([1, 2, 3]), calls([day]), calls([day + 1]), calls([4, 5, 6, 7, 8, day + 2])]
    found, running = _streamed(spark, tmp_path, batches, "ts timestamp, method string", streams.request_rate)
    assert [(r["window_start"].minute, r["n"]) for r in found.collect()] == [(0, 3)]  # the last day's window is still open
    assert writers.dropped_late(running) >= 1


def test_events_in_any_files_are_replayed_in_order(spark, tmp_path):
    rows = [(_at(97 * i), ("Predict", "Health")[i % 2]) for i in range(700)] + [(_at(97 * 300), "Predict")] * 3
    schema = "ts timestamp, method string"
    whole, _ = _streamed(spark, tmp_path / "one", [rows], schema, streams.request_rate)
    mixed = f"{tmp_path}/mixed"
    spark.createDataFrame(rows, schema).repartition(70).write.parquet(mixed)
    files = sorted(f for f in os.listdir(mixed) if f.startswith("part-"))
    for i, f in enumerate(files):
        os.utime(f"{mixed}/{f}", (1e9 + i * 7919 % 70, 1e9 + i * 7919 % 70))
    assert len(files) > 64
    source = spark.read.schema(schema).parquet(mixed)
    path = readers.in_time_order(source, "ts", f"{tmp_path}/ordered", 6)
    stream = streams.request_rate(readers.stream_source(spark, path, source.schema, files_per_trigger=2))
    running = writers.stream_sink(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    running.awaitTermination()
    found = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")
    assert sorted(found.collect()) == sorted(whole.collect()) and writers.dropped_late(running) == 0
    assert sum(p.numInputRows > 0 for p in running.recentProgress) == 3


def test_a_folder_of_no_rows_can_be_replayed(spark, tmp_path):
    none = spark.createDataFrame([], "ts timestamp, method string")
    path = readers.in_time_order(none, "ts", f"{tmp_path}/none", 4)
    assert spark.read.schema(none.schema).parquet(path).count() == 0


@pytest.mark.parametrize("kind", ["parquet", "json"])
@pytest.mark.parametrize("entered", [False, True])
def test_a_batch_that_failed_before_its_commit_is_there_once(spark, tmp_path, monkeypatch, kind, entered):
    source, enter, fails = f"{tmp_path}/in", writers._enter, [2]
    for batch in range(3):
        spark.range(batch * 10, batch * 10 + 10).coalesce(1).write.mode("append").parquet(source)

    def failing(entry, path):
        fails[0] -= 1
        if entered or fails[0] != 0:
            enter(entry, path)
        if fails[0] == 0:
            raise OSError("lost between write and commit")

    def run(name="a"):
        stream = readers.stream_source(spark, source, spark.range(0).schema, files_per_trigger=1)
        query = writers.ledger_sink(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint-{name}", name, kind)
        query.awaitTermination()

    def rows():
        return sorted(r["id"] for r in writers.read_ledgered(spark, f"{tmp_path}/out", spark.range(0).schema, kind).collect())

    monkeypatch.setattr(writers, "_enter", failing)
    with pytest.raises(StreamingQueryException):
        run()
    assert rows() == list(range(20 if entered else 10))
    run()
    assert rows() == list(range(30))
    ledger = writers.read_ledger(spark, f"{tmp_path}/out").collect()
    assert sorted((r["batch"], r["n_rows"]) for r in ledger) == [(0, 10), (1, 10), (2, 10)]
    run("b")  # another checkpoint counts its batches from 0 again and overwrites none of the first run's
    assert rows() == sorted([*range(30), *range(30)])


def test_sliding_windows_hold_each_call_five_times(spark, tmp_path):
    rows = [(_at(30), "Predict"), (_at(3600), "Predict")]
    found, _ = _streamed(spark, tmp_path, [rows], "ts timestamp, method string", streams.sliding_rate)
    assert [r["per_second"] for r in found.collect()] == [1 / 300] * 5


def test_batch_and_stream_share_validation(spark, sf):
    df = catalog.service_requests(spark, sf)
    assert skip_invalid(df).count() == QUERIES["stream_sink"](spark, sf).count()
    assert df.where(F.col("qos") == "").count() > 0
