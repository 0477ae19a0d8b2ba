from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from queuelens.operators import history

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def _brute(rows, key, days):
    out = {}
    for r in rows:
        for d in days:
            seen = [s for s in rows if s[key] == r[key] and r["t"] - timedelta(days=d) <= s["t"] < r["t"]]
            mean = sum(s["run_time"] for s in seen) / len(seen) if seen else None
            out[(r["job_id"], d)] = (len(seen), mean)
    return out


def test_user_history_of_a_hot_user_with_ties(spark):
    # One user owns most rows; many equal times, some exactly one window apart.
    rows = []
    for i in range(300):
        t = T0 + timedelta(hours=(i * 37) % 400, minutes=(i % 4) * 15)
        rows.append({"job_id": i, "user": "hot" if i % 3 else (None if i % 9 == 0 else f"u{i % 5}"), "t": t, "run_time": i * 11 % 97})
    rows += [{"job_id": 1000 + k, "user": "edge", "t": T0 + timedelta(days=7 * k), "run_time": 5} for k in range(4)]
    df = spark.createDataFrame([(r["job_id"], r["user"], r["t"], r["run_time"]) for r in rows],
                               "job_id bigint, user string, submit_time timestamp, run_time bigint")
    got = history.user_history(df).collect()
    expected = _brute(rows, "user", (7, 30, 90))
    assert len(got) == len(rows)
    for r in got:
        for d in (7, 30, 90):
            assert (r[f"user_jobs_{d}d"], r[f"user_mean_runtime_{d}d"]) == expected[(r["job_id"], d)]


def test_chunk_size_does_not_change_totals(spark):
    df = spark.range(500).select(
        F.col("id").alias("job_id"), F.lit("q").alias("partition"),
        F.timestamp_seconds(F.pmod(F.col("id") * 7919, F.lit(90_000))).alias("submit_time"), F.col("id").cast("int").alias("processors_req"),
    )
    args = ("partition", "job_id", F.unix_micros("submit_time"), {"n": F.lit(1), "p": F.col("processors_req")}, {"1h": history.HOUR})
    tables = [sorted(map(tuple, history.rolling_totals(df, *args, chunk_us=c).collect())) for c in (1_000_000, history.HOUR, 10 * history.DAY)]
    assert tables[0] == tables[1] == tables[2]


def test_active_connections_by_hand(spark):
    df = spark.createDataFrame([(T0, 2.0), (T0 + timedelta(seconds=1), 100.0), (T0 + timedelta(seconds=2), 0.5)], "ts timestamp, latency_s double")
    base = int(T0.timestamp() * 1e6)
    got = {(r["at_us"] - base) / 1e6: r["active"] for r in history.active_connections(df).collect()}
    assert got == {0.0: 1, 1.0: 2, 2.0: 2, 2.5: 1, 101.0: 0}


def test_no_row_is_lost_or_merged(spark):
    # Two rows share an id, one has no time, and one moment holds most rows of its key.
    rows = [(1, "u", T0, 10), (1, "u", T0 + timedelta(hours=1), 20), (2, "u", None, 5), (3, None, T0, 7)]
    rows += [(100 + i, "array", T0 + timedelta(hours=2), 1) for i in range(500)] + [(900, "array", T0 + timedelta(hours=3), 1)]
    df = spark.createDataFrame(rows, "job_id bigint, user string, submit_time timestamp, run_time bigint")
    got = history.user_history(df, days=(7,)).collect()
    assert len(got) == len(rows)
    seen = sorted((r["job_id"], r["user_jobs_7d"]) for r in got if r["job_id"] < 100)
    assert seen == [(1, 0), (1, 1), (2, 0), (3, 0)]
    assert {r["user_jobs_7d"] for r in got if 100 <= r["job_id"] < 900} == {0}
    assert [(r["user_jobs_7d"], r["user_mean_runtime_7d"]) for r in got if r["job_id"] == 900] == [(500, 1.0)]


def test_a_window_without_a_start_asks_once_a_moment(spark):
    rows = [(i, "ab"[i % 2], 600_000_000 * (i // 4) + i % 3, i) for i in range(60)] + [(60, None, 5, 1), (61, "a", None, 1)]
    df = spark.createDataFrame(rows, "id int, k string, t bigint, x bigint")
    found = history.rolling_totals(df, "k", "id", F.col("t"), {"x": F.col("x")}, {"ever": None, "hour": history.HOUR})
    got = {r["id"]: (r["x_ever"], r["x_hour"]) for r in found.collect()}
    before = {i: [(u, v) for _, j, u, v in rows if j == k and None not in (t, u) and u < t] for i, k, t, _ in rows}
    assert got == {i: (sum(v for _, v in before[i]), sum(v for u, v in before[i] if u >= t - history.HOUR) if t else 0) for i, _, t, _ in rows}
