import pytest
from pyspark.sql import functions as F

from queuelens.operators.scaling import fit_scaler_params
from queuelens.plans import features, partials
from queuelens.registry import catalog
from queuelens.schema import MODEL_FEATURES
from queuelens.sources import state as store


@pytest.fixture(scope="module")
def fitted(spark, sf):
    return catalog.state(spark, sf)


def _rows(df):
    return {r["job_id"]: tuple(r[c] for c in MODEL_FEATURES) for r in df.collect()}


def test_one_row_scores_as_in_a_batch(spark, sf, fitted):
    table = catalog.split_table(spark, sf).where("split = 'test'")
    batch = _rows(features.transform(table, fitted))
    job = sorted(batch)[3]
    assert _rows(features.transform(table.where(F.col("job_id") == job), fitted)) == {job: batch[job]}


def test_all_features_are_there_and_filled(spark, sf, fitted):
    done = features.transform(catalog.jobs(spark, sf), fitted)
    assert [c for c in MODEL_FEATURES if c not in done.columns] == []
    assert done.where(" or ".join(f"{c} is null" for c in MODEL_FEATURES)).count() == 0


def test_unseen_user_and_queue(job_rows, fitted):
    row = features.transform(job_rows({"user": "nobody", "partition": "new", "qos": None}), fitted).first()
    assert row["user_mean_runtime"] == fitted.thresholds["train_mean_runtime"]
    assert (row["user_job_count"], row["user_accuracy_score"], row["user_frequency"]) == (1, 1.0, 1)
    assert (row["queue_load"], row["partition_encoded"], row["qos_encoded"]) == (0, -1, -1)


def test_missing_walltime_takes_the_training_median(job_rows, fitted):
    assert features.transform(job_rows({"wallclock_req": None}), fitted).first()["wallclock_req"] == fitted.thresholds["wallclock_median"]


def test_refuses_unfitted(job_rows):
    with pytest.raises(ValueError, match="fitted"):
        features.transform(job_rows({}), None)


def test_optional_columns_skip_their_features(job_rows):
    df = job_rows({}, {"run_time": 10}, {"processors_req": 32}).drop("name", "user", "start_time", "account")
    done, state = features.fit_transform(df)
    assert "is_mpi_job" not in done.columns and "user_job_count" not in done.columns and "queue_load" in done.columns


def test_base_features_only(job_rows):
    done, state = features.fit_transform(job_rows({}, {"processors_req": 32}), advanced=False)
    assert set(state.features) <= set(done.columns) and "is_night" not in done.columns


def test_scaler_fills_before_quartiles_and_guards_zero_spread(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0, 4.0), (2.0, 4.0), (None, 4.0), (10.0, 4.0), (inf, 4.0), (20.0, 4.0)], "a double, b double")
    params = fit_scaler_params(df, ["a", "b"])
    # Median of 1, 2, 10, 20 is 6; with both gaps filled: 1, 2, 6, 6, 10, 20.
    assert params["a"] == (6.0, 9.0 - 3.0)
    assert params["b"] == (4.0, 1.0)


def test_state_round_trip(spark, sf, fitted, tmp_path):
    loaded = store.load_features(spark, store.save_features(spark, fitted, str(tmp_path / "state")))
    table = catalog.split_table(spark, sf).where("split = 'val'")
    assert _rows(features.transform(table, loaded)) == _rows(features.transform(table, fitted))


def test_loading_nothing_or_another_version_fails(spark, fitted, tmp_path):
    with pytest.raises(ValueError, match="no fitted"):
        store.load_features(spark, str(tmp_path / "none"))
    path = store.save_features(spark, fitted, str(tmp_path / "old"))
    spark.range(1).select(F.lit("0.1").alias("version"), F.current_timestamp().alias("saved_at"), F.lit(True).alias("advanced")).write.mode("overwrite").parquet(f"{path}/meta")
    with pytest.raises(ValueError, match="version"):
        store.load_features(spark, path)


def test_stats_table(spark, sf):
    state = features.fit(catalog.train_rows(spark, sf), with_stats=True)
    names = {r["feature"] for r in state.stats.collect()}
    assert names == set(MODEL_FEATURES)


def _same_state(got, want):
    assert got.thresholds == pytest.approx(want.thresholds, rel=1e-9)
    assert list(got.scaler) == list(want.scaler)
    for c, params in want.scaler.items():
        assert got.scaler[c] == pytest.approx(params, rel=1e-9, abs=1e-9), c
    for table, keys in (("users", 1), ("queues", 2), ("codes", 2)):
        mine, theirs = getattr(got, table), getattr(want, table)
        rows = {tuple(r)[:keys]: tuple(r)[keys:] for r in mine.select(*theirs.columns).collect()}
        assert rows.keys() == {tuple(r)[:keys] for r in theirs.collect()}
        for r in theirs.collect():
            assert rows[tuple(r)[:keys]] == pytest.approx(tuple(r)[keys:], rel=1e-9)


def test_slices_added_one_after_the_other_equal_a_whole_fit(spark, sf, fitted, tmp_path):
    train, day = catalog.train_rows(spark, sf), F.to_date("submit_time")
    cuts = [r[0] for r in train.select(day.alias("d")).distinct().orderBy("d").collect()]
    early, late = train.where(day < cuts[len(cuts) // 2]), train.where(day >= cuts[len(cuts) // 2])
    path = str(tmp_path / "state")
    partials.add_slices(early, path)
    partials.add_slices(late, path)
    partials.add_slices(late, path)  # a slice that comes again replaces itself
    _same_state(partials.merged_state(spark, path), fitted)
    days = [str(c) for c in cuts[: len(cuts) // 2]]
    _same_state(partials.merged_state(spark, path, days), features.fit(early))


def test_slices_with_missing_values_equal_a_whole_fit(job_rows, tmp_path):
    rows = [
        {"user": ("hot", None, "b")[i % 3], "wallclock_req": None if i % 4 == 0 else 100.0 * (i % 7), "mem_req": None if i % 5 == 0 else 1.5 * i,
         "run_time": None if i % 6 == 5 else 60 * i, "partition": None if i % 9 == 0 else "gpu", "name": None if i % 8 == 0 else f"run_{i}"}
        for i in range(60)
    ]
    df = job_rows(*rows)
    path = partials.add_slices(df, str(tmp_path / "state"), F.coalesce("user", F.lit("none")))
    _same_state(partials.merged_state(df.sparkSession, path), features.fit(df))


def test_queues_and_dictionaries_are_learnt_side_by_side(job_rows, monkeypatch):
    import threading

    from queuelens.plans import features

    store, both = features.materialize, threading.Barrier(2, timeout=60)

    def watched(df, label, *rest):
        if label in ("queues", "codes"):
            both.wait()  # breaks unless both are under way at once
        return store(df, label, *rest)

    monkeypatch.setattr(features, "materialize", watched)
    state = features.fit(job_rows({"qos": "a"}, {"qos": "b"}, {"user": None}))
    assert state.users.count() == 1 and state.queues.count() == 1 and state.codes.where("column = 'qos'").count() == 3
