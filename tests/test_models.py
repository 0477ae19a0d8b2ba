import threading

import pytest
from pyspark.sql import functions as F

from queuelens.operators import evaluation
from queuelens.operators.filters import skip_invalid
from queuelens.plans import scoring, training
from queuelens.registry import catalog
from queuelens.sources import models as store

AS_OF = "2024-01-31 12:00:00"


@pytest.fixture(scope="module")
def ensemble(spark, sf):
    return catalog.trained(spark, sf)


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def test_weights_are_inverse_errors(ensemble):
    maes = {r["model"]: r["mae"] for r in ensemble.metrics.where("split = 'val' and model <> 'ensemble'").collect()}
    total = sum(1 / m for m in maes.values())
    assert ensemble.weights == pytest.approx({k: (1 / m) / total for k, m in maes.items()})
    assert sum(ensemble.weights.values()) == pytest.approx(1.0)
    assert ensemble.best == "ensemble"


def test_ensemble_beats_the_mean(spark, sf, ensemble):
    row = training.evaluate_test(catalog.split_table(spark, sf), ensemble).first()
    assert row["r2"] > 0 and row["p50_error"] <= row["p90_error"] <= row["p95_error"]


def test_importance_has_every_feature(ensemble):
    counts = {r["model"]: r["count"] for r in ensemble.importance.groupBy("model").count().collect()}
    assert counts == {m: 44 + (m == "categorical") for m in ensemble.models}  # the user's target statistic
    assert training.top_features(ensemble.importance, "boosted").count() == 10


def test_saved_models_predict_the_same(spark, sf, ensemble, tmp_path):
    loaded = store.load_models(spark, store.save_models(spark, ensemble, str(tmp_path / "m")))
    df = catalog.service_requests(spark, sf)
    a, b = ({r["request_id"]: r["predicted_runtime"] for r in scoring.score_batch(df, t).collect()} for t in (ensemble, loaded))
    assert a == b
    single = store.load_models(spark, str(tmp_path / "m"), only="forest")
    assert single.weights == {"forest": 1.0} and single.best == "forest"


def test_single_request_equals_batch(spark, sf, ensemble):
    df = catalog.service_requests(spark, sf)
    batch = {r["request_id"]: r["predicted_runtime"] for r in scoring.score_batch(df, ensemble).collect()}
    some = sorted(batch)[5]
    assert scoring.score_batch(df.where(F.col("request_id") == some), ensemble).first()["predicted_runtime"] == batch[some]


def test_distinct_scoring_gives_every_row_the_plain_answer(spark, sf, ensemble):
    df = catalog.service_requests(spark, sf).select("request_id", *scoring.REQUEST_KEY)
    plain = {r["request_id"]: r["predicted_runtime"] for r in scoring.score_batch(df, ensemble, _as_of()).collect()}
    shared = {r["request_id"]: r["predicted_runtime"] for r in scoring.score_batch_distinct(df, ensemble, _as_of()).collect()}
    assert shared == plain and len(plain) == skip_invalid(df).count()


def test_report_has_every_request_once(spark, sf, ensemble):
    df = catalog.service_requests(spark, sf)
    report = scoring.walltime_report(df, ensemble, ["request_id"])
    counts = {r["prediction_status"]: r["count"] for r in report.groupBy("prediction_status").count().collect()}
    assert sum(counts.values()) == df.count()
    failed = report.where("prediction_status = 'failed'").first()
    assert failed["predicted_runtime"] == 0.0 and failed["error"] and failed["efficiency"] is None


def test_metrics_by_hand(spark):
    rows = [("m", "val", float(F_), float(P)) for F_, P in ((0.0, 0.0), (1.0, 2.0), (2.0, 1.0))]
    df = spark.createDataFrame(rows, "model string, split string, label double, prediction double")
    import numpy as np

    a, p = np.expm1([0.0, 1.0, 2.0]), np.expm1([0.0, 2.0, 1.0])
    e = a - p
    got = evaluation.regression_metrics(df).first()
    assert got["mae"] == pytest.approx(np.abs(e).mean())
    assert got["rmse"] == pytest.approx(np.sqrt((e**2).mean()))
    assert got["r2"] == pytest.approx(1 - (e**2).sum() / ((a - a.mean()) ** 2).sum())
    assert got["mape"] == pytest.approx(100 * (np.abs(e) / np.maximum(a, 1)).mean())


def test_best_model_without_and_with_ensemble(spark):
    rows = [("a", "val", 3.0), ("b", "val", 2.0), ("b", "test", 0.1)]
    df = spark.createDataFrame(rows, "model string, split string, mae double")
    assert evaluation.best_model(df).first()["best_model"] == "b"
    more = df.union(spark.createDataFrame([("ensemble", "val", 9.0)], df.schema))
    assert tuple(evaluation.best_model(more).first()) == ("ensemble", "b", 2.0)


def test_encoded_columns_stay_categories_beyond_32_values(spark, job_rows):
    from datetime import datetime, timedelta, timezone

    first = datetime(2024, 1, 1, tzinfo=timezone.utc)
    jobs = job_rows(*[
        {"qos": f"q{i % 40:02}", "run_time": 600 + 900 * ((i % 40) % 2), "submit_time": first + timedelta(minutes=i)} for i in range(800)
    ])
    p = training.TrainingParams(members=("categorical",), max_iter=5)
    fitted = training.train_all(training.training_table(jobs), p)
    boosted = fitted.models["categorical"].stages[-1]
    qos = training.input_columns(fitted.models["categorical"], fitted.state.features).index("qos_encoded")
    rows = {r["rank"]: r["feature"] for r in fitted.importance.collect()}
    assert rows[1] == "qos_encoded"
    # Odd and even codes alternate, so one cut of a number line can't part them; one set of categories does.
    assert f"feature {qos} in" in boosted.trees[0].toDebugString
    unseen = jobs.limit(1).withColumn("qos", F.lit("new")).withColumn("request_id", F.lit(1))
    assert scoring.score_batch(unseen, fitted).count() == 1


def test_answers_and_model_info_carry_the_service_fields(spark, sf, ensemble):
    answer = scoring.score_batch(catalog.service_requests(spark, sf), ensemble).first()
    assert answer["runtime_category"] in ("short", "medium", "long", "very_long") and answer["prediction_confidence"] == 0.8
    assert len(answer["feature_importance"]) == 10 and answer["prediction_timestamp"] > 0
    info = store.model_info(spark, ensemble).first()
    assert info["training_date"] and info["test_mae"] > 0 and info["test_mape"] > 0 and info["validation_mae"] > 0
    assert set(info["tree_counts"]) == set(ensemble.models) and min(info["tree_counts"].values()) > 0


# --- where boosting stops, and target statistics


def test_best_round_with_a_loss_that_rises_and_falls_again(spark):
    losses = {"a": [5, 4, 6, 6, 3, 7, 7, 7, 1], "b": [2, 2, 2, 2], "c": [9, 8, 7]}
    rows = [(m, i + 1, float(x)) for m, values in losses.items() for i, x in enumerate(values)]
    frame = spark.createDataFrame(rows, training.ROUNDS_SCHEMA)
    got = {r["model"]: (r["rounds"], r["best_round"], r["best_loss"]) for r in evaluation.best_rounds(frame, 3).collect()}
    # a: the rise after round 2 is outlasted, the last round's low comes after the end; b: the first of equals.
    assert got == {"a": (8, 5, 3.0), "b": (4, 1, 2.0), "c": (3, 3, 7.0)}
    assert evaluation.best_rounds(frame, 50).where("model = 'a'").first()["best_round"] == 9
    assert evaluation.best_rounds(frame, 1).where("model = 'a'").first()["best_round"] == 2
    assert evaluation.best_rounds(frame.limit(0), 3).count() == 0


def test_members_keep_the_round_with_the_lowest_loss(spark, sf, ensemble):
    rounds = ensemble.rounds.collect()
    info = store.model_info(spark, ensemble).first()
    for name in ("boosted", "categorical"):
        curve = {r["round"]: r["loss"] for r in rounds if r["model"] == name}
        assert len(curve) == training.TrainingParams().max_iter
        best = min(curve, key=lambda i: (curve[i], i))
        seen = evaluation.best_rounds(ensemble.rounds, 50).where(F.col("model") == name).first()["best_round"]
        assert info["tree_counts"][name] == seen and (seen == best or best - seen > 50)


def test_cut_models_predict_as_their_first_trees(spark, sf, ensemble):
    frame = training.learning_frame(catalog.split_table(spark, sf), ensemble.state, targets=ensemble.targets)
    p = training.TrainingParams(max_iter=6, patience=2)
    model, losses = training.train_member("boosted", frame, p, ensemble.state)
    short = training.MEMBERS["boosted"](training.TrainingParams(max_iter=4), ensemble.state).fit(frame.where(~F.col("is_validation")))
    longer = training.MEMBERS["boosted"](training.TrainingParams(max_iter=6), ensemble.state).fit(frame.where(~F.col("is_validation")))
    cut = training.first_trees(spark, longer.stages[-1], 4)
    a, b = ([r["prediction"] for r in m.transform(frame).orderBy("job_id").collect()] for m in (short, cut))
    assert a == b and losses.count() == 6 and model.stages[-1].getNumTrees <= 6
    # Without validation rows nothing is cut.
    whole, none = training.train_member("boosted", frame.where(~F.col("is_validation")), p, ensemble.state)
    assert none is None and whole.stages[-1].getNumTrees == 6


def test_target_statistics_of_a_user_with_half_of_the_rows(spark, job_rows):
    from datetime import datetime, timedelta, timezone

    import numpy as np

    from queuelens.operators import target_stats

    first, rng = datetime(2024, 1, 1, tzinfo=timezone.utc), np.random.default_rng(5)
    rows = [
        {"user": ("hot" if i % 2 else [None, "a", "b", "c"][int(rng.integers(4))]), "run_time": int(rng.integers(1, 9999)),
         "submit_time": first + timedelta(seconds=int(rng.integers(0, 40_000)))} for i in range(400)
    ]
    rows[7]["submit_time"] = None
    frame = job_rows(*rows).withColumn("label", F.log1p(F.col("run_time").cast("double")))
    got = {r["job_id"]: r["user_target"] for r in target_stats.ordered_statistics(frame, "user", F.col("label"), 2.0).collect()}
    units = [round(float(np.log1p(r["run_time"])) * 1e6) for r in rows]
    for i, r in enumerate(rows):
        seen = [units[j] for j, o in enumerate(rows)
                if o["user"] == r["user"] and r["submit_time"] and o["submit_time"] and o["submit_time"] < r["submit_time"]]
        assert got[i] == pytest.approx((sum(seen) / 1e6 + 2.0) / (len(seen) + 1))
    totals = target_stats.category_totals(frame, ["user"], F.col("label"))
    new = target_stats.looked_up_statistics(job_rows({"user": "hot"}, {"user": "new"}, {"user": None}), totals, "user", 2.0).collect()
    hot, none = ([u for u, r in zip(units, rows) if r["user"] == name] for name in ("hot", None))
    assert [r["user_target"] for r in sorted(new, key=lambda r: r["job_id"])] == pytest.approx(
        [(sum(hot) / 1e6 + 2) / (len(hot) + 1), 2.0, (sum(none) / 1e6 + 2) / (len(none) + 1)]
    )


def test_categorical_member_reads_the_users_statistic(spark, job_rows):
    from datetime import datetime, timedelta, timezone

    first = datetime(2024, 1, 1, tzinfo=timezone.utc)
    jobs = job_rows(*[{"user": f"u{i % 60}", "run_time": 600 + 900 * (i % 60 % 2) + i * 37 % 101, "submit_time": first + timedelta(minutes=i)}
                    for i in range(900)])
    fitted = training.train_all(training.training_table(jobs), training.TrainingParams(members=("categorical",), max_iter=5))
    ranks = {r["feature"]: r["importance"] for r in fitted.importance.collect()}
    assert ranks[training.TARGET] > 0
    assert fitted.targets.count() == 60


def test_trees_are_fitted_by_as_many_tasks_as_cores(spark, sf, monkeypatch):
    fit, seen = training.train_member, []

    def watched(name, frame, p, state):
        seen.append((frame.rdd.getNumPartitions(), frame.count()))
        return fit(name, frame, p, state)

    monkeypatch.setattr(training, "train_member", watched)
    table, before = catalog.split_table(spark, sf), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        training.train_all(table, training.TrainingParams(members=("forest",), trees=2, forest_depth=2), catalog.state(spark, sf))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen == [(spark.sparkContext.defaultParallelism, table.where("split <> 'test'").count())]


def test_members_are_fitted_side_by_side_on_a_share_of_the_cores(spark, sf, monkeypatch):
    fit, seen, both = training.train_member, [], threading.Barrier(2, timeout=60)

    def watched(name, frame, p, state):
        both.wait()  # breaks unless two members are under way at once
        seen.append(frame.rdd.getNumPartitions())
        return fit(name, frame, p, state)

    monkeypatch.setattr(training, "train_member", watched)
    table, p = catalog.split_table(spark, sf), training.TrainingParams(members=("boosted", "forest"), max_iter=1, max_depth=2, trees=2, forest_depth=2)
    fitted = training.train_all(table, p, catalog.state(spark, sf))
    assert list(fitted.models) == ["boosted", "forest"]
    assert seen == [max(1, spark.sparkContext.defaultParallelism // 2)] * 2


# --- what the fit of the members costs besides the trees


def test_target_statistics_are_added_before_the_features(spark, sf, monkeypatch):
    """The shuffles of the running totals carry whole rows, so the features come after them; the rows are the same."""
    table, state = catalog.split_table(spark, sf), catalog.state(spark, sf)
    targets = training.fit_targets(table.where("split = 'train'"))
    known, seen = training.log_target(training.features.transform(table.where("split <> 'test'"), state)), []
    train = training.target_stats.ordered_statistics(known.where("split = 'train'"), "user", F.col("label"), training.prior_of(targets))
    wide = train.unionByName(training.with_targets(known.where("split = 'val'"), targets)).withColumn("is_validation", F.col("split") == "val")
    plain = training.assemble(wide, state.features, keep=["job_id", "split", "label", "is_validation", training.TARGET])
    ordered = training.target_stats.ordered_statistics

    def watched(df, *rest):
        seen.append(df.columns)
        return ordered(df, *rest)

    monkeypatch.setattr(training.target_stats, "ordered_statistics", watched)
    frame = training.learning_frame(table, state, targets=targets)
    assert "job_id" in seen[0] and "total_compute_units" not in seen[0]
    assert sorted(map(str, frame.collect())) == sorted(map(str, plain.collect()))


def test_every_member_scores_a_row_once(spark, sf, monkeypatch):
    predict, seen = training.member_predictions, []

    def watched(frame, models):
        seen.append(sorted(models))
        return predict(frame, models)

    monkeypatch.setattr(training, "member_predictions", watched)
    p = training.TrainingParams(members=("boosted", "forest"), max_iter=1, max_depth=2, trees=2, forest_depth=2)
    fitted = training.train_all(catalog.split_table(spark, sf), p, catalog.state(spark, sf))
    assert seen == [["boosted", "forest"]] * 2  # training and validation rows, and the test rows
    assert fitted.metrics.count() == 7


def test_small_tables_of_a_model_need_no_python_worker(ensemble):
    for df in (ensemble.importance, ensemble.rounds):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "LocalTableScan" in plan and "ExistingRDD" not in plan
