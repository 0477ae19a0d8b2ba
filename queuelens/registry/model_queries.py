"""Training, scoring and model reports.

Tree models have no SQL form. Queries named `..._check` compare their results with a second way to them, row by row, and
count the rows that agree; SQL counts the rows that there must be.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window, functions as F

from queuelens.operators import evaluation, target_stats
from queuelens.operators.filters import log_target, serving_defaults, skip_invalid
from queuelens.plans import features, scoring, training
from queuelens.registry.catalog import clean, query, rounded, service_requests, split_table, state, train_rows, trained
from queuelens.session import scratch_path
from queuelens.schema import MODEL_FEATURES
from queuelens.sources import models as model_store


_vector = ", ".join(f"round(coalesce(CAST(f.{c} AS DOUBLE), 0e0), 6) AS {c}" for c in MODEL_FEATURES)


@query(
    "assemble",
    f"""SELECT f.job_id, f.split, round(ln(1 + CAST(s.run_time AS DOUBLE)), 6) AS label, {_vector}
        FROM model_features f JOIN split_jobs s ON f.job_id = s.job_id WHERE f.split IN ('train', 'val')""",
)
def assemble(spark, sf):
    frame = training.learning_frame(split_table(spark, sf), state(spark, sf))
    values = frame.select("job_id", "split", "label", vector_to_array("features").alias("_values"))
    named = [F.col("_values")[i].alias(c) for i, c in enumerate(MODEL_FEATURES)]
    return rounded(values.select("job_id", "split", "label", *named), "label", *MODEL_FEATURES)


def _member(name, key):
    @query(key)
    def run(spark, sf):
        t = trained(spark, sf)  # fitted once in a session, with the library's own parameters
        frame = training.learning_frame(split_table(spark, sf), t.state, targets=t.targets)
        return evaluation.regression_metrics(training.scored_long(frame, {name: t.models[name]}))


_member("boosted", "train_gbt_a")
_member("forest", "train_gbt_b")
_member("categorical", "train_gbt_c")


@query("train_all")
def train_all(spark, sf):
    return trained(spark, sf).metrics


@query("ensemble_predict")
def ensemble_predict(spark, sf):
    t = trained(spark, sf)
    frame = training.learning_frame(split_table(spark, sf), t.state, targets=t.targets)
    scored = training.ensemble_predict(frame, t.models, t.weights)
    return scored.select("job_id", "split", "label", *[f"pred_{m}" for m in t.models], "prediction")


@query("evaluate_test")
def evaluate_test(spark, sf):
    return training.evaluate_test(split_table(spark, sf), trained(spark, sf))


@query("importance_ranked")
def importance_ranked(spark, sf):
    return trained(spark, sf).importance


@query("top10_features")
def top10_features(spark, sf):
    return training.top_features(trained(spark, sf).importance, "boosted")


@query("trained_best_model")
def trained_best_model(spark, sf):
    return evaluation.best_model(trained(spark, sf).metrics)


@query("model_info")
def model_info(spark, sf):
    return model_store.model_info(spark, trained(spark, sf))


@query("score_batch")
def score_batch(spark, sf):
    return scoring.score_batch(service_requests(spark, sf), trained(spark, sf)).select("request_id", *scoring.OUTPUTS)


@query("score_distinct_join")
def score_distinct_join(spark, sf):
    """Equal requests share one answer, so user and submission time play no part in it."""
    as_of = F.lit("2024-01-31 12:00:00").cast("timestamp")
    plain = service_requests(spark, sf).select("request_id", *scoring.REQUEST_KEY)
    return scoring.score_batch_distinct(plain, trained(spark, sf), as_of).select("request_id", "feature_key", *scoring.OUTPUTS)


@query("walltime_report")
def walltime_report(spark, sf):
    keep = ["request_id", "processors_req", "nodes_req"]
    return scoring.walltime_report(service_requests(spark, sf), trained(spark, sf), keep)


# --- stopping and target statistics, which SQL can state


@query("best_rounds", """
SELECT * FROM (
WITH losses AS (
  SELECT "partition" AS model, CAST(date_diff('day', (SELECT min(submit_time) FROM clean_jobs), submit_time) + 1 AS INTEGER) AS round,
    round(avg(run_time), 6) AS loss FROM clean_jobs WHERE "partition" IS NOT NULL GROUP BY 1, 2
), better AS (
  SELECT *, coalesce(loss < min(loss) OVER (PARTITION BY model ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS better
  FROM losses
), last AS (
  SELECT *, max(CASE WHEN better THEN round END) OVER (PARTITION BY model ORDER BY round ROWS UNBOUNDED PRECEDING) AS best FROM better
), ends AS (
  SELECT *, min(CASE WHEN round - best >= 4 THEN round END) OVER (PARTITION BY model) AS ended FROM last
)
SELECT model, max(round) AS rounds, max(best) AS best_round, min(loss) AS best_loss FROM ends
WHERE ended IS NULL OR round <= ended GROUP BY model
)
""")  # fmt: skip
def best_rounds(spark, sf):
    """The stopping rule over mean run times by day, which rise and fall as a loss does."""
    rows = clean(spark, sf).where(F.col("partition").isNotNull())
    start = rows.agg(F.to_date(F.min("submit_time")).alias("d")).first()["d"]
    day = F.datediff(F.to_date("submit_time"), F.lit(start)) + 1
    losses = rows.groupBy(F.col("partition").alias("model"), day.cast("int").alias("round")).agg(F.round(F.avg("run_time"), 6).alias("loss"))
    return evaluation.best_rounds(losses, 4)


def _ordered(column: str) -> str:
    before = f'(PARTITION BY "{column}" ORDER BY submit_time RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)'
    return f"(coalesce(sum(units) OVER {before}, 0) / 1e6 + prior) / (count(units) OVER {before} + 1)"


def _fitted(column: str) -> str:
    known = f'FROM labelled l WHERE l."{column}" IS NOT DISTINCT FROM o."{column}"'
    return f"(coalesce((SELECT sum(units) {known}), 0) / 1e6 + prior) / ((SELECT count(units) {known}) + 1)"


_TARGETS = ("partition", "qos", "user")


@query("target_statistics", f"""
SELECT * FROM (
WITH units AS (
  SELECT *, CAST(round(ln(1 + CAST(run_time AS DOUBLE)) * 1e6) AS BIGINT) AS units FROM split_jobs WHERE split IN ('train', 'val')
), prior AS (
  SELECT sum(units) / 1e6 / count(units) AS prior FROM units WHERE split = 'train'
), labelled AS (
  SELECT * FROM units, prior WHERE split = 'train'
)
SELECT job_id, split, {", ".join(f"round({_ordered(c)}, 6) AS {c}_target" for c in _TARGETS)} FROM labelled
UNION ALL
SELECT job_id, split, {", ".join(f"round({_fitted(c)}, 6) AS {c}_target" for c in _TARGETS)}
FROM (SELECT * FROM units, prior WHERE split = 'val') o
)
""")  # fmt: skip
def target_statistics(spark, sf):
    """Training rows see earlier rows alone, validation rows all training rows."""
    rows = log_target(split_table(spark, sf)).select("job_id", "split", "submit_time", "label", *_TARGETS)
    train, label = rows.where(F.col("split") == "train"), F.col("label")
    prior = target_stats.prior_label(train, label)
    totals, other = target_stats.category_totals(train, _TARGETS, label), rows.where(F.col("split") == "val")
    for column in _TARGETS:
        train = target_stats.ordered_statistics(train, column, label, prior)
        other = target_stats.looked_up_statistics(other, totals, column, prior)
    names = [f"{c}_target" for c in _TARGETS]
    return rounded(train.unionByName(other).select("job_id", "split", *names), *names)


# --- checks of the models' results


def _agree(a: str, b: str):
    """Equal up to the order in which doubles are added."""
    return F.abs(F.col(a) - F.col(b)) <= F.lit(1e-9) * F.greatest(F.lit(1.0), F.abs(F.col(a)))


_members = "(VALUES ('boosted'), ('categorical'), ('forest')) m(model)"


@query("train_rounds_check", """
SELECT m.model, count(*) AS rows, TRUE AS loss_agrees, TRUE AS trees_agree
FROM split_jobs, (VALUES ('boosted'), ('categorical')) m(model) WHERE split = 'val' GROUP BY m.model
""")  # fmt: skip
def train_rounds_check(spark, sf):
    """The loss of the round that was kept, against the predictions of the member that was cut there."""
    t, p = trained(spark, sf), training.TrainingParams()
    frame = training.learning_frame(split_table(spark, sf), t.state, targets=t.targets).where(F.col("split") == "val")
    kept = {name: m.stages[-1].getNumTrees for name, m in t.models.items()}
    trees = F.create_map(*[F.lit(x) for pair in kept.items() for x in pair])
    scored = training.scored_long(frame, {m: t.models[m] for m in ("boosted", "categorical")})
    missed = F.col("label") - F.col("prediction")
    found = scored.groupBy("model").agg(
        F.count("*").alias("rows"), F.avg(F.when(F.col("model") == "boosted", missed * missed).otherwise(F.abs(missed))).alias("loss")
    )
    told = found.join(evaluation.best_rounds(t.rounds, p.patience), "model")
    return told.select("model", "rows", _agree("loss", "best_loss").alias("loss_agrees"), (trees[F.col("model")] == F.col("best_round")).alias("trees_agree"))


@query("trained_metrics_check", f"""
SELECT m.model, split, count(*) AS n, TRUE AS agrees FROM split_jobs, (SELECT * FROM {_members} UNION ALL SELECT 'ensemble') m
WHERE split <> 'test' OR m.model = 'ensemble' GROUP BY 1, 2
""")  # fmt: skip
def trained_metrics_check(spark, sf):
    """The stored metrics of every member and the ensemble, against mean errors of their predictions."""
    t = trained(spark, sf)
    frame = training.learning_frame(split_table(spark, sf), t.state, targets=t.targets)
    together = training.ensemble_predict(frame, t.models, t.weights).withColumn("model", F.lit("ensemble"))
    columns = ["model", "split", "label", "prediction"]
    scored = training.scored_long(frame, t.models).select(columns).union(together.select(columns)).union(training.test_scores(split_table(spark, sf), t).select(columns))
    error = F.abs(F.exp("label") - F.exp("prediction"))
    found = scored.groupBy("model", "split").agg(F.count("*").alias("n"), F.avg(error).alias("own_mae"), F.sqrt(F.avg(error * error)).alias("own_rmse"))
    both = found.join(t.metrics.select("model", "split", F.col("n").alias("known"), "mae", "rmse"), ["model", "split"])
    same = (F.col("n") == F.col("known")) & _agree("mae", "own_mae") & _agree("rmse", "own_rmse")
    return both.select("model", "split", "n", same.alias("agrees"))


@query("ensemble_predict_check", "SELECT split, count(*) AS n, count(*) AS agreeing FROM split_jobs WHERE split <> 'test' GROUP BY split")
def ensemble_predict_check(spark, sf):
    """Each prediction against the weighted sum of its own member columns, by the stored weights."""
    t = trained(spark, sf)
    weights = F.create_map(*[F.lit(x) for pair in t.weights.items() for x in pair])
    parts = F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"pred_{m}").alias("p")) for m in t.models])
    sums = ensemble_predict(spark, sf).select("split", "prediction", F.aggregate(parts, F.lit(0.0), lambda a, x: a + weights[x["m"]] * x["p"]).alias("own"))
    return sums.groupBy("split").agg(F.count("*").alias("n"), F.count_if(_agree("prediction", "own")).alias("agreeing"))


@query("importance_check", f"""
SELECT m.model, CAST({len(MODEL_FEATURES)} + (m.model = 'categorical')::INT AS BIGINT) AS features, 1e0 AS total, TRUE AS ordered,
  (SELECT count(*) FROM split_jobs WHERE split = 'train') AS training_rows FROM {_members}
""")  # fmt: skip
def importance_check(spark, sf):
    """Ranks follow the importances, each feature once, and a member's importances add up to one."""
    t = trained(spark, sf)
    ranked = t.importance.withColumn("own", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("importance"), "feature")))
    rows = train_rows(spark, sf).count()
    return ranked.groupBy("model").agg(
        F.countDistinct("feature").alias("features"), F.round(F.sum("importance"), 6).alias("total"),
        F.every(F.col("rank") == F.col("own")).alias("ordered"), F.lit(rows).cast("bigint").alias("training_rows"),
    )


_scored = """SELECT "partition", count(*) AS scored, count(*) AS agreeing FROM service_requests WHERE valid GROUP BY "partition" """


def _both_ways(requests, first, second):
    """Requests of each partition with one answer both ways: the same run time, and a band around it."""
    a = first.select("request_id", F.col("predicted_runtime").alias("one"), "confidence_lower", "confidence_upper")
    b = second.select("request_id", F.col("predicted_runtime").alias("two"))
    same = _agree("one", "two") & (F.col("confidence_lower") <= F.col("one")) & (F.col("one") <= F.col("confidence_upper"))
    both = requests.select("request_id", "partition").join(a, "request_id").join(b, "request_id", "left")
    return both.groupBy("partition").agg(F.count("*").alias("scored"), F.count_if(same).alias("agreeing"))


@query("score_batch_check", _scored)
def score_batch_check(spark, sf):
    """Batch answers against the members' own predictions, put together by hand."""
    t, requests = trained(spark, sf), service_requests(spark, sf)
    rows = training.with_targets(features.transform(serving_defaults(skip_invalid(requests)), t.state), t.targets)
    wide = training.member_predictions(training.assemble(rows, t.state.features, keep=["request_id", training.TARGET]), t.models)
    total = sum((F.col(f"pred_{m}") * F.lit(w) for m, w in t.weights.items()), F.lit(0.0))
    by_hand = wide.select("request_id", F.greatest(F.expm1(total), F.lit(0.0)).alias("predicted_runtime"))
    return _both_ways(requests, scoring.score_batch(requests, t), by_hand)


@query("save_load_models_check", _scored)
def save_load_models_check(spark, sf):
    """Answers of the saved and loaded ensemble against those of the fitted one."""
    t, requests = trained(spark, sf), service_requests(spark, sf)
    loaded = model_store.load_models(spark, model_store.save_models(spark, t, scratch_path(spark, "models")))
    return _both_ways(requests, scoring.score_batch(requests, loaded), scoring.score_batch(requests, t))


@query("score_distinct_check", _scored)
def score_distinct_check(spark, sf):
    """Answers shared by equal requests against each request's own."""
    as_of = F.lit("2024-01-31 12:00:00").cast("timestamp")
    t, requests = trained(spark, sf), service_requests(spark, sf)
    plain = requests.select("request_id", *scoring.REQUEST_KEY)
    return _both_ways(requests, scoring.score_batch_distinct(plain, t, as_of), scoring.score_batch(plain, t, as_of))


@query("walltime_report_check", """
SELECT CASE WHEN valid THEN 'success' ELSE 'failed' END AS prediction_status, count(*) AS rows, count(DISTINCT request_id) AS requests
FROM service_requests GROUP BY 1
""")  # fmt: skip
def walltime_report_check(spark, sf):
    """Each request once, as scored or as failed."""
    report = walltime_report(spark, sf)
    return report.groupBy("prediction_status").agg(F.count("*").alias("rows"), F.countDistinct("request_id").alias("requests"))


@query("model_info_check", f"""
SELECT (SELECT count(*) FROM split_jobs) AS training_samples, {len(MODEL_FEATURES)} AS num_features, TRUE AS weights_add_up, TRUE AS errors_agree
""")  # fmt: skip
def model_info_check(spark, sf):
    """The service's description against the stored metrics and weights."""
    t = trained(spark, sf)
    info = model_store.model_info(spark, t)
    best = t.metrics.where((F.col("model") == t.best) & (F.col("split") == "test")).select(F.col("mae").alias("mae"), F.col("mape").alias("mape"))
    total = F.aggregate(F.map_values("ensemble_weights"), F.lit(0.0), lambda a, x: a + x)
    return info.join(F.broadcast(best)).select(  # one row each
        "training_samples", "num_features", (F.abs(total - 1) < 1e-9).alias("weights_add_up"),
        ((F.col("mae") == F.col("test_mae")) & (F.col("mape") == F.col("test_mape"))).alias("errors_agree"),
    )
