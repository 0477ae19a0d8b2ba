"""From a job log to a weighted ensemble of tree models."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler, VectorIndexer, VectorSlicer
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from queuelens.operators import evaluation, target_stats
from queuelens.operators.filters import clean_jobs_fixed, fixed_cuts, log_target, observed_clean
from queuelens.operators.splits import split_label
from queuelens.plans import features
from queuelens.session import materialize, over_cores, side_by_side

METRICS = ["mae", "rmse", "r2", "mape"]
#: Features whose numbers are codes without an order.
NOMINAL = ("partition_encoded", "qos_encoded")
#: The category without a code of its own; the categorical member reads its target statistic.
TARGET = "user_target"
ROUNDS_SCHEMA = "model string, round int, loss double"
SCORED = ["job_id", "split", "label"]
#: Training rows that one task keeps and goes over for each level of a tree.
TASK_ROWS = 500_000


@dataclass(frozen=True)
class TrainingParams:
    """One explicit set of parameters for all members."""

    members: tuple[str, ...] = ("boosted", "forest", "categorical")
    max_iter: int = 60
    max_depth: int = 6
    step_size: float = 0.1
    subsampling: float = 0.8
    max_bins: int = 256
    trees: int = 40
    forest_depth: int = 8
    # Rounds that boosting goes on without a lower validation loss; the rounds after the best one are cut off.
    patience: int = 50
    seed: int = 42
    use_log: bool = True


@dataclass(frozen=True)
class TrainedEnsemble:
    models: dict[str, PipelineModel]
    weights: dict[str, float]
    metrics: DataFrame
    importance: DataFrame
    state: features.FeatureState
    rounds: DataFrame | None = None
    targets: DataFrame | None = None
    info: dict[str, str] = field(default_factory=dict)

    @property
    def best(self) -> str:
        return "ensemble" if len(self.models) > 1 else next(iter(self.models))


def training_table(jobs: DataFrame) -> DataFrame:
    """Cleaned rows with their split, stored once with a folder per split.

    Trimming cuts and split keys are searched for first (narrow scans), so that the log is then
    filtered, labelled and written in a single pass without a shuffle.
    """
    return training_table_and_funnel(jobs)[0]


def training_table_and_funnel(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The training table, and how many rows each cleaning stage left, counted by the pass that wrote it."""
    cuts = fixed_cuts(jobs)
    label = split_label(clean_jobs_fixed(jobs, cuts=cuts))
    rows, funnel = observed_clean(jobs, cuts)
    table = materialize(rows.withColumn("split", label), "split-jobs", partition_by=("split",))
    return table, funnel()


def assemble(frame: DataFrame, columns: list[str], output: str = "features", keep: list[str] | None = None) -> DataFrame:
    """The feature vector in column order; missing values and absent columns are 0."""
    have, zero = set(frame.columns), F.lit(0.0)
    values = [(F.coalesce(F.col(c).cast("double"), zero) if c in have else zero).alias(f"_f_{c}") for c in columns]
    filled = frame.select(*(keep or frame.columns), *values)
    vector = VectorAssembler(inputCols=[f"_f_{c}" for c in columns], outputCol=output, handleInvalid="keep")
    return vector.transform(filled).drop(*[f"_f_{c}" for c in columns])


def fit_targets(train: DataFrame, use_log: bool = True) -> DataFrame:
    """(column, value, n, total, prior): what the training rows' labels say of each user."""
    label = F.col("label")
    rows = log_target(train, use_log=use_log)
    prior = target_stats.prior_label(rows, label)
    return materialize(target_stats.category_totals(rows, ["user"], label).withColumn("prior", F.lit(prior)), "targets")


def prior_of(targets: DataFrame) -> float:
    row = targets.select("prior").first()
    return row["prior"] if row else 0.0


def with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds the fitted target statistics; rows without the column have the prior."""
    if "user" not in rows.columns:
        return rows.withColumn(TARGET, F.lit(prior_of(targets)))
    return target_stats.looked_up_statistics(rows, targets, "user", prior_of(targets))


def learning_frame(table: DataFrame, state: features.FeatureState, use_log: bool = True, targets: DataFrame | None = None) -> DataFrame:
    """(job_id, split, label, is_validation, features) of the training and validation rows.

    With `targets` also the user's target statistic: of training rows from the rows before alone, of the others as fitted.
    """
    rows = log_target(table.where(F.col("split").isin("train", "val")), use_log=use_log)
    keep = ["job_id", "split", "label", "is_validation"]
    if targets is not None:
        # Before the features, so that the shuffles of the running totals carry the log's columns alone.
        train = target_stats.ordered_statistics(rows.where(F.col("split") == "train"), "user", F.col("label"), prior_of(targets))
        rows = train.unionByName(with_targets(rows.where(F.col("split") == "val"), targets))
        keep = [*keep, TARGET]
    rows = features.transform(rows, state)
    rows = rows.withColumn("is_validation", F.col("split") == "val")
    return assemble(rows, state.features, keep=keep)


def dealt_for_trees(frame: DataFrame, rows: int, members: int = 1) -> DataFrame:
    """The rows dealt evenly over the cores that a member has while all are fitted side by side, in one order.

    Every task of a tree's level reads the trees so far and hands on the histograms of all its nodes, however few rows it has.
    So a member has as many tasks as its share of the cores, and more only for more than `TASK_ROWS` a task. In one order a
    rerun draws the same samples.
    """
    cores = max(1, frame.sparkSession.sparkContext.defaultParallelism // members)
    tasks = cores * max(1, math.ceil(rows / (cores * TASK_ROWS)))
    return frame.repartition(tasks, "job_id", "label").sortWithinPartitions("job_id", "label")


def boosted_trees(p: TrainingParams, state: features.FeatureState) -> Pipeline:
    """Boosted trees on squared error, stopped by the validation rows."""
    return Pipeline(stages=[_boosting(p, "features", "squared")])


def forest(p: TrainingParams, state: features.FeatureState) -> Pipeline:
    """A second, differently built member: independent deep trees on bootstrap samples."""
    return Pipeline(
        stages=[
            RandomForestRegressor(
                featuresCol="features", labelCol="label", predictionCol="prediction", numTrees=p.trees,
                maxDepth=p.forest_depth, maxBins=p.max_bins, subsamplingRate=p.subsampling, seed=p.seed,
            )
        ]
    )


def categorical_trees(p: TrainingParams, state: features.FeatureState) -> Pipeline:
    """Boosted trees on absolute error that treat the encoded columns, and no others, as categories.

    Room for categories follows the fitted dictionaries, so none turns into a number as it grows. Users are too many
    for that; they come as an ordered target statistic.
    """
    columns = state.features
    codes = [i for i, c in enumerate(columns) if c in NOMINAL]
    plain = [i for i, c in enumerate(columns) if c not in NOMINAL]
    # One count of the dictionary: its longest column, and -1 for what it lacks.
    longest = state.codes.groupBy("column").count().agg(F.max("count")).first()[0] or 0
    values = max(2, longest + 1)
    stages = [
        VectorSlicer(inputCol="features", outputCol="plain", indices=plain),
        VectorSlicer(inputCol="features", outputCol="codes", indices=codes),
        VectorIndexer(inputCol="codes", outputCol="categories", maxCategories=values, handleInvalid="keep"),
        VectorAssembler(inputCols=["plain", "categories", TARGET], outputCol="indexed", handleInvalid="keep"),
    ]
    return Pipeline(stages=[*stages, _boosting(replace(p, max_bins=max(p.max_bins, values + 1)), "indexed", "absolute")])


def input_columns(model: PipelineModel, columns: list[str]) -> list[str]:
    """The feature names in the order in which the model's trees number them."""
    if len(model.stages) == 1:
        return columns
    return [*[c for c in columns if c not in NOMINAL], *[c for c in columns if c in NOMINAL], TARGET]


def _boosting(p: TrainingParams, columns: str, loss: str) -> GBTRegressor:
    return GBTRegressor(
        featuresCol=columns, labelCol="label", predictionCol="prediction", lossType=loss, maxIter=p.max_iter,
        maxDepth=p.max_depth, stepSize=p.step_size, subsamplingRate=p.subsampling, maxBins=p.max_bins, seed=p.seed,
    )


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A model's few numbers as a table. As Arrow they need no Python worker on the executors, which takes seconds to start."""
    fields = StructType.fromDDL(schema)
    columns = [[r[i] for r in rows] for i in range(len(fields))]
    arrow = pa.table(dict(zip(fields.names, columns)), schema=to_arrow_schema(fields))
    return spark.createDataFrame(arrow, schema=fields)


def first_trees(spark: SparkSession, model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The boosted model after its first `n` rounds."""
    java, gateway = model._java_obj, spark.sparkContext._gateway
    ml = gateway.jvm.org.apache.spark.ml
    trees, weights = list(java.trees())[:n], list(java.treeWeights())[:n]
    kept, shares = gateway.new_array(ml.regression.DecisionTreeRegressionModel, n), gateway.new_array(gateway.jvm.double, n)
    for i in range(n):
        kept[i], shares[i] = trees[i], weights[i]
    cut = GBTRegressionModel(ml.regression.GBTRegressionModel(java.uid(), kept, shares, java.numFeatures()))
    return cut.setFeaturesCol(model.getFeaturesCol()).setPredictionCol(model.getPredictionCol())


def staged_losses(name: str, model: PipelineModel, rows: DataFrame) -> DataFrame:
    """(model, round, loss) of every prefix of the member's trees over `rows`, from one pass over them."""
    boosted = model.stages[-1]
    ready = PipelineModel(model.stages[:-1]).transform(rows) if len(model.stages) > 1 else rows
    losses = boosted.evaluateEachIteration(ready, boosted.getLossType())
    return small_table(rows.sparkSession, [(name, i + 1, float(x)) for i, x in enumerate(losses)], ROUNDS_SCHEMA)


MEMBERS: dict[str, Callable[[TrainingParams, features.FeatureState], Pipeline]] = {
    "boosted": boosted_trees,
    "forest": forest,
    "categorical": categorical_trees,
}


def train_member(
    name: str, frame: DataFrame, p: TrainingParams, state: features.FeatureState
) -> tuple[PipelineModel, DataFrame | None]:
    """Fits one member on the training rows: the model, and for boosted members the loss of every round.

    All rounds are fitted; the validation rows then tell where patience would have run out, and the trees behind the best
    round before that are cut off. Without validation rows all stay.
    """
    model = MEMBERS[name](p, state).fit(frame.where(~F.col("is_validation")))
    boosted, checked = model.stages[-1], frame.where("is_validation")
    if not isinstance(boosted, GBTRegressionModel) or checked.isEmpty():
        return model, None
    losses = staged_losses(name, model, checked)
    kept = evaluation.best_rounds(losses, p.patience).first()["best_round"]
    return PipelineModel([*model.stages[:-1], first_trees(frame.sparkSession, boosted, kept)]), losses


def train_members(
    frame: DataFrame, p: TrainingParams, state: features.FeatureState
) -> dict[str, tuple[PipelineModel, DataFrame | None]]:
    """Fits the members side by side; none needs another one.

    A tree's level is a short job that the next one waits for, so the jobs of one member leave the cores idle between them.
    """
    frame.count()  # stored once, before the members read it at the same time
    fits = [lambda name=name: train_member(name, frame, p, state) for name in p.members]
    return dict(zip(p.members, side_by_side(frame.sparkSession, *fits)))


def member_predictions(frame: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    """One column `pred_<member>` per model, in log space."""
    for name, model in models.items():
        frame = model.transform(frame).withColumnRenamed("prediction", f"pred_{name}").drop(*_outputs(model))
    return frame


def _outputs(model: PipelineModel) -> list[str]:
    return [s.getOutputCol() for s in model.stages if s.hasParam("outputCol")]


def scored_long(frame: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    """(job_id, split, label, model, prediction), one row per member."""
    return long_scores(member_predictions(frame, models), list(models))


def long_scores(wide: DataFrame, members: list[str]) -> DataFrame:
    """The members' columns `pred_<member>` as rows."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"pred_{m}").alias("prediction")) for m in members])
    return wide.select(*SCORED, F.explode(pairs).alias("p")).select(*SCORED, "p.*")


def ensemble_predict(frame: DataFrame, models: dict[str, PipelineModel], weights: dict[str, float]) -> DataFrame:
    """Adds `prediction`: the weighted sum of the members in log space."""
    return weighted(member_predictions(frame, models), {name: weights[name] for name in models})


def weighted(wide: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds `prediction`: the sum of the columns `pred_<member>` by their weights."""
    total = F.lit(0.0)
    for name in sorted(weights):  # one order of summing, so that reloaded models agree to the last bit
        total = total + F.col(f"pred_{name}") * F.lit(weights[name])
    return wide.withColumn("prediction", total)


def importance_ranked(models: dict[str, PipelineModel], columns: list[str], frame: DataFrame) -> DataFrame:
    """(model, rank, feature, importance), most important first.

    The importances are model parameters: one number per feature and member.
    """
    rows = []
    for name, model in models.items():
        scores = model.stages[-1].featureImportances.toArray().tolist()
        ordered = sorted(zip(input_columns(model, columns), scores), key=lambda p: (-p[1], p[0]))
        rows += [(name, i + 1, f, float(s)) for i, (f, s) in enumerate(ordered)]
    return small_table(frame.sparkSession, rows, "model string, rank int, feature string, importance double")


def importance_map(trained: TrainedEnsemble, n: int = 10) -> dict[str, float]:
    """The `n` features that count most over all members, by their weights: 44 numbers a member are read."""
    total: dict[str, float] = {}
    for r in trained.importance.collect():
        if r["model"] in trained.weights:
            total[r["feature"]] = total.get(r["feature"], 0.0) + trained.weights[r["model"]] * r["importance"]
    return dict(sorted(total.items(), key=lambda p: (-p[1], p[0]))[:n])


def top_features(importance: DataFrame, model: str, n: int = 10) -> DataFrame:
    return importance.where(F.col("model") == model).orderBy(F.desc("importance"), "feature").limit(n)


def train_all(table: DataFrame, params: TrainingParams | None = None, state: features.FeatureState | None = None) -> TrainedEnsemble:
    """Fits the features and every member, and weighs the members by validation error."""
    p = params or TrainingParams()
    state = state or features.fit(table.where(F.col("split") == "train"))
    targets = fit_targets(table.where(F.col("split") == "train"), p.use_log)
    rows = table.count()
    # Stored first: each of the hundreds of jobs of the trees hands its tasks all that its rows are made of, plans included.
    known = materialize(learning_frame(table, state, p.use_log, targets), "learning-frame")
    frame = dealt_for_trees(known, rows, len(p.members)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fits = train_members(frame, p, state)
    finally:
        frame.unpersist()
    models = {name: model for name, (model, _) in fits.items()}
    rounds = small_table(table.sparkSession, [], ROUNDS_SCHEMA)
    for _, losses in fits.values():
        rounds = rounds if losses is None else rounds.union(losses)
    # Every row is scored once by every member; the ensemble's metrics are a sum of these columns.
    scored = materialize(member_predictions(known, models).select(*SCORED, *[f"pred_{m}" for m in models]), "member-scores")
    metrics = materialize(evaluation.regression_metrics(long_scores(scored, list(models))), "metrics")
    # One weight per member.
    weights = {r["model"]: r["weight"] for r in evaluation.ensemble_weights(metrics).collect()}
    if len(models) > 1:
        together = weighted(scored, weights).withColumn("model", F.lit("ensemble"))
        combined = evaluation.regression_metrics(together.select("model", "split", "label", "prediction"))
        metrics = materialize(metrics.unionByName(combined), "metrics-all")
    importance = importance_ranked(models, state.features, table)
    info = {
        "version": "2.0", "model_type": "ensemble" if len(models) > 1 else p.members[0], "training_rows": str(rows),
        "training_date": datetime.now(timezone.utc).isoformat(timespec="seconds"),
    }
    fitted = TrainedEnsemble(models, weights, metrics, importance, state, rounds, targets, info)
    tested = materialize(evaluation.regression_metrics(test_scores(table, fitted, p.use_log)), "metrics-test")
    return replace(fitted, metrics=metrics.unionByName(tested))


def test_scores(table: DataFrame, trained: TrainedEnsemble, use_log: bool = True) -> DataFrame:
    """(model, split, label, prediction) of the best model on the test rows."""
    known = over_cores(table.where(F.col("split") == "test"))
    rows = log_target(features.transform(known, trained.state), use_log=use_log)
    frame = assemble(with_targets(rows, trained.targets), trained.state.features, keep=["job_id", "split", "label", TARGET])
    scored = ensemble_predict(frame, trained.models, trained.weights).withColumn("model", F.lit(trained.best))
    return scored.select("model", "split", "label", "prediction")


def evaluate_test(table: DataFrame, trained: TrainedEnsemble, use_log: bool = True) -> DataFrame:
    """Metrics and error percentiles of the best model on the test rows."""
    scored = test_scores(table, trained, use_log)
    return evaluation.regression_metrics(scored).join(evaluation.error_percentiles(scored), "model")
