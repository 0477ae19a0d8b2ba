"""Model quality from (model, split, label, prediction) rows in log space."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from queuelens.operators.quantiles import grouped_quantiles


def _in_seconds(scored: DataFrame) -> DataFrame:
    actual, predicted = F.expm1("label"), F.expm1("prediction")
    return scored.select("model", "split", actual.alias("a"), (actual - predicted).alias("e"))


def regression_metrics(scored: DataFrame) -> DataFrame:
    """MAE, RMSE, R2 and MAPE in seconds, per model and split, in one pass."""
    missed = F.abs("e")
    return _in_seconds(scored).groupBy("model", "split").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(missed).alias("mae"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.sum(F.col("e") * F.col("e")), F.var_pop("a") * F.count("a"))).alias("r2"),
        (F.avg(missed / F.greatest(F.col("a"), F.lit(1.0))) * 100).alias("mape"),
    )


def error_percentiles(scored: DataFrame, split: str = "test") -> DataFrame:
    errors = _in_seconds(scored.where(F.col("split") == split)).select("model", F.abs("e").alias("error"))
    found = grouped_quantiles(errors, {"error": [0.5, 0.9, 0.95]}, ["model"])
    return found.select("model", *[F.col("error")[i].alias(n) for i, n in enumerate(["p50_error", "p90_error", "p95_error"])])


def ensemble_weights(metrics: DataFrame, split: str = "val") -> DataFrame:
    """(model, weight): inverse validation MAE, normalised. One row per model."""
    everything = Window.partitionBy()
    inverse = F.lit(1.0) / F.col("mae")
    members = metrics.where((F.col("split") == split) & (F.col("model") != "ensemble"))
    return members.select("model", (inverse / F.sum(inverse).over(everything)).alias("weight"))


def ensemble_rows(scored: DataFrame, weights: DataFrame, key: str = "job_id") -> DataFrame:
    """The weighted mean in log space of the members' predictions, as rows of model `ensemble`."""
    return (
        scored.join(F.broadcast(weights), "model")  # one row per model
        .groupBy(key, "split")
        .agg(F.max("label").alias("label"), F.sum(F.col("prediction") * F.col("weight")).alias("prediction"))
        .withColumn("model", F.lit("ensemble"))
    )


def best_model(metrics: DataFrame, split: str = "val") -> DataFrame:
    """One row: the ensemble when it has at least two members, else the smallest MAE."""
    rows = metrics.where(F.col("split") == split)
    single = F.col("model") != "ensemble"
    ranked = F.min(F.when(single, F.struct("mae", "model")))
    has_ensemble = (F.count_if(~single) > 0) & (F.count_if(single) > 1)
    return rows.agg(
        F.when(has_ensemble, "ensemble").otherwise(ranked["model"]).alias("best_model"),
        ranked["model"].alias("best_single"),
        ranked["mae"].alias("best_single_mae"),
    )


def best_rounds(losses: DataFrame, patience: int) -> DataFrame:
    """(model, rounds, best_round, best_loss) from (model, round, loss): where boosting ends, and what it keeps.

    It ends at the first round that is `patience` rounds behind the best so far, and keeps the best (the earliest of equals);
    what comes after the end plays no part. One row per round and model.
    """
    before = Window.partitionBy("model").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("model").orderBy("round").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lowest = F.min("loss").over(before)
    better = losses.withColumn("better", lowest.isNull() | (F.col("loss") < lowest))
    last = better.withColumn("best", F.max(F.when(F.col("better"), F.col("round"))).over(so_far))
    ended = F.min(F.when(F.col("round") - F.col("best") >= patience, F.col("round"))).over(Window.partitionBy("model"))
    run = last.withColumn("ended", ended).where(F.col("ended").isNull() | (F.col("round") <= F.col("ended")))
    return run.groupBy("model").agg(
        F.max("round").alias("rounds"), F.max("best").alias("best_round"), F.min("loss").alias("best_loss")
    )
