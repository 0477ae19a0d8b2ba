"""From scoring requests to predictions, in batch and on streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from queuelens.functions import reports as R
from queuelens.operators.filters import serving_defaults, skip_invalid, valid_request
from queuelens.operators.joins import score_distinct
from queuelens.operators.reports import failed_rows, scored_rows, union_results
from queuelens.plans import features
from queuelens.plans.training import TARGET, TrainedEnsemble, assemble, ensemble_predict, importance_map, with_targets
from queuelens.schema import REQUEST_KEY

OUTPUTS = [
    "predicted_runtime", "confidence_lower", "confidence_upper", "model_version", "features_used", "runtime_category",
    "prediction_confidence", "prediction_timestamp", "feature_importance",
]
#: The service's fixed confidence of an answered request.
CONFIDENCE = 0.8


def predict(df: DataFrame, trained: TrainedEnsemble, as_of: Column | None = None) -> DataFrame:
    """Adds a prediction to every (valid) request row: one map-only plan plus state lookups."""
    keep = list(df.columns)
    state = trained.state
    rows = with_targets(features.transform(serving_defaults(df, as_of), state), trained.targets)
    # The recipe fills a missing walltime; a request keeps what it was sent with.
    scored = ensemble_predict(assemble(rows, state.features, keep=[*keep, TARGET]), trained.models, trained.weights)
    runtime = R.inverse_log(F.col("prediction"))
    lower, upper = R.band_20pct(F.col("predicted_runtime"))
    return scored.select(*keep, runtime.alias("predicted_runtime")).withColumns(
        {
            "confidence_lower": lower,
            "confidence_upper": upper,
            "model_version": F.lit(trained.info.get("version", "1.0")),
            "features_used": F.lit(len(state.features)),
            "runtime_category": R.runtime_category(F.col("predicted_runtime")),
            "prediction_confidence": F.lit(CONFIDENCE),
            "prediction_timestamp": F.unix_seconds(F.current_timestamp()),
            "feature_importance": F.create_map(*[F.lit(x) for pair in importance_map(trained).items() for x in pair]),
        }
    )


def score_batch(df: DataFrame, trained: TrainedEnsemble, as_of: Column | None = None) -> DataFrame:
    """Predictions for the valid rows of a batch or stream; bad rows are left out."""
    return predict(skip_invalid(df), trained, as_of)


def score_batch_distinct(df: DataFrame, trained: TrainedEnsemble, as_of: Column | None = None) -> DataFrame:
    """As the service with its cache: equal six-field requests share one prediction."""
    valid = skip_invalid(df)
    return score_distinct(valid, lambda once: predict(once, trained, as_of), OUTPUTS, REQUEST_KEY)


def walltime_report(df: DataFrame, trained: TrainedEnsemble, keep: list[str], as_of: Column | None = None) -> DataFrame:
    """The result table of an uploaded file: scored rows, and failed rows with their error."""
    done = scored_rows(score_batch(df, trained, as_of))
    bad = df.where(~valid_request())
    return union_results(done, failed_rows(bad, F.lit("Invalid job features provided"), keep))
