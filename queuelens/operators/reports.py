"""Scored-result tables: success and failure rows, texts, error lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from queuelens.functions import reports as R
from queuelens.operators.filters import valid_request

def scored_rows(df: DataFrame) -> DataFrame:
    """What the report shows for rows that carry a `predicted_runtime`."""
    predicted, requested = F.col("predicted_runtime"), F.col("wallclock_req")
    lower, upper = R.band_20pct(predicted)
    return df.withColumns(
        {
            "confidence_lower": lower,
            "confidence_upper": upper,
            "runtime_formatted": R.format_runtime(predicted),
            "walltime_formatted": R.format_runtime(requested),
            "efficiency": R.efficiency(predicted, requested),
            "runtime_category": R.runtime_category(predicted),
            "prediction_status": F.lit("success"),
        }
    )


def failed_rows(df: DataFrame, message: Column, keep: list[str]) -> DataFrame:
    """Failed rows keep only what identifies them, a zero prediction and the error."""
    return df.select(
        *keep,
        F.lit(0.0).alias("predicted_runtime"),
        F.lit("failed").alias("prediction_status"),
        message.alias("error"),
    )


def union_results(succeeded: DataFrame, failed: DataFrame) -> DataFrame:
    return succeeded.unionByName(failed, allowMissingColumns=True)


def service_rows(df: DataFrame) -> DataFrame:
    """The service's answer per job: failed jobs get zeros and the marker `error`."""
    ok = F.col("prediction_status") == "success"
    return df.select(
        "*",
        F.when(ok, F.lit("2.0")).otherwise("error").alias("model_version"),
        F.when(ok, F.lit(0.8)).otherwise(0.0).alias("confidence_score"),
    )


def collect_errors(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Per batch, in one row: its jobs and how many of them failed."""
    return df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total_predictions"), F.count_if(~valid_request()).alias("failed_predictions")
    )


def error_texts(df: DataFrame, message: Column, batch: str = "batch_id", index: str = "idx") -> DataFrame:
    """A row for each failed job: (batch, idx, `Job i: message`), so that no batch makes a list."""
    text = F.format_string("Job %d: %s", F.col(index), message)
    return df.where(~valid_request()).select(batch, index, text.alias("error"))


def summary_text(summary: DataFrame, file_name: str = "jobs.csv") -> DataFrame:
    """The plain-text report of a `batch_summary` row."""
    avg, total = R.format_runtime(F.col("avg_predicted_runtime")), R.format_runtime(F.col("total_predicted_runtime"))
    lines = [
        F.lit("Runtime Prediction Summary Report"),
        F.concat(F.lit("File: "), F.lit(file_name)),
        F.format_string("Total Jobs: %d", "total_jobs"),
        F.format_string("Successful Predictions: %d", "successful"),
        F.format_string("Failed Predictions: %d", "failed"),
        F.concat(F.lit("Average Predicted Runtime: "), F.coalesce(avg, F.lit("N/A"))),
        F.concat(F.lit("Total Predicted Runtime: "), F.coalesce(total, F.lit("N/A"))),
        # Absent, not N/A, when nothing was scored: concat_ws leaves NULL lines out.
        F.when(F.col("avg_efficiency").isNotNull(), F.format_string("Average Efficiency: %.1f%%", "avg_efficiency")),
    ]
    return summary.select(F.concat_ws("\n", *lines).alias("report"))
