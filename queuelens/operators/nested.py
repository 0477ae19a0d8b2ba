"""Nested records: metric and importance JSON, weight maps, request messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from queuelens.schema import REQUEST_KEY

METRICS_TYPE = "map<string,map<string,double>>"
IMPORTANCE_TYPE = "map<string,array<struct<feature:string,importance:double>>>"


def metrics_json(metrics: DataFrame, names: list[str]) -> DataFrame:
    """A (model, metric columns...) table as one JSON object {model: {metric: value}}.

    One entry per trained model, so the object is small.
    """
    entry = F.struct(
        F.col("model").alias("key"),
        F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(n).cast("double") for n in names])).alias("value"),
    )
    return metrics.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("json"))


def metrics_long(document: DataFrame, column: str = "json") -> DataFrame:
    """{model: {metric: value}} to (model, metric, value)."""
    outer = document.select(F.explode(F.from_json(F.col(column), METRICS_TYPE)).alias("model", "metrics"))
    return outer.select("model", F.explode("metrics").alias("metric", "value"))


def importance_json(importance: DataFrame) -> DataFrame:
    """(model, feature, importance) as one JSON object {model: [{feature, importance}]}."""
    per_model = importance.groupBy("model").agg(
        F.sort_array(F.collect_list(F.struct("importance", "feature")), asc=False).alias("ranked")
    )
    entry = F.struct(
        F.col("model").alias("key"),
        F.transform("ranked", lambda r: F.struct(r["feature"].alias("feature"), r["importance"].alias("importance"))).alias("value"),
    )
    return per_model.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("json"))


def importance_long(document: DataFrame, column: str = "json") -> DataFrame:
    """{model: [{feature, importance}]} to (model, rank, feature, importance)."""
    outer = document.select(F.explode(F.from_json(F.col(column), IMPORTANCE_TYPE)).alias("model", "items"))
    ranked = outer.select("model", F.posexplode("items").alias("rank", "item"))
    return ranked.select("model", "rank", "item.feature", "item.importance")


def weights_map(weights: DataFrame) -> DataFrame:
    """(model, weight) rows as a single map, one entry per model."""
    entries = F.sort_array(F.collect_list(F.struct("model", "weight")))
    return weights.agg(F.map_from_entries(entries).alias("ensemble_weights"))


def nest_request(df: DataFrame, metadata: dict[str, str] | None = None) -> DataFrame:
    """Flat request columns to a (features, request_id, metadata) message."""
    fields = [F.col(c) for c in REQUEST_KEY] + [F.unix_timestamp("submit_time").alias("submit_time")]
    fixed = [F.lit(x) for pair in (metadata or {"source": "batch"}).items() for x in pair]
    return df.select(
        F.struct(*fields).alias("features"),
        F.col("request_id").cast("string").alias("request_id"),
        F.create_map(*fixed, F.lit("user"), F.col("user")).alias("metadata"),
    )


def flatten_request(messages: DataFrame) -> DataFrame:
    """A request message to flat columns; the user comes from the metadata."""
    return messages.select(
        "request_id",
        *[F.col(f"features.{c}").alias(c) for c in REQUEST_KEY],
        F.timestamp_seconds("features.submit_time").alias("submit_time"),
        F.col("metadata")["user"].alias("user"),
        F.col("metadata")["source"].alias("source"),
    )
