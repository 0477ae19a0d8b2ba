"""The feature recipe: fit statistics once on training rows, then transform any rows with them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from queuelens.functions import calendar as cal, names, resources as res
from queuelens.operators import aggregates
from queuelens.operators.joins import join_dictionary, join_queue_load, join_user_stats
from queuelens.operators.quantiles import exact_quantiles
from queuelens.operators.scaling import apply_robust_scaler, fit_scaler_params
from queuelens.schema import BASE_FEATURES, MODEL_FEATURES, SCALED_COLUMNS
from queuelens.session import materialize, side_by_side

STATE_VERSION = "2.0"
ENCODED = ("partition", "qos")


@dataclass(frozen=True)
class FeatureState:
    """What fitting learnt: a few numbers, and tables that grow with users and queues."""

    thresholds: dict[str, float]
    scaler: dict[str, tuple[float, float]]
    users: DataFrame | None
    queues: DataFrame | None
    codes: DataFrame
    advanced: bool = True
    version: str = STATE_VERSION
    stats: DataFrame | None = field(default=None, compare=False)

    @property
    def features(self) -> list[str]:
        return MODEL_FEATURES if self.advanced else BASE_FEATURES


def _row_features(df: DataFrame, advanced: bool) -> dict[str, Column]:
    """Features that need only the row itself (walltime already filled)."""
    procs, nodes = F.col("processors_req"), F.col("nodes_req")
    mem, wall = F.col("mem_req"), F.col("wallclock_req")
    found: dict[str, Column] = {}
    if "submit_time" in df.columns:
        found |= cal.calendar_features(F.col("submit_time"), advanced)
    found |= {
        "cpu_memory_ratio": res.cpu_memory_ratio(procs, mem),
        "resource_intensity": res.resource_intensity(procs, nodes),
        "memory_per_node": res.memory_per_node(mem, nodes),
        "total_compute_units": res.total_compute_units(procs, nodes),
        "walltime_resource_ratio": res.walltime_resource_ratio(wall, procs, nodes),
    }
    if not advanced:
        return found
    found |= {
        "memory_per_cpu": res.memory_per_cpu(mem, procs),
        "cpu_efficiency_score": res.cpu_efficiency_score(procs, nodes),
        "job_complexity_score": res.job_complexity_score(procs, nodes, wall),
    }
    if "name" in df.columns:
        found |= names.name_features(F.col("name"))
    if "submit_time" in df.columns:
        found["submit_date"] = F.to_date("submit_time")
        if "start_time" in df.columns:
            found["queue_wait_time"] = cal.queue_wait_time(F.col("start_time"), F.col("submit_time"))
    if "user" in df.columns and "partition" in df.columns:
        found["user_partition_pair"] = res.user_partition_pair(F.col("user"), F.col("partition"))
    return found


def _with_rows(df: DataFrame, thresholds: dict[str, float], advanced: bool) -> DataFrame:
    filled = df.withColumn("wallclock_req", F.coalesce(F.col("wallclock_req"), F.lit(thresholds["wallclock_median"])))
    rows = filled.withColumns(_row_features(filled, advanced))
    if not advanced:
        return rows
    large = res.above(F.col("total_compute_units"), F.lit(thresholds["total_compute_q90"]))
    flags = {
        "is_high_memory_job": res.above(F.col("memory_per_cpu"), F.lit(thresholds["mem_per_cpu_q75"])),
        "is_large_job": large,
        "resource_balance": F.abs(F.col("cpu_memory_ratio") - F.lit(thresholds["cpu_mem_median"])),
    }
    if "is_business_hours" in rows.columns:
        flags["peak_hour_large_job"] = F.col("is_business_hours") * large
    return rows.withColumns(flags)


def _with_history(df: DataFrame, state: FeatureState) -> DataFrame:
    """Looks up what is known about the row's user and queue."""
    t = state.thresholds
    if state.users is not None and "user" in df.columns:
        df = join_user_stats(df, state.users, t["train_mean_runtime"]).withColumns(
            {
                "user_overestimate_tendency": res.above(F.col("user_accuracy_score"), F.lit(1.5)),
                "user_underestimate_tendency": res.below(F.col("user_accuracy_score"), F.lit(0.8)),
                "user_is_frequent": res.above(F.col("user_job_count"), F.lit(t["user_count_q75"])),
            }
        )
    if state.queues is not None and "submit_time" in df.columns and "partition" in df.columns:
        df = join_queue_load(df, state.queues)
    return df


def _unscaled(df: DataFrame, state: FeatureState) -> DataFrame:
    rows = _with_rows(df, state.thresholds, state.advanced)
    return _with_history(rows, state) if state.advanced else rows


def fit_thresholds(df: DataFrame, weight: str | None = None) -> DataFrame:
    """The fitted cuts of a training frame as one lazy row; with `weight` a row stands for that many."""
    procs, nodes, mem = F.col("processors_req"), F.col("nodes_req"), F.col("mem_req")
    sized = df.select(
        "wallclock_req",
        res.memory_per_cpu(mem, procs).alias("memory_per_cpu"),
        res.total_compute_units(procs, nodes).alias("total_compute_units"),
        res.cpu_memory_ratio(procs, mem).alias("cpu_memory_ratio"),
        *([weight] if weight else []),
    )
    wanted = {"wallclock_req": [0.5], "memory_per_cpu": [0.75], "total_compute_units": [0.9], "cpu_memory_ratio": [0.5]}
    found = exact_quantiles(sized, wanted, weight=weight)
    return found.select(
        F.col("wallclock_req")[0].alias("wallclock_median"),
        F.col("memory_per_cpu")[0].alias("mem_per_cpu_q75"),
        F.col("total_compute_units")[0].alias("total_compute_q90"),
        F.col("cpu_memory_ratio")[0].alias("cpu_mem_median"),
    )


def user_count_quantile(jobs_per_user: DataFrame, probability: float = 0.75) -> DataFrame:
    """Quantile of a user's job count over jobs (a user weighs as many rows as jobs).

    Needs (user, job_count, rows) only, so the rows themselves are not read again.
    """
    value = F.when(F.col("user").isNull(), F.lit(1)).otherwise(F.col("job_count"))
    weighed = jobs_per_user.select(value.alias("user_count_q75"), F.col("rows").alias("weight"))
    found = exact_quantiles(weighed, {"user_count_q75": [probability]}, weight="weight")
    return found.select(F.col("user_count_q75")[0].alias("user_count_q75"))


def fit(df: DataFrame, advanced: bool = True, with_stats: bool = False) -> FeatureState:
    """Learns the state from training rows.

    `df` is read several times, so it should be a stored table (see `training.training_table`). What users, queues and
    dictionaries teach is independent of each other and learnt side by side.
    Only thresholds and scaler parameters reach the driver; user and queue tables are written to
    the shared folder as soon as they are computed.
    """

    def known_users() -> tuple[dict[str, float], DataFrame | None, int | None]:
        thresholds = fit_thresholds(df).first().asDict()
        if not advanced or "user" not in df.columns:
            return thresholds, None, None
        asked = F.coalesce(F.col("wallclock_req"), F.lit(thresholds["wallclock_median"]))
        ratio = asked / res.at_least_one(F.col("run_time"))
        per_user = df.groupBy("user").agg(
            F.avg("run_time").alias("runtime_mean"),
            F.count("run_time").alias("job_count"),
            F.coalesce(F.avg(ratio), F.lit(0.0)).alias("accuracy"),
            F.sum("run_time").alias("runtime_sum"),
            F.count(F.lit(1)).alias("rows"),
        )
        stored = materialize(per_user, "users")
        totals = stored.agg(F.try_divide(F.sum("runtime_sum"), F.sum("job_count")).alias("m"), F.sum("rows").alias("n")).first()
        thresholds["train_mean_runtime"] = totals["m"]
        thresholds |= user_count_quantile(stored).first().asDict()
        users = stored.where(F.col("user").isNotNull()).select("user", "runtime_mean", "job_count", "accuracy", "rows")
        return thresholds, users, totals["n"]

    def known_queues() -> DataFrame | None:
        if not advanced or "partition" not in df.columns or "submit_time" not in df.columns:
            return None
        known = df.where(F.col("partition").isNotNull())
        per_hour = known.groupBy("partition", F.hour("submit_time").alias("submit_hour")).agg(F.count("job_id").alias("job_count"))
        return materialize(per_hour, "queues")

    def known_codes() -> DataFrame:
        return materialize(aggregates.label_encode(df, [c for c in ENCODED if c in df.columns]), "codes")

    (thresholds, users, rows), queues, codes = side_by_side(df.sparkSession, known_users, known_queues, known_codes)
    state = FeatureState(thresholds, {}, users, queues, codes, advanced)
    raw = _unscaled(df, state)
    state = replace(state, scaler=fit_scaler_params(raw, [c for c in SCALED_COLUMNS if c in raw.columns], rows))
    if with_stats:
        done = transform(df, state)
        numeric = [c for c in state.features if c in done.columns]
        state = replace(state, stats=materialize(aggregates.feature_stats(done, numeric), "feature-stats"))
    return state


def transform(df: DataFrame, state: FeatureState | None) -> DataFrame:
    """Adds every feature; each output row depends on its own input row and the state only."""
    if state is None or not state.scaler:
        raise ValueError("the feature recipe must be fitted before rows are transformed")
    rows = _unscaled(df, state)
    for column in ENCODED:
        if column in rows.columns:
            rows = join_dictionary(rows, state.codes, column, f"{column}_encoded")
    return apply_robust_scaler(rows, state.scaler)


def fit_transform(df: DataFrame, advanced: bool = True) -> tuple[DataFrame, FeatureState]:
    state = fit(df, advanced)
    return transform(df, state), state
