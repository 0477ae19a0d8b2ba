"""Query registration and the shared inputs of registered queries."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from queuelens import views
from queuelens.operators.filters import clean_jobs_fixed, valid_request
from queuelens.operators.reports import failed_rows, scored_rows, union_results
from queuelens.plans import features, training
from queuelens.registry.ctes import CTES
from queuelens.session import materialize, scratch_path
from queuelens.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def with_ctes(body: str) -> str:
    """Prefixes the statement with the common table expressions it names, in order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, definition in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(definition)

    visit(body)
    if not needed:
        return body
    parts = ",\n".join(f"{name} AS (\n{CTES[name]}\n)" for name in CTES if name in needed)
    return f"WITH {parts}\n{body}"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_ctes(oracle)
        return fn

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`").cast("double"), 6) for c in columns})


def zoneless(df: DataFrame, *columns: str) -> DataFrame:
    """Times without a zone, as the SQL side returns them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def out(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Selects columns, times without zone."""
    chosen = df.select(*columns)
    return zoneless(chosen, *[f.name for f in chosen.schema.fields if f.dataType.typeName() == "timestamp"])


# --- inputs -----------------------------------------------------------------------------------


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """The job log as a stored table, derived once per session from `events`.

    Queries read it as they would read a real log: with pushed filters and pruned columns.
    """

    def store() -> DataFrame:
        source, cores = views.events(spark, sf), spark.sparkContext.defaultParallelism
        if source.rdd.getNumPartitions() < cores:
            # A file with fewer splits than there are cores would leave the others idle. The events are dealt, not the log,
            # which would be derived by the few and twice, as ranges are sampled first.
            source = source.repartitionByRange(cores, "ts")
        return materialize(views.jobs_from_events(source), "jobs")

    return _once(spark, sf, "jobs", store)


def clean(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned log, for queries that start from one."""
    return _once(spark, sf, "clean", lambda: materialize(clean_jobs_fixed(jobs(spark, sf)), "clean"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return views.requests(spark, sf)


def replayed(spark: SparkSession, sf: str, source: DataFrame, files: int) -> str:
    """A folder with the events as files in event order, for streams."""
    return _once(spark, sf, "replayed", lambda: readers.in_time_order(source, "ts", scratch_path(spark, "replayed"), files))


def service_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Scoring requests with job-log column names; a missing walltime stays missing."""
    return views.job_requests_from_jobs(jobs(spark, sf)).withColumnsRenamed(
        {"cpus_req": "processors_req", "walltime_req": "wallclock_req"}
    )


def with_sample_prediction(df: DataFrame) -> DataFrame:
    """A plain formula in place of a model, so that SQL can state the expected report."""
    share = (F.lit(3) + F.col("request_id") % 10) / F.lit(10.0)
    return df.withColumn("predicted_runtime", F.col("wallclock_req") * share)


def sample_results(spark: SparkSession, sf: str) -> DataFrame:
    """Report rows of all requests under the plain formula."""
    df = service_requests(spark, sf)
    good = scored_rows(with_sample_prediction(df.where(valid_request())))
    bad = failed_rows(
        df.where(~valid_request()), F.lit("Invalid job features provided"), ["request_id", "processors_req", "nodes_req"]
    )
    return union_results(good, bad)


def sample_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """(job_id, split, label, model, prediction) of three formula members on the split log."""
    rows = split_table(spark, sf)
    wall = F.coalesce(F.col("wallclock_req"), F.lit(14400.0))
    members = {
        "a": F.log1p(wall * 0.55),
        "b": F.log1p(wall * 0.25 + 900.0),
        "c": F.log1p(wall) * 0.6 + 2.5,
    }
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), p.alias("prediction")) for m, p in members.items()])
    label = F.log1p(F.col("run_time").cast("double")).alias("label")
    return rows.select("job_id", "split", label, F.explode(pairs).alias("p")).select("job_id", "split", "label", "p.*")


# Fitting is eager, like an estimator's. What is fitted on one table is kept for the session, so
# that twenty queries over the same table do not fit it twenty times.
_FITTED: dict[tuple, object] = {}


def _once(spark: SparkSession, sf: str, what: str, make: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf, what)
    if key not in _FITTED:
        _FITTED[key] = make()
    return _FITTED[key]


def forget_fitted() -> None:
    _FITTED.clear()


def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return _once(spark, sf, "split", lambda: training.training_table_and_funnel(jobs(spark, sf)))


def split_table(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf)[0]


def split_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """What each cleaning stage left, counted while the split table was written."""
    return _split(spark, sf)[1]


def train_rows(spark: SparkSession, sf: str) -> DataFrame:
    return split_table(spark, sf).where(F.col("split") == "train")


def state(spark: SparkSession, sf: str) -> features.FeatureState:
    return _once(spark, sf, "state", lambda: features.fit(train_rows(spark, sf)))


def trained(spark: SparkSession, sf: str) -> training.TrainedEnsemble:
    return _once(spark, sf, "trained", lambda: training.train_all(split_table(spark, sf), state=state(spark, sf)))
