import pytest
from pyspark.sql import functions as F

from queuelens.operators import filters, reports


def _ids(df, key="job_id"):
    return {r[key] for r in df.collect()}


def test_runtime_bounds_are_inclusive(job_rows):
    df = job_rows(*[{"run_time": t} for t in (0, 9, 10, 604_800, 604_801, None)])
    assert _ids(filters.runtime_bounds(df)) == {2, 3}
    assert _ids(filters.positive_runtime(df)) == {1, 2, 3, 4}


def test_resource_bounds_drop_missing(job_rows):
    df = job_rows({"mem_req": 0.0}, {"mem_req": -1.0}, {"mem_req": None}, {"processors_req": 0}, {"nodes_req": 0})
    assert _ids(filters.resource_bounds(df)) == {0}


def test_trim_takes_both_cuts_first(job_rows):
    df = job_rows(*[{"processors_req": i, "mem_req": float(1000 - i)} for i in range(1, 101)])
    kept = filters.trim_percentile(df, 0.9, 0.9)
    cut = filters.trim_thresholds(df, 0.9, 0.9).first()
    assert (cut["max_processors"], cut["max_mem"]) == (pytest.approx(90.1), pytest.approx(989.1))
    assert kept.count() == 80


def test_clean_variants_agree_and_funnel_shrinks(spark, sf):
    from queuelens import views

    df = views.jobs(spark, sf)
    assert _ids(filters.clean_jobs(df)) == _ids(filters.clean_jobs_fixed(df))
    left = [r["rows_kept"] for r in filters.clean_funnel(df).orderBy("position").collect()]
    assert left == sorted(left, reverse=True) and left[-1] == filters.clean_jobs(df).count()


def test_thresholds_are_a_subquery_not_a_join(spark, sf):
    from queuelens.session import materialize
    from queuelens import views

    plan = filters.clean_jobs(materialize(views.jobs(spark, sf), "t"))._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "NestedLoop" not in plan and "Join" not in main
    assert "PushedFilters: [IsNotNull(" in plan and "PushedFilters: []" not in plan


def test_missing_columns_named_in_one_error(spark):
    df = spark.range(1).select(F.lit(1).alias("cpus_req"))
    with pytest.raises(ValueError, match="mem_req, nodes_req, partition, qos, walltime_req"):
        filters.require_columns(df, list(filters.REQUEST_COLUMNS))


def test_coercion_and_report(spark):
    df = spark.createDataFrame(
        [("4", "1", "16.5", "3600", "gpu", "high"), ("x", "2.9", "", "-1", "  ", None)],
        "cpus_req string, nodes_req string, mem_req string, walltime_req string, partition string, qos string",
    )
    rows = filters.coerce_numeric(df, ["cpus_req", "nodes_req"], ["mem_req", "walltime_req"]).collect()
    assert [tuple(r)[:4] for r in rows] == [(4, 1, 16.5, 3600.0), (0, 2, 0.0, -1.0)]
    report = {r["column"]: (r["bad"], r["passes"]) for r in filters.csv_check_report(df).collect()}
    assert report == {
        "cpus_req": (1, False), "nodes_req": (0, True), "mem_req": (1, False),
        "walltime_req": (1, False), "partition": (1, False), "qos": (0, True),
    }


@pytest.mark.parametrize(
    "change, ok",
    [
        ({}, True), ({"mem_req": 0.0}, True), ({"mem_req": -1.0}, False), ({"wallclock_req": 0.0}, False),
        ({"wallclock_req": None}, False), ({"qos": ""}, False), ({"partition": None}, False), ({"processors_req": 0}, False),
    ],
)
def test_valid_request(job_rows, change, ok):
    assert job_rows(change).select(filters.valid_request().alias("v")).first()["v"] is ok


def test_batches_report_the_lowest_bad_index(job_rows):
    df = job_rows({}, {"qos": ""}, {"nodes_req": 0}, {}, {}).selectExpr("*", "job_id div 3 as batch_id", "cast(job_id % 3 as int) as idx")
    verdict = {r["batch_id"]: (r["batch_size"], r["first_bad_index"], r["accepted"]) for r in filters.batch_verdicts(df).collect()}
    assert verdict == {0: (3, 1, False), 1: (2, None, True)}
    assert _ids(filters.reject_batches(df)) == {3, 4}


def test_errors_are_whole_and_in_order_for_a_huge_batch(spark):
    n = 25_000
    df = spark.range(n).selectExpr(
        "cast(1 as bigint) as batch_id", "cast(id as int) as idx", "cast(0 as int) as processors_req", "1 as nodes_req",
        "1e0 as mem_req", "1e0 as wallclock_req", "'a' as partition", "'b' as qos",
    )
    totals = [(r["total_predictions"], r["failed_predictions"]) for r in reports.collect_errors(df).collect()]
    assert totals == [(n, n)]
    texts = reports.error_texts(df, F.lit("bad")).orderBy("idx").collect()
    assert [r["error"] for r in texts] == [f"Job {i}: bad" for i in range(n)]


def test_profile_narrow_types(job_rows):
    df = job_rows(*[{"run_time": t, "user": f"u{i}"} for i, t in enumerate((0, 254, 12, 3))]).withColumn("neg", F.col("run_time") - 200)
    found = {r["column"]: r["suggested"] for r in filters.profile_schema(df).collect()}
    assert found["run_time"] == "uint8" and found["neg"] == "int16" and found["mem_req"] == "float32"
    assert found["user"] == "string" and found["qos"] == "category"
