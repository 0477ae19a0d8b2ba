import pytest
from pyspark.sql import functions as F

from queuelens.session import materialize, shared_folder
from queuelens.sources import readers, writers


def test_missing_path_is_an_error(spark, tmp_path):
    for read in (readers.scan_jobs, readers.scan_csv, readers.scan_json, readers.scan_request_csv):
        with pytest.raises(FileNotFoundError):
            read(spark, str(tmp_path / "nothing"))


def test_source_preference(spark, job_rows, tmp_path):
    df, root = job_rows({}, {}), str(tmp_path)
    with pytest.raises(FileNotFoundError):
        readers.pick_source(spark, root)
    writers.sink_csv(df, f"{root}/sample/a.csv")
    assert readers.pick_source(spark, root)[0] == "sample"
    writers.sink_csv(df, f"{root}/full/a.csv.bz2", compression="bzip2")
    assert readers.pick_source(spark, root)[0] == "full-csv"
    writers.sink_parquet(df, f"{root}/full/a.parquet")
    kind, found = readers.pick_source(spark, root)
    assert kind == "full" and found.count() == 2


def test_epoch_seconds_become_timestamps(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(1).select(F.lit(1).cast("bigint").alias("job_id"), F.lit(1704067200).cast("bigint").alias("submit_time")).write.parquet(path)
    row = readers.scan_jobs(spark, path).first()
    assert str(row["submit_time"]) == "2024-01-01 00:00:00"


def test_unreadable_request_rows_are_kept_apart(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("cpus_req,nodes_req,mem_req,walltime_req,partition,qos\n4,1,16.0,3600,standard,normal\nx,1,16.0,3600,gpu,high\n")
    rows = readers.scan_request_csv(spark, str(path)).cache().collect()
    assert [r["_corrupt"] is None for r in rows] == [True, False]


def test_month_folders_prune(spark, job_rows, tmp_path):
    path = writers.sink_parquet(job_rows({}), str(tmp_path / "log"), by_month=True)
    plan = spark.read.parquet(path).where("submit_month = '2024-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(submit_month" in plan


def test_materialized_tables_lie_in_the_shared_folder(spark):
    df = materialize(spark.range(3), "t")
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert all(shared_folder(spark) in f for f in df.inputFiles()) and df.count() == 3


def test_job_log_is_derived_by_as_many_tasks_as_cores(spark, sf, tmp_path, monkeypatch):
    from queuelens import views
    from queuelens.registry import catalog

    derive, seen = views.jobs_from_events, []

    def watched(events):
        seen.append(events.rdd.getNumPartitions())
        return derive(events)

    monkeypatch.setattr(views, "jobs_from_events", watched)
    views.events(spark, sf).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    rows = catalog.jobs(spark, str(tmp_path))
    assert seen == [spark.sparkContext.defaultParallelism]
    assert rows.exceptAll(derive(views.events(spark, sf))).isEmpty() and rows.count() == views.events(spark, sf).count()
