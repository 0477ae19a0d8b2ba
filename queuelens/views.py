"""Job-log and request-log views over the supplied `events` table (rules in FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed values of the derived job log.
NAME_STEMS = [
    "wind_map", "tide_model", "net_fit", "log_sift", "grid_tune", "ray_walk", "heat_flow", "fold_scan",
]
PARTITION_OF = {
    "view": "compute", "click": "standard", "purchase": "gpu", "signup": "debug", "error": "bigmem",
}
WALLTIME_STEPS = [3600, 7200, 14400, 28800, 43200, 86400]
WALLTIME_MAX = 172800


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def jobs_from_events(ev: DataFrame) -> DataFrame:
    """The job log: a narrow projection of `events`, batch or streaming."""
    k = "cast(get_json_object(props, '$.k') as int)"
    stems = " ".join(f"when {i} then '{s}'" for i, s in enumerate(NAME_STEMS))
    partitions = " ".join(f"when '{e}' then '{p}'" for e, p in PARTITION_OF.items())
    steps = " ".join(f"when est <= {s} then {s}e0" for s in WALLTIME_STEPS)
    base = ev.select(
        "event_id", "user_id", "event_type", "value",
        F.col("ts").cast("timestamp").alias("ts"),
        F.expr(k).alias("k"),
        F.expr(f"value * (150 + 100 * ({k} % 6))").alias("est"),
        F.expr("cast(floor(value * 200) as bigint) - 5").alias("run_time"),
        F.expr("cast(pow(2, event_id % 6) as int)").alias("small_nodes"),
        F.expr("timestampadd(SECOND, cast((event_id * 7919) % 3600 - 60 as int), ts)").cast("timestamp").alias("start_time"),
    ).withColumn("nodes_req", F.expr("case when event_id % 250 = 7 then 128 else small_nodes end"))
    return base.selectExpr(
        "event_id as job_id",
        "concat('user_', lpad(cast(user_id as string), 3, '0')) as `user`",
        "concat('proj_', lpad(cast(user_id % 20 as string), 2, '0')) as account",
        f"""case when event_id % 23 = 0 then null else concat(
              case event_id % 8 {stems} end,
              case k % 10 when 0 then '_MPI' when 1 then '_cuda' when 2 then concat('[0-', cast(k as string), ']')
                when 3 then '_debug' when 4 then '_prod' when 5 then '_3of8' when 6 then '[7]' else '' end) end as name""",
        "case when event_id % 20 < 17 then 'COMPLETED' when event_id % 20 < 19 then 'FAILED' else 'TIMEOUT' end as state",
        f"case event_type {partitions} end as `partition`",
        """case when event_id % 211 = 0 then '' when k % 20 < 12 then 'normal' when k % 20 < 16 then 'high'
             when k % 20 < 19 then 'low' else 'debug' end as qos""",
        "ts as submit_time",
        "start_time",
        "timestampadd(SECOND, cast(run_time as int), start_time) as end_time",
        "run_time",
        f"""case when k % 29 = 0 then null
              when user_id % 10 = 0 then cast(floor(value * 120) as double) + 1
              when user_id % 10 = 1 then cast(floor(value * 240) as double) + 1
              {steps} else {WALLTIME_MAX}e0 end as wallclock_req""",
        "nodes_req",
        """case when event_id % 97 = 0 then 0 else nodes_req *
             case k % 4 when 0 then 16 when 1 then 24 when 2 then 32 else 48 end end as processors_req""",
        """case when event_id % 101 = 0 then -1e0 else cast(nodes_req *
             case k % 3 when 0 then 32000 when 1 then 64000 else 128000 end as double) end as mem_req""",
        """case when event_type <> 'purchase' then 0 else
             case event_id % 4 when 0 then 1 when 1 then 2 when 2 then 4 else 8 end end as gpus_req""",
        """case when event_id % 20 < 17 then 0 else
             case event_id % 3 when 0 then 1 when 1 then 2 else 127 end end as exit_code""",
    ).withColumn("derived_exit_code", F.col("exit_code"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs_from_events(events(spark, sf_dir))


def job_requests_from_jobs(job_log: DataFrame) -> DataFrame:
    """Scoring requests: one per job, grouped in batches of 100."""
    return job_log.selectExpr(
        "job_id as request_id",
        "job_id div 100 as batch_id",
        "cast(job_id % 100 as int) as idx",
        "processors_req as cpus_req",
        "nodes_req",
        "mem_req",
        "wallclock_req as walltime_req",
        "`partition`",
        "qos",
        "submit_time",
        "`user`",
    )


def job_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_requests_from_jobs(jobs(spark, sf_dir))


def requests_from_events(ev: DataFrame) -> DataFrame:
    """The request log that monitoring reads, batch or streaming."""
    k = "cast(get_json_object(props, '$.k') as int)"
    return ev.selectExpr(
        "event_id as request_seq",
        "cast(ts as timestamp) as ts",
        "case event_id % 3 when 0 then 'Predict' when 1 then 'PredictBatch' else 'PredictStream' end as method",
        "case event_type when 'error' then 'error' when 'signup' then 'invalid' else 'success' end as status",
        "value / 200 as latency_s",
        "value / 2000 as inference_s",
        "case event_type when 'view' then true when 'click' then false end as cache_hit",
        f"greatest({k} % 4 - 1, 0) as retries",
        f"case when event_id % 3 = 1 then {k} + 1 end as batch_size",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_from_events(events(spark, sf_dir))
