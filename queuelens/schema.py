"""Schemas and fixed column lists shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

JOB_SCHEMA = T.StructType(
    [
        T.StructField("job_id", T.LongType()),
        T.StructField("user", T.StringType()),
        T.StructField("account", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("partition", T.StringType()),
        T.StructField("qos", T.StringType()),
        T.StructField("submit_time", T.TimestampType()),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("end_time", T.TimestampType()),
        T.StructField("run_time", T.LongType()),
        T.StructField("wallclock_req", T.DoubleType()),
        T.StructField("nodes_req", T.IntegerType()),
        T.StructField("processors_req", T.IntegerType()),
        T.StructField("mem_req", T.DoubleType()),
        T.StructField("gpus_req", T.IntegerType()),
        T.StructField("exit_code", T.IntegerType()),
        T.StructField("derived_exit_code", T.IntegerType()),
    ]
)

# A scoring request as users upload it.
REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("cpus_req", T.IntegerType()),
        T.StructField("nodes_req", T.IntegerType()),
        T.StructField("mem_req", T.DoubleType()),
        T.StructField("walltime_req", T.DoubleType()),
        T.StructField("partition", T.StringType()),
        T.StructField("qos", T.StringType()),
    ]
)

# A scoring request as the service receives it: nested features plus metadata.
REQUEST_MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField(
            "features",
            T.StructType(
                [
                    T.StructField("processors_req", T.IntegerType()),
                    T.StructField("nodes_req", T.IntegerType()),
                    T.StructField("mem_req", T.DoubleType()),
                    T.StructField("wallclock_req", T.DoubleType()),
                    T.StructField("partition", T.StringType()),
                    T.StructField("qos", T.StringType()),
                    T.StructField("submit_time", T.LongType()),
                ]
            ),
        ),
        T.StructField("request_id", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

# The six fields that identify a request for reuse of an earlier answer.
REQUEST_KEY = ["processors_req", "nodes_req", "mem_req", "wallclock_req", "partition", "qos"]

# Raw columns that get a robust-scaled counterpart, in model order.
SCALED_COLUMNS = [
    "processors_req",
    "nodes_req",
    "mem_req",
    "wallclock_req",
    "cpu_memory_ratio",
    "resource_intensity",
    "memory_per_node",
    "total_compute_units",
    "walltime_resource_ratio",
    "memory_per_cpu",
    "resource_balance",
    "user_mean_runtime",
    "user_job_count",
    "user_accuracy_score",
    "queue_load",
    "name_length",
    "array_job_size",
    "cpu_efficiency_score",
    "job_complexity_score",
    "queue_wait_time",
]

# The model features, in the order the feature vector is assembled.
BASE_FEATURES = [
    "processors_req_scaled",
    "nodes_req_scaled",
    "mem_req_scaled",
    "wallclock_req_scaled",
    "cpu_memory_ratio_scaled",
    "resource_intensity_scaled",
    "memory_per_node_scaled",
    "total_compute_units_scaled",
    "walltime_resource_ratio_scaled",
    "hour_of_day",
    "day_of_week",
    "is_weekend",
    "month",
    "quarter",
    "partition_encoded",
    "qos_encoded",
]
ADVANCED_FEATURES = [
    "is_night",
    "is_business_hours",
    "day_of_month",
    "week_of_year",
    "memory_per_cpu_scaled",
    "is_high_memory_job",
    "is_large_job",
    "resource_balance_scaled",
    "cpu_efficiency_score_scaled",
    "job_complexity_score_scaled",
    "peak_hour_large_job",
    "user_mean_runtime_scaled",
    "user_job_count_scaled",
    "user_accuracy_score_scaled",
    "user_overestimate_tendency",
    "user_underestimate_tendency",
    "user_is_frequent",
    "user_frequency",
    "queue_load_scaled",
    "name_length_scaled",
    "name_has_numbers",
    "is_mpi_job",
    "is_gpu_job",
    "is_array_job",
    "is_test_job",
    "is_prod_job",
    "array_job_size_scaled",
    "queue_wait_time_scaled",
]
MODEL_FEATURES = BASE_FEATURES + ADVANCED_FEATURES

# Upper bounds (seconds) of the request and inference latency histograms.
LATENCY_BOUNDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5]
INFERENCE_BOUNDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25]


def feature_columns(available: list[str] | None = None, advanced: bool = True) -> list[str]:
    """The ordered model features, limited to the available ones when a list is given."""
    wanted = MODEL_FEATURES if advanced else BASE_FEATURES
    return [c for c in wanted if available is None or c in available]
