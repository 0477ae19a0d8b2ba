from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from queuelens.functions import calendar as cal, names, reports as R, resources as res


def _one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("hour, night, business", [(5, 1, 0), (6, 0, 0), (8, 0, 0), (9, 0, 1), (16, 0, 1), (17, 0, 0), (19, 0, 0), (20, 1, 0)])
def test_hours(spark, hour, night, business):
    t = F.lit(datetime(2024, 1, 3, hour, 59, tzinfo=timezone.utc))
    assert _one(spark, cal.is_night(t)) == night
    assert _one(spark, cal.is_business_hours(t)) == business


@pytest.mark.parametrize("day, dow, weekend", [(5, 4, 0), (6, 5, 1), (7, 6, 1), (8, 0, 0)])
def test_weekend(spark, day, dow, weekend):
    t = F.lit(datetime(2024, 1, day, 12, tzinfo=timezone.utc))
    assert (_one(spark, cal.day_of_week(t)), _one(spark, cal.is_weekend(t))) == (dow, weekend)
    assert _one(spark, cal.is_business_hours(t)) == 1 - weekend


def test_iso_week_at_the_turn_of_the_year(spark):
    week = cal.calendar_features(F.col("t"))["week_of_year"]
    assert _one(spark, week, t=datetime(2021, 1, 3, tzinfo=timezone.utc)) == 53
    assert _one(spark, week, t=datetime(2024, 12, 30, tzinfo=timezone.utc)) == 1


@pytest.mark.parametrize(
    "name, size, array",
    [(None, 0, 0), ("", 0, 0), ("a[3-12]", 10, 0), ("x7of9", 0, 1), ("x[7]", 0, 1), ("a[9-2]b[1-5]", -6, 0), ("x[0-9]", 10, 0)],
)
def test_array_names(spark, name, size, array):
    column = F.lit(name).cast("string")
    assert _one(spark, names.array_job_size(column)) == size
    assert _one(spark, names.name_flag(column, "is_array_job")) == array
    assert _one(spark, names.name_length(column)) == len(name or "")


@pytest.mark.parametrize("name, flags", [("My_MPI", "is_mpi_job"), ("CuDa9", "is_gpu_job"), ("DEBUGrun", "is_test_job"), ("Production", "is_prod_job"), ("x1", "name_has_numbers")])
def test_name_flags(spark, name, flags):
    assert _one(spark, names.name_flag(F.lit(name), flags)) == 1
    assert _one(spark, names.name_flag(F.lit("plain"), flags)) == 0


@pytest.mark.parametrize(
    "seconds, text",
    [(59.9, "59.9s"), (60.0, "1m 0s"), (3599.0, "59m 59s"), (3600.0, "1h 0m 0s"), (86399.0, "23h 59m 59s"), (86400.0, "1d 0h 0m"), (200000.5, "2d 7h 33m"), (0.0, "0.0s")],
)
def test_format_runtime(spark, seconds, text):
    assert _one(spark, R.format_runtime(F.lit(seconds))) == text


def test_efficiency_is_capped_and_guarded(spark):
    assert _one(spark, R.efficiency(F.lit(200.0), F.lit(100.0))) == 100.0
    assert _one(spark, R.efficiency(F.lit(50.0), F.lit(200.0))) == 25.0
    assert _one(spark, R.efficiency(F.lit(50.0), F.lit(0.0))) == 0.0
    assert _one(spark, R.efficiency(F.lit(50.0), F.lit(None).cast("double"))) is None


def test_advice_and_categories(spark):
    advice = [_one(spark, R.walltime_advice(F.lit(p), F.lit(100.0))) for p in (49.0, 50.0, 90.0, 91.0)]
    assert advice == ["reduce", None, None, "add buffer"]
    assert [_one(spark, R.runtime_category(F.lit(s))) for s in (3599.0, 3600.0, 14400.0, 86400.0)] == ["short", "medium", "long", "very_long"]
    assert [_one(spark, R.gauge_band(F.lit(v))) for v in (80, 79, 60, 59)] == ["green", "orange", "orange", "red"]


def test_products_do_not_wrap(spark):
    assert _one(spark, res.total_compute_units(F.lit(2_000_000_000), F.lit(8))) == 16_000_000_000
    assert _one(spark, res.cpu_efficiency_score(F.lit(256), F.lit(8))) == 1.0
    assert _one(spark, res.memory_per_cpu(F.lit(10.0), F.lit(0))) == 10.0
    assert _one(spark, res.memory_per_cpu(F.lit(10.0), F.lit(None).cast("int"))) is None


def test_wait_is_never_negative_or_missing(spark):
    t = datetime(2024, 1, 1, tzinfo=timezone.utc)
    later = datetime(2024, 1, 1, 0, 0, 1, 500000, tzinfo=timezone.utc)
    assert _one(spark, cal.queue_wait_time(F.lit(later), F.lit(t))) == 1.5
    assert _one(spark, cal.queue_wait_time(F.lit(t), F.lit(later))) == 0.0
    assert _one(spark, cal.queue_wait_time(F.lit(None).cast("timestamp"), F.lit(t))) == 0.0


def test_feature_key_ignores_field_order(spark):
    df = spark.range(1).select(F.lit(1).alias("a"), F.lit("x").alias("b"))
    keys = df.select(R.feature_key(["a", "b"]).alias("p"), R.feature_key(["b", "a"]).alias("q")).first()
    assert keys["p"] == keys["q"]
