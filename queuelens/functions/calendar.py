"""Calendar features of a submission time."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hour_of_day(t: Column) -> Column:
    return F.hour(t)


def day_of_week(t: Column) -> Column:
    """Monday is 0."""
    return F.weekday(t)


def is_weekend(t: Column) -> Column:
    return (F.weekday(t) >= 5).cast("int")


def is_night(t: Column) -> Column:
    return ((F.hour(t) >= 20) | (F.hour(t) < 6)).cast("int")


def is_business_hours(t: Column) -> Column:
    return (F.hour(t).between(9, 16) & (F.weekday(t) < 5)).cast("int")


def calendar_features(t: Column, advanced: bool = True) -> dict[str, Column]:
    found = {
        "hour_of_day": hour_of_day(t),
        "day_of_week": day_of_week(t),
        "is_weekend": is_weekend(t),
        "month": F.month(t),
        "quarter": F.quarter(t),
    }
    if advanced:
        found |= {
            "is_night": is_night(t),
            "is_business_hours": is_business_hours(t),
            "day_of_month": F.dayofmonth(t),
            "week_of_year": F.weekofyear(t),
        }
    return found


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def queue_wait_time(start: Column, submit: Column) -> Column:
    """Seconds waited; unknown or negative waits are 0."""
    return F.greatest(F.coalesce(seconds_between(start, submit), F.lit(0.0)), F.lit(0.0))


def epoch_to_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)
