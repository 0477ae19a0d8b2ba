"""Features read from the job name; a missing name counts as empty."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What marks a job name (regular expressions).
NAME_PATTERNS = {
    "name_has_numbers": r"\d",
    "is_mpi_job": r"(?i)mpi",
    "is_gpu_job": r"(?i)gpu|cuda",
    "is_array_job": r"(?i)\[\d+\]|\d+of\d+",
    "is_test_job": r"(?i)test|debug",
    "is_prod_job": r"(?i)prod",
}
ARRAY_RANGE = r"\[(\d+)-(\d+)\]"


def _name(name: Column) -> Column:
    return F.coalesce(name, F.lit(""))


def name_length(name: Column) -> Column:
    return F.length(_name(name))


def name_flag(name: Column, flag: str) -> Column:
    return _name(name).rlike(NAME_PATTERNS[flag]).cast("int")


def array_job_size(name: Column) -> Column:
    """Size of the first `[a-b]` in the name, 0 without one."""
    # No match gives '', made NULL first: casting text that is no number is slow.
    low, high = (F.nullif(F.regexp_extract(_name(name), ARRAY_RANGE, i), F.lit("")).try_cast("bigint") for i in (1, 2))
    return F.coalesce(high - low + 1, F.lit(0).cast("bigint"))


def name_features(name: Column) -> dict[str, Column]:
    return {
        "name_length": name_length(name),
        **{flag: name_flag(name, flag) for flag in NAME_PATTERNS},
        "array_job_size": array_job_size(name),
    }
