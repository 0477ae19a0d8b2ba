"""Ratios and flags over requested resources, in double or bigint so that products cannot wrap."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CORES_PER_NODE = 32


def at_least_one(c: Column) -> Column:
    """The larger of the value and 1; unlike `greatest`, a missing value stays missing."""
    return F.when(c < 1, F.lit(1.0)).otherwise(c.cast("double"))


def cpu_memory_ratio(procs: Column, mem: Column) -> Column:
    return procs / at_least_one(mem)


def total_compute_units(procs: Column, nodes: Column) -> Column:
    return procs.cast("bigint") * nodes.cast("bigint")


def resource_intensity(procs: Column, nodes: Column) -> Column:
    return F.log1p(total_compute_units(procs, nodes).cast("double"))


def memory_per_node(mem: Column, nodes: Column) -> Column:
    return mem / at_least_one(nodes)


def walltime_resource_ratio(wall: Column, procs: Column, nodes: Column) -> Column:
    return wall / at_least_one(total_compute_units(procs, nodes))


def memory_per_cpu(mem: Column, procs: Column) -> Column:
    return mem / at_least_one(procs)


def cpu_efficiency_score(procs: Column, nodes: Column) -> Column:
    return procs / at_least_one(nodes.cast("bigint") * CORES_PER_NODE)


def job_complexity_score(procs: Column, nodes: Column, wall: Column) -> Column:
    return resource_intensity(procs, nodes) * wall / F.lit(3600.0)


def above(value: Column, threshold: Column) -> Column:
    """1 where the value is over the threshold; unknown values are not."""
    return F.coalesce((value > threshold).cast("int"), F.lit(0))


def below(value: Column, threshold: Column) -> Column:
    return F.coalesce((value < threshold).cast("int"), F.lit(0))


def user_partition_pair(user: Column, partition: Column) -> Column:
    return F.concat(user, F.lit("_"), partition)
