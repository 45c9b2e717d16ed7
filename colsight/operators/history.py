"""The table of profiling runs: paging, counting, and rewrites in place of updates and deletes.

Parquet has no update; a change is a new version of the table, written next to the old one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Run states and the record of an interrupted run.
RUNNING = ("connecting", "profiling", "augmenting")
TERMINAL = ("completed", "failed", "cancelled")
UNFINISHED = ("pending", "connecting", "profiling", "augmenting", "cancelling")
DETECTING = ("detecting_filters", "detecting_sensitivity")
INTERRUPTED = {"error_code": "SERVER_RESTART", "error_message": "Task was interrupted by server restart"}


def page(runs: DataFrame, filters: Sequence[Column], order: Sequence[Column], skip: int = 0, limit: int = 100) -> DataFrame:
    """One page of the runs that meet every filter."""
    for condition in filters:
        runs = runs.where(condition)
    return runs.orderBy(*order).offset(skip).limit(limit) if order else runs.offset(skip).limit(limit)


def count(runs: DataFrame, filters: Sequence[Column], key: str) -> DataFrame:
    for condition in filters:
        runs = runs.where(condition)
    return runs.agg(F.count(key).alias("count"))


def existing(wanted: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """``wanted`` with ``present``: whether each key occurs among the runs."""
    found = runs.select(key).distinct().withColumn("present", F.lit(True))
    return wanted.join(found, key, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def insert(runs: DataFrame, added: DataFrame) -> DataFrame:
    return runs.unionByName(added, allowMissingColumns=True)


def update(runs: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Each change replaces the fields it gives; a NULL field is not given.

    Of several changes of one key the last that gives a field wins, by the column ``order`` of ``changes``, which is
    not a field itself; without it, and where it is equal, the largest value wins.
    """
    fields = [name for name in changes.columns if name not in (key, order)]
    last = F.col(order) if order else F.lit(0)
    given = [F.max(F.when(F.col(name).isNotNull(), F.struct(last.alias("at"), F.col(name).alias("value"))))["value"].alias(f"_{name}") for name in fields]
    renamed = changes.groupBy(key).agg(*given)
    joined = runs.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"_{n}", n).alias(n) if n in fields else F.col(n) for n in runs.columns])


def updated_count(runs: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    return runs.join(changes.select(key), key, "left_semi").agg(F.count(F.lit(1)).alias("updated_count"))


def delete(runs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return runs.join(ids.select(key), key, "left_anti")


def running_count(runs: DataFrame, with_detecting: bool = False) -> DataFrame:
    states = RUNNING + DETECTING if with_detecting else RUNNING
    return runs.agg(F.count_if(F.col("status").isin(*states)).alias("running_count"))


def retained(runs: DataFrame, hours: int, now: Column) -> DataFrame:
    """Runs that are not finished, or not older than ``hours``."""
    if hours < 1:
        raise ValueError(f"hours must be at least 1, got {hours}")
    cutoff = now - F.make_dt_interval(hours=F.lit(hours))
    expired = F.col("status").isin(*TERMINAL) & (F.col("created_at") < cutoff)
    return runs.where(~F.coalesce(expired, F.lit(False)))


def mark_interrupted(runs: DataFrame, now: Column, with_detecting: bool = False) -> DataFrame:
    """Unfinished runs become failed."""
    states = UNFINISHED + DETECTING if with_detecting else UNFINISHED
    stale = F.col("status").isin(*states)
    values: Mapping[str, Column] = {name: F.lit(value) for name, value in INTERRUPTED.items()}
    values = {**values, "completed_at": now, "status": F.lit("failed")}
    return runs.select(*[F.when(stale, values[n]).otherwise(F.col(n)).alias(n) if n in values else F.col(n) for n in runs.columns])


def duration(started_at: Column, completed_at: Column, now: Column) -> Column:
    """Seconds with three decimals; up to ``now`` for a run that has not ended, NULL if not started."""
    end = F.coalesce(completed_at, now)
    microseconds = F.timestamp_diff("MICROSECOND", started_at, end)
    return F.round(microseconds / 1_000_000, 3)
