"""A profiling run over the tables of several schemas: chosen, admitted by size, bounded in time.

Small tables are profiled together, large ones each in a job of its own. Jobs of both kinds run side by side in two
scheduler pools, so that under ``spark.scheduler.mode=FAIR`` small tables do not wait behind a large one. What a run
has not finished at its deadline is cancelled and listed as failed; what had been finished is kept.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from threading import Condition

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsight.config import ProfileConfig
from colsight.functions.rows import constant_rows
from colsight.plans.tables import table_profile
from colsight.sources.staging import estimated_bytes, shared_folder

logger = logging.getLogger(__name__)

TableName = tuple[str, str]
LIGHT, HEAVY = "colsight-light", "colsight-heavy"
GRACE = 30.0  # seconds that a cancelled job has to end
_LOST = "schema_name string, table_name string, ordinal int, column_name string, data_type string, failed boolean, reason string"


@dataclass(frozen=True)
class Planned:
    """A table whose columns are known, with the optimizer's estimate of its size."""

    name: TableName
    frame: DataFrame
    size: int

    @classmethod
    def of(cls, name: TableName, read: Callable[[], DataFrame]) -> Planned:
        frame = read()
        return cls(name, frame, estimated_bytes(frame))


@dataclass
class Job:
    """Tables that are profiled in one plan."""

    tables: list[Planned]
    limit: float | None
    tag: str = field(default_factory=lambda: f"colsight-{uuid.uuid4().hex}")
    started: float | None = None
    expired_at: float | None = None

    @property
    def expired(self) -> bool:
        return self.expired_at is not None

    @property
    def size(self) -> int:
        return sum(t.size for t in self.tables)


class Admission:
    """Lets jobs in while the sizes of those inside stay within a limit; a job above it waits to be alone."""

    def __init__(self, limit: int) -> None:
        self.limit, self.held, self.changed = limit, 0, Condition()

    def enter(self, size: int, given_up: Callable[[], bool]) -> bool:
        with self.changed:
            while self.held and self.held + size > self.limit:
                if given_up():
                    return False
                self.changed.wait(0.5)
            self.held += size
        return True

    def leave(self, size: int) -> None:
        with self.changed:
            self.held -= size
            self.changed.notify_all()


def jobs_of(tables: list[Planned], config: ProfileConfig, limits: Mapping[TableName, float]) -> Iterator[Job]:
    """Tables by size, small ones together while their columns and bytes stay within a job's bounds.

    A table with a limit of its own, or above the bounds, is a job of its own.
    """
    held: list[Planned] = []
    columns = size = 0
    for table in sorted(tables, key=lambda t: t.size):
        width = len(table.frame.columns)
        if table.name in limits or table.size > config.bytes_per_job or width > config.columns_per_job:
            yield Job([table], limits.get(table.name))
            continue
        if held and (columns + width > config.columns_per_job or size + table.size > config.bytes_per_job):
            yield Job(held, None)
            held, columns, size = [], 0, 0
        held.append(table)
        columns, size = columns + width, size + table.size
    if held:
        yield Job(held, None)


def profile_run(
    spark: SparkSession,
    readers: Mapping[TableName, Callable[[], DataFrame]],
    config: ProfileConfig | None = None,
    limits: Mapping[TableName, float] | None = None,
) -> DataFrame:
    """The column profile of all chosen tables, written once, with ``schema_name``, ``failed`` and ``reason``.

    ``readers`` gives each table by schema and name; the include and exclude lists of ``config`` choose among them. ``limits`` holds
    seconds for single tables, counted from the start of their job; ``timeout_seconds`` holds for the whole run. A table that cannot be
    planned is one row without a column; one that fails or is late keeps its columns, without statistics. If a job of several
    tables fails, only its tables run again, each alone. Without any chosen table the result is empty.
    """
    config = config or ProfileConfig()
    return Run(spark, config, dict(limits or {})).of({name: read for name, read in readers.items() if config.selects(*name)})


class Run:
    """The state of one run: what is under way, what is done and what is lost."""

    def __init__(self, spark: SparkSession, config: ProfileConfig, limits: dict[TableName, float]) -> None:
        self.spark, self.config, self.limits = spark, config, limits
        self.folder = shared_folder(spark)
        self.deadline = time.monotonic() + config.timeout_seconds if config.timeout_seconds else None
        self.admission = Admission(config.concurrent_bytes)
        self.lost: list[tuple] = []
        self.paths: list[str] = []

    def of(self, readers: Mapping[TableName, Callable[[], DataFrame]]) -> DataFrame:
        pool = ThreadPoolExecutor(self.config.max_concurrent_tables)
        try:
            planned = self._plan(pool, readers)
            self._finish(pool, list(jobs_of(planned, self.config, self.limits)))
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
        lost = constant_rows(self.spark, self.lost, _LOST)
        if not self.paths:
            return lost
        done = self.spark.read.parquet(*self.paths).withColumns({"failed": F.lit(False), "reason": F.lit(None).cast("string")})
        return done.unionByName(lost, allowMissingColumns=True) if self.lost else done

    def _late(self) -> bool:
        return self.deadline is not None and time.monotonic() >= self.deadline

    def _plan(self, pool: ThreadPoolExecutor, readers: Mapping[TableName, Callable[[], DataFrame]]) -> list[Planned]:
        waiting = {name: pool.submit(Planned.of, name, read) for name, read in readers.items()}
        planned = []
        for name, future in waiting.items():
            left = None if self.deadline is None else max(0.0, self.deadline - time.monotonic())
            try:
                planned.append(future.result(timeout=left))
            except Exception as error:  # noqa: BLE001  a table that cannot be planned must not lose the others
                future.cancel()
                self._lose_table(name, None, "deadline" if isinstance(error, TimeoutError) else _first_line(error))
        return planned

    def _finish(self, pool: ThreadPoolExecutor, jobs: list[Job]) -> None:
        running: dict[Future, Job] = {pool.submit(self._run, job): job for job in jobs}
        while running:
            done, _ = wait(running, timeout=0.5, return_when=FIRST_COMPLETED)
            for future in done:
                job = running.pop(future)
                reason = None if future.cancelled() else future.result()
                if future.cancelled() or (reason and (len(job.tables) == 1 or job.expired)):
                    for table in job.tables:
                        self._lose_table(table.name, table.frame, reason or "deadline")
                elif reason:
                    running |= {pool.submit(self._run, alone): alone for alone in (Job([t], None) for t in job.tables)}
                else:
                    self.paths.append(f"{self.folder}/{job.tag}")
            for future, job in running.items():
                over = job.limit is not None and job.started is not None and time.monotonic() - job.started > job.limit
                if over or self._late():
                    job.expired_at = job.expired_at or time.monotonic()
                    if not future.cancel():
                        self.spark.sparkContext.cancelJobsWithTag(job.tag)  # again each time: a job may be between two stages
            for future, job in list(running.items()):
                if job.expired and time.monotonic() - job.expired_at > GRACE:  # busy outside of Spark: nobody waits for it
                    del running[future]
                    for table in job.tables:
                        self._lose_table(table.name, table.frame, "deadline")

    def _run(self, job: Job) -> str | None:
        """Profiles a job's tables; the reason if it fails."""
        if not self.admission.enter(job.size, lambda: job.expired):
            return "deadline"
        job.started = time.monotonic()
        pool = LIGHT if job.size <= self.config.bytes_per_job else HEAVY
        context = self.spark.sparkContext
        context.setLocalProperty("spark.scheduler.pool", pool)
        context.setInterruptOnCancel(True)
        context.addJobTag(job.tag)
        try:
            self._profile(job.tables).write.parquet(f"{self.folder}/{job.tag}")
        except Exception as error:  # noqa: BLE001  a broken table must not lose the others
            return "deadline" if job.expired else _first_line(error)
        finally:
            context.removeJobTag(job.tag)
            context.setLocalProperty("spark.scheduler.pool", None)
            self.admission.leave(job.size)
        return None

    def _profile(self, tables: list[Planned]) -> DataFrame:
        profile = table_profile({str(at): table.frame for at, table in enumerate(tables)}, self.config)
        names = [(str(at), *table.name) for at, table in enumerate(tables)]
        named = constant_rows(self.spark, names, "number string, schema_name string, name string")
        # One row per table of the job.
        joined = profile.join(F.broadcast(named), F.col("table_name") == F.col("number"))
        rest = [c for c in profile.columns if c != "table_name"]
        return joined.select("schema_name", F.col("name").alias("table_name"), *rest)

    def _lose_table(self, name: TableName, frame: DataFrame | None, reason: str) -> None:
        logger.warning("no statistics for %s.%s: %s", *name, reason)
        fields = [(None, None, None)] if frame is None else [(at, f.name, f.dataType.simpleString()) for at, f in enumerate(frame.schema, start=1)]
        self.lost += [(*name, *column, True, reason) for column in fields]


def _first_line(error: Exception) -> str:
    return (str(error).strip() or type(error).__name__).splitlines()[0]


_INDEX = ("index_name", "columns", "is_unique", "is_primary", "index_type")
_LINK = ("constraint_name", "from_column", "to_schema", "to_table", "to_column", "on_update", "on_delete")
_FRESH = ("last_analyze", "last_autoanalyze", "last_vacuum", "last_autovacuum")
_TABLE = ("owner", "description", "size_bytes", "total_size_bytes")


def table_facts(
    run: DataFrame,
    config: ProfileConfig,
    tables: DataFrame | None = None,
    row_counts: DataFrame | None = None,
    indexes: DataFrame | None = None,
    relationships: DataFrame | None = None,
    freshness: DataFrame | None = None,
) -> DataFrame:
    """One row per table of a run: what :data:`colsight.plans.document.TABLE_PARTS` shows beside its columns.

    The frames are those that the operators of :mod:`colsight.operators.catalog` give, keyed by ``table_schema, table_name``. A part that is
    switched off is NULL, one that is asked for and empty is an empty array. Without ``row_counts`` the counts are those of the profile;
    a failed table has none. Rows of tables that the run did not choose are left out.
    """
    key = ["schema_name", "table_name"]
    profiled = run.groupBy(*key).agg(F.max("total_count").alias("row_count") if "total_count" in run.columns else F.lit(None).cast("bigint").alias("row_count"))

    def of_schema(frame: DataFrame) -> DataFrame:
        return frame.withColumnRenamed("table_schema", "schema_name")

    def listed(frame: DataFrame | None, name: str, fields: tuple[str, ...], wanted: bool) -> DataFrame | None:
        if frame is None or not wanted:
            return None
        # As many entries as a table has indexes or keys.
        return of_schema(frame).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

    facts = profiled.drop("row_count") if not config.include_row_counts or row_counts is not None else profiled
    if config.include_row_counts and row_counts is not None:
        facts = facts.join(of_schema(row_counts).select(*key, "row_count"), key, "left")
    if tables is not None:
        known = [c for c in _TABLE if c in tables.columns]
        facts = facts.join(of_schema(tables).select(*key, *known), key, "left")
    wanted = (config.include_indexes, config.include_relationships)
    for frame, name, fields, on in zip((indexes, relationships), ("indexes", "relationships"), (_INDEX, _LINK), wanted, strict=True):
        found = listed(frame, name, fields, on)
        if found is not None:
            facts = facts.join(found, key, "left").withColumn(name, F.coalesce(name, F.array().cast(found.schema[name].dataType)))
    if freshness is not None and config.include_data_freshness:
        facts = facts.join(of_schema(freshness).select(*key, F.struct(*_FRESH).alias("data_freshness")), key, "left")
    return facts


def union_readers(*schemas: tuple[str, Mapping[str, DataFrame]]) -> dict[TableName, Callable[[], DataFrame]]:
    """Readers by schema and table from frames that are already at hand."""
    return {(schema, table): lambda df=df: df for schema, tables in schemas for table, df in tables.items()}
