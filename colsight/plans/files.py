"""Profiles of file sources: schemas from buckets, broken records and damaged files set aside."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsight.config import ProfileConfig
from colsight.functions.rows import constant_rows
from colsight.operators.cells import union_all
from colsight.plans.run import TableName, profile_run
from colsight.sources.quarantine import sound_parquet
from colsight.sources.readers import FileSource, file_format, read, table_name
from colsight.sources.records import REJECTED, Records, read_records
from colsight.sources.staging import columnar

LOCAL = "files"


def bucket_of(path: str) -> str:
    """The bucket or host of a URI; ``files`` for a path without one."""
    found = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/]+)/", path)
    return found[1] if found else LOCAL


def named_sources(sources: Sequence[FileSource]) -> dict[TableName, FileSource]:
    """Sources by bucket and table name; equal names of one bucket are numbered."""
    named: dict[TableName, FileSource] = {}
    for source in sources:
        schema, base = bucket_of(source.path), table_name(source)
        name, suffix = base, 2
        while (schema, name) in named:
            name, suffix = f"{base}_{suffix}", suffix + 1
        named[schema, name] = source
    return named


@dataclass(frozen=True)
class FileRun:
    """``profile``: the column profile of a run; ``tables``: ``schema_name, table_name, description``, the description being the
    path; ``rejected``: ``schema_name, table_name`` and what could not be read of the table, by file, line and reason."""

    profile: DataFrame
    tables: DataFrame
    rejected: DataFrame


def file_run(spark: SparkSession, sources: Sequence[FileSource], config: ProfileConfig | None = None) -> FileRun:
    """Profiles every source as one table; what is broken loses its record or its file, not its table.

    CSV and JSON sources are read once (:func:`colsight.sources.records.read_records`). A Parquet source is profiled as it is; only if that fails are its
    damaged files searched and the table is profiled again without them. A path that cannot be read at all is a failed row of the profile.
    """
    if not sources:
        raise ValueError("no paths are given")
    config = config or ProfileConfig()
    named = named_sources(sources)
    records: dict[TableName, Records] = {}

    def reader(name: TableName, source: FileSource) -> Callable[[], DataFrame]:
        def staged() -> DataFrame:
            records[name] = read_records(spark, source)
            return records[name].rows

        return (lambda: read(spark, source)) if file_format(source) == "parquet" else staged

    profile = profile_run(spark, {name: reader(name, source) for name, source in named.items()}, config)
    lost = profile.where("failed and reason <> 'deadline'").select("schema_name", "table_name").distinct().collect()  # failed tables
    again = {(r.schema_name, r.table_name) for r in lost if file_format(named[r.schema_name, r.table_name]) == "parquet"}
    second: dict[TableName, Callable[[], DataFrame]] = {}
    for name in again:
        try:
            records[name] = sound_parquet(spark, named[name])
        except Exception:  # noqa: BLE001  no file of the table can be read: it stays failed
            continue
        second[name] = lambda name=name: records[name].rows
    if second:
        renewed = profile_run(spark, second, config)
        gone = constant_rows(spark, list(second), "schema_name string, table_name string")
        profile = profile.join(F.broadcast(gone), ["schema_name", "table_name"], "left_anti").unionByName(renewed, allowMissingColumns=True)
    tables = constant_rows(spark, [(*name, source.path) for name, source in named.items()], "schema_name string, table_name string, description string")
    parts = [r.rejected.select(F.lit(schema).alias("schema_name"), F.lit(table).alias("table_name"), "file", "line", "reason", "record") for (schema, table), r in records.items()]
    rejected = columnar(union_all(parts)) if parts else constant_rows(spark, [], f"schema_name string, table_name string, {REJECTED}")
    return FileRun(profile, tables, rejected)


def file_profile(spark: SparkSession, sources: Sequence[FileSource], config: ProfileConfig | None = None) -> DataFrame:
    """The profile of :func:`file_run` by table name alone, without the paths that cannot be read."""
    profile = file_run(spark, sources, config).profile.where("column_name is not null")
    if profile.isEmpty():
        raise RuntimeError("none of the given paths could be read")
    return profile.drop("schema_name", "sample_values", "failed", "reason")
