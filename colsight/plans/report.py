"""One call from tables and catalog frames to finished table documents."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsight.config import ProfileConfig
from colsight.functions.rows import table_key
from colsight.operators import filters, sensitivity
from colsight.operators.cells import union_all
from colsight.plans import detect, document
from colsight.plans.run import TableName, profile_run, table_facts, union_readers
from colsight.sources.staging import columnar


@dataclass(frozen=True)
class CatalogFrames:
    """What is known of the tables beside their rows, as the operators of :mod:`colsight.operators.catalog` give it.

    ``keys``, ``relationships``, ``indexes`` and ``checks`` are those of :func:`colsight.plans.detect.candidates`; ``estimates`` holds row counts of
    tables that are not profiled. ``facts`` are further frames for :func:`colsight.plans.run.table_facts`, by the name of its argument.
    """

    keys: DataFrame
    relationships: DataFrame
    indexes: DataFrame
    checks: DataFrame | None = None
    estimates: DataFrame | None = None
    facts: Mapping[str, DataFrame] | None = None


def run_report(
    spark: SparkSession,
    readers: Mapping[TableName, Callable[[], DataFrame]],
    catalog: CatalogFrames,
    config: ProfileConfig | None = None,
    limits: Mapping[TableName, float] | None = None,
    verdicts: DataFrame | None = None,
    judgments: DataFrame | None = None,
    look_at_values: bool = True,
) -> DataFrame:
    """``(schema_name, table_name, table)`` with statistics, table role, filter columns, sensitivity and catalog facts.

    ``verdicts`` are sensitivity answers from outside; without them the built-in classifier decides,
    from names and, with ``look_at_values``, from one scan of the text columns. A table that failed or was late
    has its columns, without statistics.
    """
    config = config or ProfileConfig()
    # Profile, scores and verdicts are written once: later steps read these few rows instead of repeating the scans.
    run = profile_run(spark, readers, config, limits)
    key = ["schema_name", "table_name"]
    counted = run.groupBy(*key).agg(F.max("total_count" if "total_count" in run.columns else F.lit(None).cast("bigint")).alias("row_count"))
    parts = table_facts(run, config, **(catalog.facts or {}))
    roles = filters.table_roles(run, counted, catalog.relationships)
    parts = parts.join(roles, key, "left")
    if config.include_column_stats:
        scored = columnar(detect.candidates(run.where("not failed"), catalog.keys, catalog.relationships, catalog.indexes, counted, catalog.checks, catalog.estimates))
        parts = parts.join(filters.filter_column_lists(filters.filter_columns(scored, judgments)), key, "left")

    names = run.where("column_name is not null").select(*key, "column_name")
    if verdicts is None:
        evidence = None
        if look_at_values:
            sound = [(r.schema_name, r.table_name) for r in run.where("not failed").select(*key).distinct().collect()]  # one row per table
            evidence = union_all(
                sensitivity.value_evidence({table: readers[schema, table]()}).withColumn("schema_name", F.lit(schema)) for schema, table in sound
            ) if sound else None
        verdicts = sensitivity.classify(names, evidence)
    marked = sensitivity.apply_verdicts(names, verdicts)
    marked = columnar(marked.join(catalog.keys, table_key(marked, catalog.keys, column=True), "left"))
    return document.table_structs(run, columnar(parts), marked)


def table_report(
    tables: Mapping[str, DataFrame],
    keys: DataFrame,
    relationships: DataFrame,
    indexes: DataFrame,
    config: ProfileConfig | None = None,
    schema_name: str = "default",
    verdicts: DataFrame | None = None,
    judgments: DataFrame | None = None,
    look_at_values: bool = True,
) -> DataFrame:
    """:func:`run_report` of the tables of one schema."""
    spark = next(iter(tables.values())).sparkSession
    catalog = CatalogFrames(keys, relationships, indexes)
    return run_report(spark, union_readers((schema_name, tables)), catalog, config, None, verdicts, judgments, look_at_values)
