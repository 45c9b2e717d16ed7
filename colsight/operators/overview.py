"""Counts of catalog objects per schema, without reading any table."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsight.operators.cells import union_all

KINDS = ("table", "view", "index", "relationship", "column")
COUNTS = tuple(f"{kind}_count" for kind in KINDS)


def schema_counts(
    schemata: DataFrame,
    objects: dict[str, DataFrame],
    excluded: Collection[str] = (),
    included: Collection[str] | None = None,
) -> DataFrame:
    """``schema_name`` and one count per kind, for every kept schema; kinds not given count 0.

    ``objects`` maps a kind to a frame with one row per object and its ``table_schema``. All kinds
    are counted in one grouping that is combined on the map side; a schema without objects keeps
    its row because the schema list takes part in it.
    """
    rows = [schemata.select("schema_name", F.lit("schema").alias("kind"))]
    rows += [frame.select(F.col("table_schema").alias("schema_name"), F.lit(kind).alias("kind")) for kind, frame in objects.items()]
    everything = union_all(rows)
    if excluded:
        everything = everything.where(~F.col("schema_name").isin(*excluded))
    if included is not None:
        everything = everything.where(F.col("schema_name").isin(*included))
    counts = [F.count_if(F.col("kind") == kind).alias(f"{kind}_count") for kind in KINDS]
    listed = F.count_if(F.col("kind") == "schema").alias("_listed")
    return everything.groupBy("schema_name").agg(listed, *counts).where("_listed > 0").drop("_listed")


def totals(overview: DataFrame) -> DataFrame:
    """Number of schemas and the sum of each count; zeros without any schema."""
    plural = {"index_count": "total_indexes"}
    sums = [
        F.coalesce(F.sum(name), F.lit(0)).alias(plural.get(name, f"total_{name.removesuffix('_count')}s")) for name in COUNTS
    ]
    return overview.agg(F.count(F.lit(1)).alias("total_schemas"), *sums)


def distinct_indexes(statistics: DataFrame) -> DataFrame:
    """One row per index from one row per index column; rows with a NULL name do not count."""
    named = statistics.where("index_name is not null and table_name is not null")
    return named.select("table_schema", "table_name", "index_name").distinct()


def distinct_foreign_keys(referential: DataFrame) -> DataFrame:
    named = referential.where("constraint_name is not null")
    return named.select(F.col("constraint_schema").alias("table_schema"), "constraint_name").distinct()


def by_table_type(tables: DataFrame) -> dict[str, DataFrame]:
    """Engines that list views among the tables and have neither indexes nor foreign keys."""
    return {
        "table": tables.where("table_type = 'BASE TABLE'"),
        "view": tables.where("table_type = 'VIEW'"),
    }
