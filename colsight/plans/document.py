"""The nested profile document."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsight.functions.rows import table_key
from colsight.plans.column_profile import column_statistics
from colsight.sources.staging import columnar

_KEEP_NULLS = {"ignoreNullFields": "false"}

# Per table parts that may be added: NULL means not asked for, an empty array means nothing found.
TABLE_PARTS = {
    "owner": "string", "description": "string", "row_count": "bigint", "size_bytes": "bigint",
    "total_size_bytes": "bigint",
    "data_freshness": "struct<last_analyze:timestamp,last_autoanalyze:timestamp,last_vacuum:timestamp,last_autovacuum:timestamp>",
    "indexes": "array<struct<name:string,columns:array<string>,is_unique:boolean,is_primary:boolean,index_type:string>>",
    "relationships": "array<struct<constraint_name:string,from_column:string,to_schema:string,to_table:string,to_column:string,on_update:string,on_delete:string>>",
    "glossary": "array<struct<business_term:string,description:string,synonyms:array<string>>>",
    "table_role": "string",
    "filter_columns": "array<struct<filter_name:string,column_name:string,confidence:double,confidence_source:string,filter_type:string,reasoning:string>>",
}


# Per column parts that may be added; what is not given is NULL, or False for the flags.
COLUMN_PARTS = {
    "is_nullable": "boolean", "column_default": "string", "character_maximum_length": "int", "numeric_precision": "int",
    "numeric_scale": "int", "is_primary_key": "boolean", "description": "string", "enum_values": "array<string>",
    "is_sensitive": "boolean", "sensitivity_type": "string", "sensitivity_level": "string",
}
_FLAGS = ("is_primary_key", "is_sensitive")


def _fields(frame: DataFrame, parts: Mapping[str, str]) -> list[Column]:
    fields = []
    for name, sql_type in parts.items():
        value = F.col(name) if name in frame.columns else F.lit(None)
        value = F.coalesce(value, F.lit(False)) if name in _FLAGS else value
        fields.append(value.cast(sql_type).alias(name))
    return fields


def table_structs(
    profile: DataFrame,
    parts: DataFrame | None = None,
    column_parts: DataFrame | None = None,
    schema_name: str = "default",
) -> DataFrame:
    """One row per table: ``(schema_name, table_name, table)`` with its columns in order.

    ``parts`` holds one row per ``table_name`` with any of :data:`TABLE_PARTS`, ``column_parts`` one
    row per ``table_name, column_name`` with any of :data:`COLUMN_PARTS`. A profile of several schemas carries
    ``schema_name``; it then replaces the argument, and frames that carry it too are matched by both names.
    """
    if "schema_name" not in profile.columns:
        profile = profile.withColumn("schema_name", F.lit(schema_name))
    key = ["schema_name", "table_name"]
    if "total_count" in profile.columns:
        statistics = column_statistics(profile)
    else:  # statistics are switched off
        statistics = profile.select(*key, "ordinal", "column_name", "data_type", F.lit(None).cast("string").alias("statistics"))
    if "sample_values" in profile.columns:
        # Null-safe: a table that could not be planned has one row without a column.
        samples = profile.select(*[F.col(c).alias(f"_{c}") for c in (*key, "ordinal")], "sample_values")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*key, "ordinal")]
        statistics = statistics.join(samples, same).drop(*[f"_{c}" for c in (*key, "ordinal")])
    else:
        statistics = statistics.withColumn("sample_values", F.lit(None).cast("array<string>"))
    if column_parts is not None:
        statistics = statistics.join(column_parts, table_key(statistics, column_parts, column=True), "left")
    field = F.struct(
        F.col("ordinal").alias("ordinal_position"),
        F.col("column_name").alias("name"),
        "data_type",
        *_fields(statistics, COLUMN_PARTS),
        "sample_values",
        "statistics",
    )
    # A table's columns, not its rows, are gathered here.
    listed = F.collect_list(F.when(F.col("column_name").isNotNull(), field))
    tables = statistics.groupBy(*key).agg(F.array_sort(listed).alias("columns"))
    if parts is not None:
        tables = tables.join(parts, table_key(tables, parts), "left")
    table = F.struct(
        F.col("table_name").alias("name"), F.col("schema_name").alias("schema"), *_fields(tables, TABLE_PARTS), "columns"
    )
    return tables.select(*key, table.alias("table"))


def table_documents(tables: DataFrame) -> DataFrame:
    """One JSON document per table: the form to use for catalogs with many tables."""
    return tables.select("schema_name", "table_name", F.to_json("table", _KEEP_NULLS).alias("document"))


def write_report(tables: DataFrame, path: str) -> None:
    """The documents of a report as JSON lines under ``documents``, one per table, and a list of them under ``manifest``.

    The way to store a profile of any number of tables: no row holds more than one table. The manifest has
    ``schema_name, table_name, row_count, columns, characters``.
    """
    documents = columnar(tables.select("schema_name", "table_name", "table.row_count", F.size("table.columns").alias("columns"), F.to_json("table", _KEEP_NULLS).alias("document")))
    documents.select("document").write.text(f"{path}/documents")
    listed = documents.select("schema_name", "table_name", "row_count", "columns", F.length("document").alias("characters"))
    listed.write.parquet(f"{path}/manifest")


def response_document(
    tables: DataFrame,
    database: Mapping[str, str | int | None],
    views: DataFrame | None = None,
    profiled_at: Column | None = None,
    kpis: Column | None = None,
    usage: Column | None = None,
) -> DataFrame:
    """The whole profile as one document; its size follows the catalog, not the data.

    ``views`` holds ``table_schema, table_name, owner, definition``.
    """
    schemas = tables.groupBy("schema_name").agg(F.array_sort(F.collect_list("table")).alias("tables"))
    view_type = "array<struct<name:string,schema:string,owner:string,definition:string>>"
    if views is None:
        schemas = schemas.withColumn("views", F.lit(None).cast(view_type))
    else:
        view = F.struct(
            F.col("table_name").alias("name"), F.col("table_schema").alias("schema"), "owner", "definition"
        )
        listed = views.groupBy(F.col("table_schema").alias("schema_name")).agg(
            F.array_sort(F.collect_list(view)).cast(view_type).alias("views")
        )
        schemas = schemas.join(listed, "schema_name", "left")
    first_table, first_view = F.get("tables.owner", F.lit(0)), F.get("views.owner", F.lit(0))
    schema = F.struct(
        F.col("schema_name").alias("name"),
        F.coalesce(first_table, first_view, F.lit("")).alias("owner"),
        "tables",
        F.coalesce("views", F.array().cast(view_type)).alias("views"),
    )
    gathered = schemas.agg(F.array_sort(F.collect_list(schema)).alias("schemas"))
    kpi_type = "array<struct<name:string,description:string,calculation:string,linked_columns:array<string>>>"
    response = F.struct(
        (profiled_at if profiled_at is not None else F.current_timestamp()).alias("profiled_at"),
        F.struct(*[F.lit(value).alias(name) for name, value in database.items()]).alias("database"),
        "schemas",
        (kpis if kpis is not None else F.lit(None).cast(kpi_type)).alias("kpis"),
        (usage if usage is not None else F.lit(None).cast("string")).alias("usage"),
    )
    return gathered.select(F.to_json(response, _KEEP_NULLS).alias("document"))
