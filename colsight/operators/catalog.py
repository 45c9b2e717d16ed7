"""Catalog metadata over DataFrames shaped like ``information_schema``.

Each function is one relational step for the tables of every schema at once, where a service would
ask the source once per table. Inputs carry ``table_schema`` and ``table_name``; results are not
sorted, positions are columns.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsight.functions.rows import constant_rows
from colsight.operators.cells import union_all

_TABLE = ["table_schema", "table_name"]
_COLUMN = [*_TABLE, "column_name"]
_BLOCK_BYTES = 1024 * 1024  # one storage block


# ── Database, schemas, tables ─────────────────────────────────────────────────


def database(sizes: DataFrame, size: Column, name: str, version: str, encoding: str) -> DataFrame:
    """Name, version, encoding and the summed size in bytes, 0 without any table."""
    total = F.coalesce(F.sum(size), F.lit(0)).cast("bigint")
    return sizes.agg(total.alias("size_bytes")).select(
        F.lit(name).alias("name"), F.lit(version).alias("version"), F.lit(encoding).alias("encoding"), "size_bytes"
    )


def schemas(schemata: DataFrame, excluded: Collection[str], included: Collection[str] | None = None) -> DataFrame:
    """``schema_name, schema_owner`` without the excluded ones; ``included`` narrows the rest."""
    kept = schemata.where(~F.col("schema_name").isin(*excluded)) if excluded else schemata
    return kept if included is None else kept.where(F.col("schema_name").isin(*included))


def _chosen(tables: DataFrame, included: Collection[str] | None, excluded: Collection[str]) -> DataFrame:
    base = tables.where("table_type = 'BASE TABLE'")
    if included is not None:
        base = base.where(F.col("table_name").isin(*included))
    return base.where(~F.col("table_name").isin(*excluded)) if excluded else base


def tables_with_owners(
    tables: DataFrame, owners: DataFrame, included: Collection[str] | None = None, excluded: Collection[str] = ()
) -> DataFrame:
    """Base tables that have a known owner, with sizes and comment."""
    total = F.col("data_length") + F.col("index_length")
    return (
        _chosen(tables, included, excluded)
        .join(owners, "owner_id")
        .select(*_TABLE, "owner", F.col("data_length").alias("size_bytes"), total.alias("total_size_bytes"), "description")
    )


def tables_with_options(tables: DataFrame, options: DataFrame) -> DataFrame:
    """Base tables whose description is kept among the table options, if anywhere."""
    described = options.where("option_name = 'description'").select(*_TABLE, F.col("option_value").alias("description"))
    return (
        _chosen(tables, None, ())
        .drop("description")
        .join(described, _TABLE, "left")
        .select(
            *_TABLE, F.lit(None).cast("string").alias("owner"), F.col("data_length").alias("size_bytes"),
            F.col("data_length").alias("total_size_bytes"), "description",
        )
    )


def tables_with_blocks(tables: DataFrame, owners: DataFrame, blocks: DataFrame) -> DataFrame:
    """Base tables sized by their storage blocks of 1 MiB; a table without blocks has size 0."""
    per_table = blocks.groupBy("table_id").agg((F.count(F.lit(1)) * _BLOCK_BYTES).alias("bytes"))
    size = F.coalesce("bytes", F.lit(0)).cast("bigint")
    return (
        _chosen(tables, None, ())
        .join(owners, "owner_id")
        .join(per_table, "table_id", "left")
        .select(*_TABLE, "owner", size.alias("size_bytes"), size.alias("total_size_bytes"), "description")
    )


def schema_owners(tables: DataFrame, views: DataFrame) -> DataFrame:
    """``(table_schema, owner)``: owner of the first table by name, else of the first view, else empty."""
    ranked = union_all(
        frame.select("table_schema", F.lit(rank).alias("_rank"), "table_name", "owner")
        for rank, frame in enumerate((tables, views))
    )
    first = F.min_by("owner", F.struct("_rank", "table_name"))
    return ranked.groupBy("table_schema").agg(F.coalesce(first, F.lit("")).alias("owner"))


# ── Columns and keys ──────────────────────────────────────────────────────────


def primary_keys(constraints: DataFrame, key_usage: DataFrame) -> DataFrame:
    """``(table_schema, table_name, column_name)`` of primary key constraints."""
    keys = constraints.where("constraint_type = 'PRIMARY KEY'").select(*_TABLE, "constraint_name")
    return key_usage.join(keys, [*_TABLE, "constraint_name"]).select(*_COLUMN)


def primary_keys_by_name(key_usage: DataFrame) -> DataFrame:
    """Engines that name every primary key constraint ``PRIMARY``."""
    return key_usage.where("constraint_name = 'PRIMARY'").select(*_COLUMN)


def columns(columns: DataFrame, keys: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """Column rows with ``is_nullable`` and ``is_primary_key`` as booleans.

    ``comments`` supplies the description where the column rows do not carry one.
    """
    marked = keys.select(*_COLUMN).distinct().withColumn("_key", F.lit(True))
    if comments is not None:
        columns = columns.drop("description").join(comments, _COLUMN, "left")
    return columns.join(marked, _COLUMN, "left").select(
        *_COLUMN, "ordinal_position", "data_type", (F.col("is_nullable") == "YES").alias("is_nullable"),
        "column_default", "character_maximum_length", "numeric_precision", "numeric_scale", "description",
        F.col("_key").isNotNull().alias("is_primary_key"),
    )


def top_level_comments(field_paths: DataFrame) -> DataFrame:
    """Descriptions of top-level fields; nested fields have a longer path."""
    return field_paths.where("field_path = column_name").select(*_COLUMN, "description")


def numbered_comments(attributes: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Descriptions stored per (table id, attribute number)."""
    named = attributes.join(descriptions, ["table_id", "attribute_number"], "left")
    return named.select(*_COLUMN, "description")


def foreign_keys(referential: DataFrame, key_usage: DataFrame, constraints: DataFrame) -> DataFrame:
    """Child and parent column pairs of every foreign key, matched by constraint and position.

    Where ``referential`` names the schema of the parent's constraint (``unique_constraint_schema``), that counts too, so a
    constraint name may be used in several schemas.
    """
    schema = ["to_schema"] if "unique_constraint_schema" in referential.columns else []
    child = key_usage.select(
        F.col("table_schema").alias("constraint_schema"), "constraint_name", F.col("column_name").alias("from_column"),
        "ordinal_position",
    )
    parent = key_usage.select(
        F.col("constraint_name").alias("unique_constraint_name"), F.col("table_schema").alias("to_schema"),
        F.col("table_name").alias("to_table"), F.col("column_name").alias("to_column"), "ordinal_position",
    )
    owner = constraints.select(F.col("table_schema").alias("constraint_schema"), "table_name", "constraint_name")
    rules = referential.select(
        "constraint_schema", "constraint_name", "unique_constraint_name", F.col("update_rule").alias("on_update"),
        F.col("delete_rule").alias("on_delete"), *[F.col("unique_constraint_schema").alias(name) for name in schema],
    )
    return (
        rules.join(child, ["constraint_schema", "constraint_name"])
        .join(owner, ["constraint_schema", "constraint_name"])
        .join(parent, ["unique_constraint_name", "ordinal_position", *schema])
        .select(
            F.col("constraint_schema").alias("table_schema"), "table_name", "constraint_name", "ordinal_position",
            "from_column", "to_schema", "to_table", "to_column", "on_update", "on_delete",
        )
    )


def foreign_keys_from_usage(referential: DataFrame, key_usage: DataFrame) -> DataFrame:
    """Engines whose key usage rows name the referenced column themselves."""
    rules = referential.select("constraint_schema", "constraint_name", "update_rule", "delete_rule")
    used = key_usage.where("referenced_table_name is not null").withColumnRenamed("table_schema", "constraint_schema")
    return used.join(rules, ["constraint_schema", "constraint_name"]).select(
        F.col("constraint_schema").alias("table_schema"), "table_name", "constraint_name", "ordinal_position",
        F.col("column_name").alias("from_column"), F.col("referenced_table_schema").alias("to_schema"),
        F.col("referenced_table_name").alias("to_table"), F.col("referenced_column_name").alias("to_column"),
        F.col("update_rule").alias("on_update"), F.col("delete_rule").alias("on_delete"),
    )


def foreign_keys_from_listing(imported: DataFrame) -> DataFrame:
    """Engines that list imported keys ready-made."""
    return imported.select(
        F.col("fk_schema_name").alias("table_schema"), F.col("fk_table_name").alias("table_name"),
        F.col("fk_name").alias("constraint_name"), F.col("key_sequence").alias("ordinal_position"),
        F.col("fk_column_name").alias("from_column"), F.col("pk_schema_name").alias("to_schema"),
        F.col("pk_table_name").alias("to_table"), F.col("pk_column_name").alias("to_column"),
        F.col("update_rule").alias("on_update"), F.col("delete_rule").alias("on_delete"),
    )


# ── Indexes, views, values ────────────────────────────────────────────────────


def indexes_from_positions(indexes: DataFrame, attributes: DataFrame) -> DataFrame:
    """One row per index with its columns in index order, from arrays of attribute numbers.

    Attribute numbers that are not a positive column number (expressions) are left out.
    """
    key = [*_TABLE, "index_name", "is_unique", "is_primary", "index_type"]
    exploded = indexes.select(*key, F.posexplode("attribute_numbers").alias("_place", "attribute_number"))
    named = exploded.where("attribute_number > 0").join(
        attributes.select(*_TABLE, "attribute_number", "column_name"), [*_TABLE, "attribute_number"]
    )
    return named.groupBy(*key).agg(_in_order("_place").alias("columns"))


def indexes_from_statistics(statistics: DataFrame) -> DataFrame:
    """One row per index from one row per index column."""
    return statistics.groupBy(*_TABLE, "index_name").agg(
        F.max(F.col("non_unique") == 0).alias("is_unique"),
        F.max(F.col("index_name") == "PRIMARY").alias("is_primary"),
        F.min("index_type").alias("index_type"),
        _in_order("seq_in_index").alias("columns"),
    )


def _in_order(position: str) -> Column:
    """Column names of one index in order: as many entries as the index has columns."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("place"), "column_name")))
    return F.transform(ordered, lambda e: e["column_name"])


def views(views: DataFrame, owners: DataFrame, extension_views: DataFrame | None = None) -> DataFrame:
    """Views with owner and definition, without those an extension owns."""
    owned = views.join(owners, "owner_id")
    if extension_views is not None:
        owned = owned.join(extension_views.select("table_id"), "table_id", "left_anti")
    return owned.select(*_TABLE, "owner", "definition")


def enum_labels(labels: DataFrame) -> DataFrame:
    """``enum_values`` per column from one row per label, in sort order."""
    ordered = F.array_sort(F.collect_list(F.struct("sort_order", "label")))
    return labels.groupBy(*_COLUMN).agg(F.transform(ordered, lambda e: e["label"]).alias("enum_values"))


def quoted_values(text: Column) -> Column:
    """Everything between single quotes, in order."""
    return F.regexp_extract_all(text, F.lit("'([^']*)'"), F.lit(1))


def parse_enum(column_type: Column) -> Column:
    """Values of a type text like ``enum('a','b')``; an empty array for any other type."""
    inner = F.regexp_extract(column_type, r"(?i)^enum\((.+)\)\n?\z", 1)
    return quoted_values(inner)


def check_values(checks: DataFrame) -> DataFrame:
    """Quoted values in the text of check constraints, one row per constrained column.

    Constraints without a quoted value are left out. Where several constraints cover a column the
    last one by name counts.
    """
    values = quoted_values(F.col("definition"))
    found = checks.select(*_COLUMN, "constraint_name", values.alias("check_values")).where(F.size("check_values") > 0)
    return found.groupBy(*_COLUMN).agg(F.max_by("check_values", "constraint_name").alias("check_values"))


def check_columns(clauses: DataFrame) -> DataFrame:
    """Constraints that name their column in the text: the first back-quoted word."""
    name = F.regexp_extract("definition", r"`(\w+)`", 1)
    return clauses.withColumn("column_name", name).where("column_name <> ''")


# ── Freshness and row counts ──────────────────────────────────────────────────

# Which timestamp each engine reports as last analyzed and last vacuumed.
_FRESHNESS = {
    "mysql": ("check_time", "update_time"),
    "snowflake": ("last_altered", "last_ddl"),
    "databricks": ("last_altered", "created"),
    "bigquery": ("created", None),
}


def freshness(tables: DataFrame, engine: str) -> DataFrame:
    """Engine timestamps under the common names; what an engine lacks is NULL."""
    names = ("last_analyze", "last_autoanalyze", "last_vacuum", "last_autovacuum")
    if engine in _FRESHNESS:
        analyzed, vacuumed = _FRESHNESS[engine]
        sources = {"last_analyze": analyzed, "last_vacuum": vacuumed}
    else:
        sources = {name: name for name in names}
    return tables.select(
        *_TABLE,
        *[
            (F.col(sources[name]) if sources.get(name) else F.lit(None)).cast("timestamp_ntz").alias(name)
            for name in names
        ],
    )


def freshness_from_runs(runs: DataFrame, tables: DataFrame) -> DataFrame:
    """Time of the last successful analyze run of each table that has one."""
    last = runs.where("status = 0").groupBy("table_id").agg(F.max("run_start_time").alias("last_analyze"))
    return freshness(_with_absent(tables.join(last, "table_id")), "postgres")


def _with_absent(frame: DataFrame) -> DataFrame:
    absent = F.lit(None).cast("timestamp_ntz")
    return frame.withColumns({name: absent for name in ("last_autoanalyze", "last_vacuum", "last_autovacuum")})


def needs_exact_count(tables: DataFrame) -> DataFrame:
    """Tables whose estimate is missing or negative: the only ones to count."""
    return tables.where("row_estimate is null or row_estimate < 0")


def row_counts(tables: DataFrame, exact: DataFrame) -> DataFrame:
    """The estimate where there is a usable one, else the exact count."""
    joined = tables.join(exact, _TABLE, "left")
    usable = F.when(F.col("row_estimate") >= 0, F.col("row_estimate"))
    return joined.select(*_TABLE, F.coalesce(usable, F.col("exact_count")).alias("row_count"))


def file_columns(df: DataFrame, table: str) -> DataFrame:
    """Column rows of a file source, from its schema."""
    rows = [
        (table, i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields, start=1)
    ]
    schema = "table_name string, ordinal_position int, column_name string, data_type string, is_nullable boolean"
    return constant_rows(df.sparkSession, rows, schema)
