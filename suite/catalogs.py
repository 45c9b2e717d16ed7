"""Catalog and overview queries over the derived catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsight.operators import catalog, overview
from colsight.operators.cells import union_all
from colsight.sources import provider
from colsight.sources.staging import columnar, shared_folder
from suite.derived import ctes, derived, derived_frames
from suite.profiles import SCHEMAS
from suite.tables import NAMES, load

EXCLUDED = ("schema_1", "schema_2", "schema_3")


def _frames(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return derived_frames(spark, sf_dir, *names)


def joined(array: str) -> F.Column:
    return F.array_join(array, ",").alias(array)


def cat_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    (tables,) = _frames(spark, sf_dir, "tables")
    return catalog.database(tables, F.col("data_length") + F.col("index_length"), "orders", "1.0", "UTF-8")


def cat_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.schemas(derived(spark, sf_dir, "schemata"), EXCLUDED)


def cat_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three ways engines describe tables, under one column list."""
    tables, owners, options, blocks = _frames(spark, sf_dir, "tables", "owners", "options", "blocks")
    variants = {
        "owners": catalog.tables_with_owners(tables, owners, excluded=("table_5", "table_6")),
        "options": catalog.tables_with_options(tables, options),
        "blocks": catalog.tables_with_blocks(tables, owners, blocks),
    }
    parts = [frame.withColumn("variant", F.lit(name)) for name, frame in variants.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def cat_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns, constraints, usage = _frames(spark, sf_dir, "columns", "constraints", "key_usage")
    return catalog.columns(columns, catalog.primary_keys(constraints, usage))


def cat_column_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments by field path and by attribute number, attached to their columns."""
    columns = columnar(derived(spark, sf_dir, "columns").select("table_schema", "table_name", "column_name", "table_id", "attribute_number", "description", "l_linestatus"))  # read three times
    nested = F.when(F.col("l_linestatus") == "F", F.col("column_name")).otherwise(F.concat("column_name", F.lit(".part")))
    by_path = catalog.top_level_comments(columns.withColumn("field_path", nested))
    numbered = columns.select("table_id", "attribute_number", F.concat(F.lit("number "), "attribute_number").alias("description"))
    by_number = catalog.numbered_comments(columns.drop("description"), numbered.where("attribute_number % 2 = 0"))
    parts = [frame.withColumn("variant", F.lit(name)) for name, frame in (("path", by_path), ("number", by_number))]
    return parts[0].unionByName(parts[1])


def cat_primary_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.primary_keys(*_frames(spark, sf_dir, "constraints", "key_usage"))


def cat_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.foreign_keys(*_frames(spark, sf_dir, "referential", "key_usage", "constraints"))


def cat_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes from per-column rows, and from arrays of attribute numbers."""
    statistics, columns = _frames(spark, sf_dir, "statistics", "columns")
    by_row = catalog.indexes_from_statistics(statistics)
    arrays = columns.groupBy("table_schema", "table_name").agg(
        F.reverse(F.array_sort(F.collect_list("attribute_number"))).alias("attribute_numbers")
    )
    arrays = arrays.selectExpr(
        "table_schema", "table_name", "'ix_all' as index_name", "true as is_unique", "false as is_primary",
        "'btree' as index_type", "array_append(attribute_numbers, 0) as attribute_numbers",
    )
    by_array = catalog.indexes_from_positions(arrays, columns)
    return by_row.unionByName(by_array).withColumn("columns", joined("columns"))


def cat_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.views(*_frames(spark, sf_dir, "views", "owners", "extension_views"))


def cat_enum_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values parsed from type texts, and labels gathered in sort order."""
    (columns,) = _frames(spark, sf_dir, "columns")
    values = catalog.parse_enum(F.col("data_type"))
    parsed = columns.select("table_schema", "table_name", "column_name", values.alias("enum_values"))
    labels = columns.selectExpr(
        "table_schema", "table_name", "'state' as column_name", "-ordinal_position as sort_order", "column_name as label"
    )
    gathered = catalog.enum_labels(labels)
    return parsed.unionByName(gathered).withColumn("enum_values", joined("enum_values"))


def cat_check_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks, clauses = _frames(spark, sf_dir, "checks", "clauses")
    parts = [
        catalog.check_values(frame).withColumn("variant", F.lit(name))
        for name, frame in (("definition", checks), ("clause", catalog.check_columns(clauses)))
    ]
    return parts[0].unionByName(parts[1]).withColumn("check_values", joined("check_values"))


def cat_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps of five engines under common names, one of which has all four, and the last successful run of a sixth."""
    tables, runs = _frames(spark, sf_dir, "tables", "runs")
    frames = {engine: catalog.freshness(tables, engine) for engine in ("mysql", "snowflake", "databricks", "bigquery")}
    own_names = {"check_time": "last_analyze", "update_time": "last_autoanalyze", "last_altered": "last_vacuum", "created": "last_autovacuum"}
    frames["postgres"] = catalog.freshness(tables.withColumnsRenamed(own_names), "postgres")
    frames["redshift"] = catalog.freshness_from_runs(runs, tables)
    parts = [frame.withColumn("engine", F.lit(engine)) for engine, frame in frames.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.withColumns({c: F.col(c).cast("string") for c in ("last_analyze", "last_autoanalyze", "last_vacuum", "last_autovacuum")})


def cat_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates, with exact counts of line items only for the tables that need one."""
    (tables,) = _frames(spark, sf_dir, "tables")
    wanted = catalog.needs_exact_count(tables).select("table_id", "table_schema", "table_name")
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("table_id")).agg(F.count("*").alias("lines"))
    exact = wanted.join(lines, "table_id", "left").select(
        "table_schema", "table_name", F.coalesce("lines", F.lit(0)).alias("exact_count")
    )
    return catalog.row_counts(tables, exact)


def cat_file_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of every file, with the number of rows behind them."""
    parts = []
    for name in NAMES:
        df = load(spark, sf_dir, name)
        rows = df.agg(F.count("*").alias("row_count")).withColumn("table_name", F.lit(name))
        parts.append(catalog.file_columns(df, name).join(F.broadcast(rows), "table_name"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionAll(part)
    return result


def cat_schema_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, owners, views = _frames(spark, sf_dir, "tables", "owners", "views")
    return catalog.schema_owners(catalog.tables_with_owners(tables, owners), catalog.views(views, owners))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemata, tables, views, statistics, constraints, columns = _frames(
        spark, sf_dir, "schemata", "tables", "views", "statistics", "constraints", "columns"
    )
    objects = {
        "table": tables.where("table_type = 'BASE TABLE'"),
        "view": views,
        "index": overview.distinct_indexes(statistics),
        "relationship": constraints.where("constraint_type = 'FOREIGN KEY'"),
        "column": columns,
    }
    return overview.schema_counts(schemata, objects, EXCLUDED)


def ovr_schema_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


def ovr_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.totals(_counts(spark, sf_dir))


def ovr_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct indexes and foreign keys per schema, rows with a NULL name left out."""
    schemata, statistics, referential = _frames(spark, sf_dir, "schemata", "statistics", "referential")
    gaps = statistics.withColumn("index_name", F.expr("nullif(index_name, 'ix_a')"))
    objects = {"index": overview.distinct_indexes(gaps), "relationship": overview.distinct_foreign_keys(referential)}
    counts = overview.schema_counts(schemata, objects)
    return counts.select("schema_name", "index_count", "relationship_count")


def ovr_view_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemata, tables, columns = _frames(spark, sf_dir, "schemata", "tables", "columns")
    return overview.schema_counts(schemata, overview.by_table_type(tables) | {"column": columns})


def ovr_no_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemata, tables, views, constraints = _frames(spark, sf_dir, "schemata", "tables", "views", "constraints")
    objects = {
        "table": tables.where("table_type = 'BASE TABLE'"),
        "view": views,
        "relationship": constraints.where("constraint_type = 'FOREIGN KEY'"),
    }
    return overview.schema_counts(schemata, objects)


def cat_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables and a view saved in Spark's catalog: columns with comments, row estimates and view texts, as the catalog gives them."""
    name = f"colsight_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{shared_folder(spark)}'")
    try:
        for table in ("orders", "nation"):
            load(spark, sf_dir, table).write.saveAsTable(f"{name}.{table}")
        spark.sql(f"ALTER TABLE {name}.orders ALTER COLUMN o_custkey COMMENT 'who ordered'")
        spark.sql(f"COMMENT ON TABLE {name}.orders IS 'all orders'")
        spark.sql(f"CREATE VIEW {name}.finished AS SELECT o_orderkey, o_totalprice FROM {name}.orders WHERE o_orderstatus = 'F'")
        spark.sql(f"ANALYZE TABLE {name}.orders COMPUTE STATISTICS")
        found = provider.spark_catalog(spark, [name])
        tables, columns, views = (columnar(found[part]) for part in ("tables", "columns", "views"))
        base = tables.where("table_type = 'BASE TABLE'")
        guessed = catalog.needs_exact_count(base).collect()  # tables without an estimate
        exact = [spark.table(f"{name}.{r.table_name}").agg(F.count("*").alias("exact_count")).select(F.lit(name).alias("table_schema"), F.lit(r.table_name).alias("table_name"), "exact_count") for r in guessed]
        counts = columnar(catalog.row_counts(base, union_all(exact)))
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")
    key = ["table_schema", "table_name"]
    known = catalog.columns(columns, columns.where("1 = 0").select(*key, "column_name")).join(counts, key, "left").join(views.select(*key, "definition"), key, "left")
    about = tables.select(*key, "table_type", F.col("description").alias("about"), (F.col("data_length") > 0).alias("has_size"), F.col("created").isNotNull().alias("has_time"))
    plain = F.regexp_replace("definition", name, "live").alias("definition")
    return known.join(about, key).select(
        "table_name", "column_name", "ordinal_position", "data_type", "is_nullable", "description", "is_primary_key", "row_count", "table_type", "about", "has_size", "has_time", plain
    )


def cat_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived catalog exported as CSV, JSON and Parquet, read back by the names of its parts, and its columns with their keys."""
    path = shared_folder(spark)
    columns, constraints, usage = _frames(spark, sf_dir, "columns", "constraints", "key_usage")
    columns.drop("l_returnflag", "l_linestatus", "l_partkey", "l_suppkey", "l_quantity").write.option("quoteAll", True).option("escape", '"').csv(f"{path}/columns.csv", header=True)
    constraints.write.json(f"{path}/constraints.json")
    usage.write.parquet(f"{path}/key_usage.parquet")
    found = provider.export_folder(spark, path)
    return catalog.columns(found["columns"], catalog.primary_keys(found["constraints"], found["key_usage"]))


QUERIES = {
    f.__name__: f
    for f in (
        cat_live, cat_export, cat_database, cat_schemas, cat_tables, cat_columns, cat_column_comments, cat_primary_keys, cat_foreign_keys,
        cat_indexes, cat_views, cat_enum_values, cat_check_values, cat_freshness, cat_row_count, cat_file_columns,
        cat_schema_owner, ovr_schema_counts, ovr_totals, ovr_distinct_counts, ovr_view_by_type, ovr_no_index,
    )
}

_EXCEPT = "not in ('schema_1', 'schema_2', 'schema_3')"
_T = "table_schema, table_name"


def _per_schema(table: str, where: str = "true", what: str = "count(*)") -> str:
    return f"coalesce((select {what} from {table} x where x.table_schema = s.schema_name and {where}), 0)"


_INDEX_COUNT = "count(distinct x.table_name || '/' || x.index_name)"
_SCHEMA_COUNTS = f"""select schema_name, {_per_schema('d_tables', "table_type = 'BASE TABLE'")} as table_count,
    {_per_schema('d_views')} as view_count, {_per_schema('d_statistics', what=_INDEX_COUNT)} as index_count,
    {_per_schema('d_constraints', "constraint_type = 'FOREIGN KEY'")} as relationship_count, {_per_schema('d_columns')} as column_count
    from d_schemata s where schema_name {_EXCEPT}"""
_COUNTED = ("schemata", "tables", "views", "statistics", "constraints", "columns")
_QUOTES = "regexp_extract_all({}, '''([^'']*)''', 1)"

ORACLE = {
    "cat_database": ctes("tables")
    + "select 'orders' as name, '1.0' as version, 'UTF-8' as encoding, sum(data_length + index_length)::bigint as size_bytes from d_tables",
    "cat_schemas": ctes("schemata") + f"select * from d_schemata where schema_name {_EXCEPT}",
    "cat_tables": ctes("tables", "owners", "options", "blocks")
    + f"""select {_T}, owner, data_length as size_bytes, data_length + index_length as total_size_bytes, description, 'owners' as variant
        from d_tables join d_owners using (owner_id) where table_type = 'BASE TABLE' and table_name not in ('table_5', 'table_6')
        union all select {_T}, null, data_length, data_length, option_value, 'options' from d_tables
        left join (select * from d_options where option_name = 'description') using ({_T}) where table_type = 'BASE TABLE'
        union all select {_T}, owner, coalesce(b.n, 0) * 1048576, coalesce(b.n, 0) * 1048576, description, 'blocks'
        from d_tables t join d_owners using (owner_id) left join (select table_id, count(*) as n from d_blocks group by table_id) b on b.table_id = t.table_id
        where table_type = 'BASE TABLE'""",
    "cat_columns": ctes("columns", "constraints", "key_usage")
    + f"""select {_T}, column_name, ordinal_position, data_type, is_nullable = 'YES' as is_nullable, column_default, character_maximum_length,
        numeric_precision, numeric_scale, description, exists (select 1 from d_key_usage k join d_constraints t using (constraint_name)
        where t.constraint_type = 'PRIMARY KEY' and k.table_name = c.table_name and k.column_name = c.column_name) as is_primary_key from d_columns c""",
    "cat_export": ctes("columns", "constraints", "key_usage")
    + f"""select {_T}, column_name, ordinal_position, data_type, is_nullable = 'YES' as is_nullable, column_default, character_maximum_length,
        numeric_precision, numeric_scale, description, exists (select 1 from d_key_usage k join d_constraints t using (constraint_name)
        where t.constraint_type = 'PRIMARY KEY' and k.table_name = c.table_name and k.column_name = c.column_name) as is_primary_key from d_columns c""",
    "cat_column_comments": ctes("columns")
    + f"""select {_T}, column_name, description, 'path' as variant from d_columns where l_linestatus = 'F'
        union all select {_T}, column_name, case when attribute_number % 2 = 0 then 'number ' || attribute_number end, 'number' from d_columns""",
    "cat_primary_keys": ctes("constraints", "key_usage")
    + f"select k.table_schema, k.table_name, column_name from d_key_usage k join d_constraints t using ({_T}, constraint_name) where constraint_type = 'PRIMARY KEY'",
    "cat_foreign_keys": ctes("referential", "key_usage", "constraints").rstrip()
    + """,
        r as materialized (select tc.table_schema, tc.table_name, rc.constraint_name, k.ordinal_position, k.column_name as from_column, update_rule, delete_rule,
            concat_ws('#', rc.unique_constraint_schema, rc.unique_constraint_name, k.ordinal_position) as place
            from d_referential rc join d_key_usage k on k.constraint_name = rc.constraint_name and k.table_schema = rc.constraint_schema
            join d_constraints tc on tc.constraint_name = rc.constraint_name and tc.table_schema = rc.constraint_schema),
        p as materialized (select *, concat_ws('#', table_schema, constraint_name, ordinal_position) as place from d_key_usage)
        select r.table_schema, r.table_name, r.constraint_name, r.ordinal_position, from_column, p.table_schema as to_schema,
        p.table_name as to_table, p.column_name as to_column, update_rule as on_update, delete_rule as on_delete from r join p using (place)""",
    "cat_live": """select table_name, column_name, ordinal_position, data_type, true as is_nullable, case when column_name = 'o_custkey' and table_name = 'orders' then 'who ordered' end as description,
        false as is_primary_key, case table_name when 'orders' then (select count(*) from orders) when 'nation' then (select count(*) from nation) end as row_count,
        case table_name when 'finished' then 'VIEW' else 'BASE TABLE' end as table_type, case table_name when 'orders' then 'all orders' end as about,
        table_name = 'orders' as has_size, true as has_time, case table_name when 'finished' then 'SELECT o_orderkey, o_totalprice FROM live.orders WHERE o_orderstatus = ' || chr(39) || 'F' || chr(39) end as definition
        from (values ('orders', 'o_orderkey', 1, 'bigint'), ('orders', 'o_custkey', 2, 'bigint'), ('orders', 'o_orderstatus', 3, 'string'), ('orders', 'o_totalprice', 4, 'double'),
        ('orders', 'o_orderdate', 5, 'timestamp_ntz'), ('orders', 'o_orderpriority', 6, 'string'), ('nation', 'n_nationkey', 1, 'int'), ('nation', 'n_name', 2, 'string'),
        ('nation', 'n_regionkey', 3, 'int'), ('finished', 'o_orderkey', 1, 'bigint'), ('finished', 'o_totalprice', 2, 'double')) t(table_name, column_name, ordinal_position, data_type)""",
    "cat_indexes": ctes("statistics", "columns")
    + f"""select {_T}, index_name, bool_or(non_unique = 0) as is_unique, bool_or(index_name = 'PRIMARY') as is_primary, min(index_type) as index_type,
        string_agg(column_name, ',' order by seq_in_index) as columns from d_statistics group by {_T}, index_name
        union all select {_T}, 'ix_all', true, false, 'btree', string_agg(column_name, ',' order by ordinal_position desc) from d_columns group by {_T}""",
    "cat_views": ctes("views", "owners", "extension_views")
    + f"""select {_T}, owner, definition from d_views v join d_owners using (owner_id)
        where not exists (select 1 from d_extension_views e where e.table_id = v.table_id)""",
    "cat_enum_values": ctes("columns")
    + f"""select {_T}, column_name, case when data_type like 'enum(%)' then array_to_string({_QUOTES.format('data_type')}, ',') else '' end as enum_values from d_columns
        union all select {_T}, 'state', string_agg(column_name, ',' order by ordinal_position desc) from d_columns group by {_T}""",
    "cat_check_values": ctes("checks", "clauses")
    + f"""select {_T}, column_name, array_to_string({_QUOTES.format('definition')}, ',') as check_values, 'definition' as variant from d_checks where definition like '%''%'
        union all select {_T}, regexp_extract(definition, '`(\\w+)`', 1), array_to_string({_QUOTES.format('definition')}, ','), 'clause' from d_clauses where definition like '%`%'""",
    "cat_freshness": ctes("tables", "runs")
    + " union all ".join(
        f"select {_T}, {a}::varchar as last_analyze, {aa}::varchar as last_autoanalyze, {v}::varchar as last_vacuum, {av}::varchar as last_autovacuum,"
        f" '{e}' as engine from d_tables"
        for e, a, aa, v, av in (
            ("mysql", "check_time", "null", "update_time", "null"), ("snowflake", "last_altered", "null", "last_ddl", "null"),
            ("databricks", "last_altered", "null", "created", "null"), ("bigquery", "created", "null", "null", "null"),
            ("postgres", "check_time", "update_time", "last_altered", "created"),
        )
    )
    + f""" union all select {_T}, max(run_start_time)::varchar, null, null, null, 'redshift' from d_tables join d_runs using (table_id)
        where status = 0 group by {_T}""",
    "cat_row_count": ctes("tables")
    + f"""select {_T}, case when row_estimate >= 0 then row_estimate else (select count(*) from lineitem where l_orderkey = t.table_id) end as row_count from d_tables t""",
    "cat_file_columns": " union all ".join(
        f"select '{t}' as table_name, {i} as ordinal_position, '{c}' as column_name, count(*) as row_count, true as is_nullable,"
        f" case any_value(typeof({c})) when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double' when 'VARCHAR' then 'string'"
        f" when 'FLOAT[]' then 'array<float>' else 'timestamp_ntz' end as data_type from {t}"
        for t, columns in SCHEMAS.items()
        for i, c in enumerate(columns, start=1)
    ),
    "cat_schema_owner": ctes("tables", "owners", "views")
    + """select table_schema, coalesce(first(owner order by rank, table_name), '') as owner from (
        select table_schema, 0 as rank, table_name, owner from d_tables join d_owners using (owner_id) where table_type = 'BASE TABLE'
        union all select table_schema, 1, table_name, owner from d_views join d_owners using (owner_id)) group by table_schema""",
    "ovr_schema_counts": ctes(*_COUNTED) + _SCHEMA_COUNTS,
    "ovr_totals": ctes(*_COUNTED)
    + f"""select count(*) as total_schemas, sum(table_count)::bigint as total_tables, sum(view_count)::bigint as total_views, sum(index_count)::bigint as total_indexes,
        sum(relationship_count)::bigint as total_relationships, sum(column_count)::bigint as total_columns from ({_SCHEMA_COUNTS})""",
    "ovr_distinct_counts": ctes("schemata", "statistics", "referential")
    + f"""select schema_name, {_per_schema('d_statistics', "index_name <> 'ix_a'", _INDEX_COUNT)} as index_count,
        coalesce((select count(distinct constraint_name) from d_referential where constraint_schema = schema_name), 0) as relationship_count from d_schemata s""",
    "ovr_view_by_type": ctes("schemata", "tables", "columns")
    + f"""select schema_name, {_per_schema('d_tables', "table_type = 'BASE TABLE'")} as table_count, {_per_schema('d_tables', "table_type = 'VIEW'")} as view_count,
        0::bigint as index_count, 0::bigint as relationship_count, {_per_schema('d_columns')} as column_count from d_schemata s""",
    "ovr_no_index": ctes("schemata", "tables", "views", "constraints")
    + f"""select schema_name, {_per_schema('d_tables', "table_type = 'BASE TABLE'")} as table_count, {_per_schema('d_views')} as view_count,
        0::bigint as index_count, {_per_schema('d_constraints', "constraint_type = 'FOREIGN KEY'")} as relationship_count, 0::bigint as column_count from d_schemata s""",
}
