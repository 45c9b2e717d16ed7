"""Catalog frames from where a catalog is: Spark's own catalog, or a folder with an export of another one.

Both give the frames that :mod:`colsight.operators.catalog` works on, by name.
"""

from __future__ import annotations

from collections.abc import Collection
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colsight.functions.values import quoted
from colsight.sources.readers import FileSource, read

# The frames an export may hold, each a file or folder of this name with any of the known endings.
EXPORTED = ("schemata", "tables", "columns", "constraints", "key_usage", "referential", "statistics", "views", "checks", "owners", "runs")
_ENDINGS = (".parquet", ".csv", ".json", ".jsonl")
_DESCRIBED = "table_schema string, table_name string, description string"


def _field(path: str, kind: str) -> Column:
    return F.try_variant_get("doc", f"$.{path}", kind)


def described_tables(spark: SparkSession, schemas: Collection[str] | None = None, threads: int = 8) -> DataFrame:
    """``table_schema, table_name, description``: what Spark says of each table and view, as JSON.

    One question to the metastore per table, as the metastore answers them one by one; no table is read. Temporary views are left out.
    """
    names = [r.name for r in spark.catalog.listDatabases()] if schemas is None else list(schemas)
    tables = [(name, t.name) for name in names for t in spark.catalog.listTables(name) if not t.isTemporary]

    def describe(table: tuple[str, str]) -> tuple[str, str, str]:
        found = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(table[0])}.{quoted(table[1])} AS JSON").first()
        return (*table, found[0])

    with ThreadPoolExecutor(threads) as pool:
        rows = list(pool.map(describe, tables))
    return spark.createDataFrame(rows, _DESCRIBED)


def spark_catalog(spark: SparkSession, schemas: Collection[str] | None = None) -> dict[str, DataFrame]:
    """``schemata``, ``tables``, ``columns`` and ``views`` of Spark's catalog, with the statistics of ``ANALYZE TABLE``.

    ``tables`` holds views as well, by ``table_type``. ``row_estimate`` is NULL for a table that has not been analyzed; what Spark does not know
    (index sizes, times of checks) is NULL.
    """
    described = described_tables(spark, schemas).select("table_schema", "table_name", F.parse_json("description").alias("doc"))
    key = ["table_schema", "table_name"]
    is_view = _field("type", "string") == "VIEW"
    created = F.coalesce(F.try_to_timestamp(_field("created_time", "string"), F.lit("yyyy-MM-dd'T'HH:mm:ssX")), F.try_to_timestamp(_field("created_time", "string")))
    none = F.lit(None)
    tables = described.select(
        *key,
        F.when(is_view, "VIEW").otherwise("BASE TABLE").alias("table_type"),
        _field("owner", "string").alias("owner"),
        F.coalesce(_field("statistics.size_in_bytes", "bigint"), F.lit(0)).alias("data_length"),
        F.lit(0).cast("bigint").alias("index_length"),
        _field("comment", "string").alias("description"),
        F.when(~is_view, _field("statistics.num_rows", "bigint")).alias("row_estimate"),
        *[created.cast("timestamp_ntz").alias(name) for name in ("created", "last_altered")],
        *[none.cast("timestamp_ntz").alias(name) for name in ("last_ddl", "check_time", "update_time")],
    )
    entry = F.posexplode(F.variant_get("doc", "$.columns", "array<variant>")).alias("at", "item")
    item = described.select(*key, entry)

    def of(path: str, kind: str) -> Column:
        return F.try_variant_get("item", f"$.{path}", kind)

    name = of("type.name", "string")
    sized = F.when(name.isin("char", "varchar"), F.concat(name, F.lit("("), of("type.length", "string"), F.lit(")")))
    exact = F.when(name == "decimal", F.concat(F.lit("decimal("), of("type.precision", "string"), F.lit(","), of("type.scale", "string"), F.lit(")")))
    nested = F.when(name.isin("array", "map", "struct"), F.to_json(F.variant_get("item", "$.type", "variant")))
    columns = item.select(
        *key,
        of("name", "string").alias("column_name"),
        (F.col("at") + 1).cast("int").alias("ordinal_position"),
        F.coalesce(sized, exact, nested, name).alias("data_type"),
        F.when(of("nullable", "boolean"), "YES").otherwise("NO").alias("is_nullable"),
        of("default", "string").alias("column_default"),
        of("type.length", "int").alias("character_maximum_length"),
        of("type.precision", "int").alias("numeric_precision"),
        of("type.scale", "int").alias("numeric_scale"),
        of("comment", "string").alias("description"),
    )
    views = described.where(is_view).select(*key, _field("owner", "string").alias("owner"), _field("view_text", "string").alias("definition"))
    schemata = spark.createDataFrame([(d.name, None) for d in spark.catalog.listDatabases()], "schema_name string, schema_owner string")
    if schemas is not None:
        schemata = schemata.where(F.col("schema_name").isin(*schemas))
    return {"schemata": schemata, "tables": tables, "columns": columns, "views": views}


def export_folder(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The frames of :data:`EXPORTED` that a folder holds, each read by its ending; raises if there is none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in system.listStatus(folder))
    found = {}
    for name in names:
        stem, _, ending = name.partition(".")
        if stem in EXPORTED and (f".{ending}" in _ENDINGS):
            found[stem] = read(spark, FileSource(f"{path.rstrip('/')}/{name}"))
    if not found:
        raise FileNotFoundError(f"no exported catalog under {path}")
    return found
