"""Catalog rules on small fixtures."""

from pyspark.sql import functions as F

from colsight.functions.rows import constant_rows
from colsight.operators import catalog, overview


def test_enum_texts(spark):
    expected = {
        "enum('active','inactive','pending')": ["active", "inactive", "pending"], "ENUM('a','')": ["a", ""],
        "enum('in progress','not-started')": ["in progress", "not-started"], "varchar(20)": [], "enum()": [], "set('a')": [],
    }
    df = spark.createDataFrame([(t,) for t in expected], "t string")
    assert {r.t: r.v for r in df.select("t", catalog.parse_enum(F.col("t")).alias("v")).collect()} == expected


def test_check_texts(spark):
    rows = [
        ("s", "t", "status", "c1", "CHECK ((status = ANY (ARRAY['active'::text, 'off'::text])))"),
        ("s", "t", "amount", "c2", "CHECK ((amount > 0))"),
    ]
    checks = constant_rows(spark, rows, "table_schema string, table_name string, column_name string, constraint_name string, definition string")
    assert [(r.column_name, r.check_values) for r in catalog.check_values(checks).collect()] == [("status", ["active", "off"])]
    clause = checks.drop("column_name").withColumn("definition", F.lit("(`kind` in ('a','b'))"))
    assert {r.column_name for r in catalog.check_columns(clause).collect()} == {"kind"}


def test_overview(spark):
    def repeated(counts):
        rows = [(schema,) for schema, n in counts.items() for _ in range(n)]
        return constant_rows(spark, rows, "table_schema string")

    schemata = constant_rows(spark, [("app",), ("public",), ("pg_catalog",), ("bare",)], "schema_name string")
    objects = {
        "table": repeated({"public": 5, "app": 3, "pg_catalog": 9}), "view": repeated({"public": 2}),
        "index": repeated({"public": 10, "app": 4}), "relationship": repeated({"public": 3}),
        "column": repeated({"public": 30, "app": 15, "lost": 2}),
    }
    counts = overview.schema_counts(schemata, objects, ["pg_catalog"])
    assert {r.schema_name: tuple(r)[1:] for r in counts.collect()} == {
        "public": (5, 2, 10, 3, 30), "app": (3, 0, 4, 0, 15), "bare": (0, 0, 0, 0, 0),
    }
    kept = counts.where("schema_name <> 'bare'")
    assert tuple(overview.totals(kept).first()) == (2, 8, 2, 14, 3, 45)
    assert tuple(overview.totals(counts.where("false")).first()) == (0, 0, 0, 0, 0, 0)
    only = overview.schema_counts(schemata, objects, ["pg_catalog"], ["app", "pg_catalog"])
    assert [r.schema_name for r in only.collect()] == ["app"]


def test_row_counts_use_estimates_where_usable(spark):
    tables = constant_rows(
        spark, [("s", "a", 5), ("s", "b", -1), ("s", "c", None), ("s", "d", 0)], "table_schema string, table_name string, row_estimate bigint"
    )
    assert {r.table_name for r in catalog.needs_exact_count(tables).collect()} == {"b", "c"}
    exact = constant_rows(spark, [("s", "b", 7)], "table_schema string, table_name string, exact_count bigint")
    assert {r.table_name: r.row_count for r in catalog.row_counts(tables, exact).collect()} == {"a": 5, "b": 7, "c": None, "d": 0}


def test_primary_keys_and_keys_by_usage(spark):
    usage = constant_rows(
        spark,
        [("s", "t", "PRIMARY", "id", 1, None, None, None), ("s", "t", "fk", "ref", 1, "s", "u", "id")],
        "table_schema string, table_name string, constraint_name string, column_name string, ordinal_position int,"
        "referenced_table_schema string, referenced_table_name string, referenced_column_name string",
    )
    rules = constant_rows(
        spark, [("s", "fk", "CASCADE", "NO ACTION")], "constraint_schema string, constraint_name string, update_rule string, delete_rule string"
    )
    assert [r.column_name for r in catalog.primary_keys_by_name(usage).collect()] == ["id"]
    found = catalog.foreign_keys_from_usage(rules, usage).first()
    assert (found.from_column, found.to_table, found.to_column, found.on_update) == ("ref", "u", "id", "CASCADE")
    listing = constant_rows(
        spark,
        [("s", "t", "fk", 1, "ref", "s", "u", "id", "CASCADE", "NO ACTION")],
        "fk_schema_name string, fk_table_name string, fk_name string, key_sequence int, fk_column_name string,"
        "pk_schema_name string, pk_table_name string, pk_column_name string, update_rule string, delete_rule string",
    )
    assert catalog.foreign_keys_from_listing(listing).first() == found
