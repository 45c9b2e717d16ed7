"""Scores of the filter rules, by the numbers of their specification."""

import pytest
from pyspark.sql import functions as F

from colsight.functions.rows import constant_rows
from colsight.operators import filters


def values(spark, schema, rows, column):
    frame = constant_rows(spark, [(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r.out for r in frame.select("i", column.alias("out")).orderBy("i").collect()]


def test_cardinality(spark):
    rows = [(0, 100), (5, 0), (1, 100), (2, 100), (50, 1000), (51, 1000), (500, 1000), (501, 1000), (20000, 1000000), (900000, 1000000)]
    bucket = filters.cardinality_bucket(F.col("d"), F.col("n"))
    assert values(spark, "d bigint, n bigint", rows, bucket) == [
        "constant", "constant", "constant", "boolean", "low_categorical", "high_categorical", "high_categorical",
        "high_cardinality", "high_cardinality", "near_unique",
    ]


def test_dtype(spark):
    rows = [
        ("timestamp without time zone", "near_unique", False), ("boolean", "boolean", False), ("varchar(50)", "low_categorical", False),
        ("text", "near_unique", False), ("bigint", "low_categorical", True), ("int", "low_categorical", False),
        ("int", "near_unique", False), ("decimal(18,4)", "low_categorical", False), ("uuid", "near_unique", False),
    ]
    score = filters.dtype_score(F.col("t"), F.col("b"), F.col("k"))
    assert values(spark, "t string, b string, k boolean", rows, score) == [0.9, 0.9, 0.8, 0.15, 0.05, 0.75, 0.1, 0.05, 0.3]


def test_null_penalty(spark):
    rows = [(v,) for v in (0.0, 0.04, 0.05, 0.29, 0.30, 0.45, 0.60, 0.70, 0.80, 0.90)]
    assert values(spark, "r double", rows, filters.null_penalty(F.col("r"))) == [1, 1, 0.9, 0.9, 0.7, 0.7, 0.4, 0.4, 0.1, 0.1]


def test_names(spark):
    rows = [
        ("order_status", "low_categorical"), ("is_active", "boolean"), ("order_date", "near_unique"), ("created_at", "near_unique"),
        ("product_description", "near_unique"), ("customer_id", "near_unique"), ("customer_id", "low_categorical"),
        ("amount", "near_unique"), ("sales_REGION", "low_categorical"), ("LAST_LOGIN", "near_unique"), ("name", "high_cardinality"),
        (" fiscal_period ", "constant"),
    ]
    score = filters.naming_score(F.col("n"), F.col("b"))
    assert values(spark, "n string, b string", rows, score) == [
        0.8, 0.8, 0.85, 0.1, 0.05, 0.05, 0.5, 0.5, 0.8, 0.1, 0.05, 0.85
    ]


@pytest.mark.parametrize(
    ("top", "expected"),
    [
        (["US", "DE", "FRA"], ("code", 0.9)),
        (["A-1", "B_22", "US"], ("code", 0.8)),
        (["ORD-001", "inv_2", "other value"], ("identifier", 0.1)),
        (["a rather long sentence that goes on and on"], ("free_text", 0.1)),
        (["A VERY LONG SHOUTED VALUE WITH MANY LETTERS"], ("mixed", 0.5)),
        (["Active", "Inactive", None], ("categorical", 0.8)),
        (["US\n", "DE", "FR"], ("code", 0.9)),
        (["1234567890123456789012345678901"], ("free_text", 0.1)),
        ([None], ("unknown", 0.5)),
        ([], ("unknown", 0.5)),
    ],
)
def test_value_patterns(spark, top, expected):
    df = spark.createDataFrame([(top,)], "v array<string>")
    assert tuple(df.select(filters.value_pattern(F.col("v")).alias("p")).first().p) == expected


def test_missing_top_values_are_unknown(spark):
    df = spark.createDataFrame([(None,)], "v array<string>")
    assert df.select(filters.value_pattern(F.col("v")).alias("p")).first().p.pattern == "unknown"


def test_reconcile(spark):
    rows = [(0.7, 0.8, True), (0.7, 0.4, True), (0.7, 0.4, False), (0.9, 0.2, True), (0.5, 0.5, False)]
    verdict = filters.reconcile(F.col("h"), F.col("j"), F.col("s"))
    found = [tuple(v) for v in values(spark, "h double, j double, s boolean", rows, verdict)]
    assert found == [
        (0.75, "llm_agreed"), (0.61, "llm_adjusted"), (0.52, "llm_adjusted"), (0.55, "flagged_for_review"), (0.5, "llm_agreed"),
    ]


def test_triage_needs_a_schema_signal(spark):
    rows = [(0.9, 0.5), (0.9, 0.0), (0.85, 0.5), (0.1, 0.9), (0.15, 0.0)]
    assert values(spark, "c double, s double", rows, filters.triage(F.col("c"), F.col("s"))) == [
        "accept", "review", "review", "reject", "review",
    ]


def test_schema_signals(spark):
    columns = spark.createDataFrame(
        [("t", "id", True, None), ("t", "status", False, ["a", "b"]), ("t", "fk", False, []), ("t", "day", False, None)],
        "table_name string, column_name string, is_primary_key boolean, enum_values array<string>",
    )
    links = constant_rows(
        spark,
        [("t", "c1", "fk", "s", "first"), ("t", "c2", "fk", "s", "second")],
        "table_name string, constraint_name string, from_column string, to_schema string, to_table string",
    )
    indexes = spark.createDataFrame(
        [("t", "a_ix", ["day", "status"], True, False), ("t", "b_ix", ["status", "fk"], False, False), ("t", "pk", ["id", "day"], True, True)],
        "table_name string, index_name string, columns array<string>, is_unique boolean, is_primary boolean",
    )
    rows = {r.column_name: r for r in filters.schema_signals(columns, links, indexes).collect()}
    assert (rows["id"].pk_column_count, rows["id"].is_composite_pk_member, rows["id"].composite_partners) == (1, False, [])
    assert (rows["status"].has_enum_type, rows["status"].is_non_unique_index, rows["status"].composite_partners) == (True, True, ["day", "fk"])
    assert (rows["fk"].fk_referenced_table, rows["fk"].has_enum_type) == ("s.second", False)
    assert (rows["day"].is_non_unique_index, rows["day"].composite_partners) == (False, ["status"])


def test_roles(spark):
    columns = constant_rows(
        spark,
        [("f", "int"), ("f", "double"), ("d", "text"), ("d", "varchar(3)"), ("u", "int")],
        "table_name string, data_type string",
    )
    counts = constant_rows(spark, [("f", 50000), ("d", 50), ("u", None)], "table_name string, row_count bigint")
    links = constant_rows(spark, [("f",), ("f",)], "table_name string")
    roles = {r.table_name: r.table_role for r in filters.table_roles(columns, counts, links).collect()}
    assert roles == {"f": "fact", "d": "dimension", "u": "unknown"}


def test_columns_without_statistics(spark):
    df = spark.createDataFrame(
        [("a", "text", False, ["x", "y", "z"], 10, None, None, None), ("b", "text", False, None, 10, None, None, None)],
        "column_name string, data_type string, is_primary_key boolean, enum_values array<string>, row_count bigint,"
        "distinct_count bigint, null_percentage double, values array<string>",
    )
    rows = {r.column_name: r for r in filters.with_statistical_signals(df).collect()}
    assert (rows["a"].cardinality_bucket, rows["a"].distinct_count) == ("low_categorical", 3)
    assert (rows["b"].cardinality_bucket, rows["b"].repetition_factor) == ("near_unique", 0.0)
