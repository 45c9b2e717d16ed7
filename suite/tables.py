"""The given tables, and views of them with NULLs, booleans and empty strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Expression and name, valid in both engines.
LINEITEM_GAPS = {
    "l_orderkey": "l_orderkey",
    "line_gap": "nullif(l_linenumber, 3)",
    "quantity_shift": "l_quantity - 25",
    "l_extendedprice": "l_extendedprice",
    "l_discount": "l_discount",
    "l_returnflag": "l_returnflag",
    "status_gap": "case when l_linestatus = 'O' then '' else l_linestatus end",
    "is_returned": "case when l_returnflag = 'N' then null else l_returnflag = 'R' end",
    "l_shipdate": "l_shipdate",
    "nothing": "cast(null as varchar(10))",
    "l_partkey": "l_partkey",
    "l_suppkey": "l_suppkey",
    "l_tax": "l_tax",
}
ORDERS_GAPS = {
    "o_orderkey": "o_orderkey",
    "o_custkey": "o_custkey",
    "o_orderstatus": "o_orderstatus",
    "o_totalprice": "o_totalprice",
    "o_orderdate": "o_orderdate",
    "priority_gap": "nullif(o_orderpriority, '5-LOW')",
    "is_final": "o_orderstatus = 'F'",
}
VIEWS = {"lineitem": LINEITEM_GAPS, "orders": ORDERS_GAPS}

# Category of each column of the views, as the statistics treat it.
CATEGORIES = {
    "lineitem": dict(
        l_orderkey="numeric", line_gap="numeric", quantity_shift="numeric", l_extendedprice="numeric",
        l_discount="numeric", l_returnflag="string", status_gap="string", is_returned="boolean",
        l_shipdate="temporal", nothing="string", l_partkey="numeric", l_suppkey="numeric", l_tax="numeric",
    ),
    "orders": dict(
        o_orderkey="numeric", o_custkey="numeric", o_orderstatus="string", o_totalprice="numeric",
        o_orderdate="temporal", priority_gap="string", is_final="boolean",
    ),
}


def gap_views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        table: load(spark, sf_dir, table).selectExpr(*[f"{sql} as {name}" for name, sql in columns.items()])
        for table, columns in VIEWS.items()
    }


def gap_ctes() -> str:
    views = [
        f"{table}_gaps as (select {', '.join(f'{sql} as {name}' for name, sql in columns.items())} from {table})"
        for table, columns in VIEWS.items()
    ]
    return "with " + ", ".join(views)


def per_column(template: str, *categories: str) -> str:
    """UNION ALL of ``template`` over the view columns; {t}, {c} and {view} are replaced."""
    parts = [
        template.format(t=table, c=name, view=f"{table}_gaps")
        for table, columns in CATEGORIES.items()
        for name, category in columns.items()
        if not categories or category in categories
    ]
    return gap_ctes() + "\n" + "\nunion all\n".join(parts)
