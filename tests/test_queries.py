"""Every registered query against its SQL on the smallest tables."""

import json

import pytest

import __spark_entry__ as entry
from colsight.plans import document
from suite.compare import differences, oracle_connection
from suite.filtering import COLUMNS, report_structs
from suite.tables import LINEITEM_GAPS

SF_DIR = "/root/testdata/sf0.001"


def test_entry_points():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 11


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, name):
    oracle = entry.oracle_sql()
    if name in oracle:
        rows, problem = differences(spark, SF_DIR, entry.queries()[name], oracle[name])
        assert problem is None
    else:
        rows = len(entry.queries()[name](spark, SF_DIR).collect())
    assert rows > 0


def test_one_document_covers_all_views(spark):
    """The views in one document, taken apart by table and column, against SQL."""
    database = {"name": "files", "version": "", "encoding": "UTF-8", "size_bytes": 0}
    (row,) = document.response_document(report_structs(spark, SF_DIR), database).collect()
    (schema,) = json.loads(row.document)["schemas"]
    got = {
        (t["name"], c["name"]): (t["row_count"], *(c["statistics"][k] for k in ("total_count", "null_count", "distinct_count")))
        for t in schema["tables"]
        for c in t["columns"]
    }
    con, want = oracle_connection(SF_DIR), {}
    for table, columns in COLUMNS.items():
        for name, (sql, _) in columns.items():
            n, nulls, distinct = con.execute(f"select count(*), count(*) - count(({sql})), count(distinct ({sql})) from {table}").fetchone()
            want[table, name] = (n, n, nulls, distinct)
    assert got == want


def test_statistics_read_all_columns_of_lineitem(spark):
    columns = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").columns
    assert [c for c in columns if not any(c in sql for sql in LINEITEM_GAPS.values())] == []
