"""Runs over several schemas, their deadline and facts; profiles kept up to date file by file."""

import os
import time

import pytest
from pyspark.sql import functions as F

from colsight.config import ProfileConfig
from colsight.functions.rows import constant_rows
from colsight.plans import document
from colsight.plans.column_profile import column_profile
from colsight.plans.incremental import ProfileLedger
from colsight.plans.report import CatalogFrames, run_report
from colsight.plans.run import Admission, Planned, jobs_of, profile_run, table_facts, union_readers

PLAIN = ProfileConfig(include_sample_data=False)


def asleep(frame):
    """A frame that takes ten minutes to read."""

    def wait(batches):
        time.sleep(600)
        yield from batches

    return frame.mapInArrow(wait, frame.schema)


def rows_of(run):
    return {(r.schema_name, r.table_name, r.column_name): r for r in run.collect()}


def test_lists_choose_tables():
    config = ProfileConfig(include_schemas=("a", "information_schema"), include_tables=("t", "u"), exclude_tables=("u",))
    assert [config.selects(*n) for n in (("a", "t"), ("a", "u"), ("a", "v"), ("b", "t"), ("information_schema", "t"))] == [True, False, False, False, False]
    assert ProfileConfig().selects("any", "table") and not ProfileConfig().selects("pg_catalog", "t")
    assert ProfileConfig(exclude_schemas=()).selects("pg_catalog", "t")
    with pytest.raises(ValueError, match="timeout"):
        ProfileConfig(timeout_seconds=0)


def test_equal_names_in_two_schemas(spark):
    readers = union_readers(("a", {"t": spark.range(3)}), ("b", {"t": spark.range(5), "u": spark.range(1)}), ("pg_catalog", {"t": spark.range(9)}))
    for columns_per_job in (1, 200):
        got = rows_of(profile_run(spark, readers, ProfileConfig(columns_per_job=columns_per_job)))
        assert {k: (r.total_count, r.failed, sorted(r.sample_values)) for k, r in got.items()} == {
            ("a", "t", "id"): (3, False, ["0", "1", "2"]),
            ("b", "t", "id"): (5, False, ["0", "1", "2", "3", "4"]),
            ("b", "u", "id"): (1, False, ["0"]),
        }
    assert profile_run(spark, readers, ProfileConfig(include_schemas=())).collect() == []


def test_failures_lose_only_their_table(spark):
    broken = spark.range(3).selectExpr("id", "raise_error('boom') as x")
    readers = union_readers(("s", {"good": spark.range(4), "broken": broken})) | {("s", "absent"): lambda: spark.read.parquet("/no/such/file")}
    got = rows_of(profile_run(spark, readers, PLAIN))
    assert {k: (r.total_count, r.failed) for k, r in got.items()} == {
        ("s", "good", "id"): (4, False),
        ("s", "broken", "id"): (None, True),
        ("s", "broken", "x"): (None, True),
        ("s", "absent", None): (None, True),
    }
    assert "boom" in got["s", "broken", "x"].reason


def test_a_table_over_its_limit_is_cancelled(spark):
    readers = union_readers(("s", {"fast": spark.range(4), "slow": asleep(spark.range(0, 4, 1, 1))}))
    start = time.monotonic()
    got = rows_of(profile_run(spark, readers, PLAIN, {("s", "slow"): 2.0}))
    assert time.monotonic() - start < 60
    assert got["s", "fast", "id"].total_count == 4 and got["s", "slow", "id"].reason == "deadline"


def test_a_run_ends_at_its_deadline(spark):
    """What had been finished is kept; running and waiting tables are listed."""
    slow = {f"slow{i}": asleep(spark.range(0, 4, 1, 1)) for i in range(3)}
    fast = spark.range(4)
    readers = {("s", "fast"): lambda: fast} | union_readers(("s", slow))
    config = ProfileConfig(include_sample_data=False, max_concurrent_tables=2, columns_per_job=1, timeout_seconds=20)
    start = time.monotonic()
    got = rows_of(profile_run(spark, readers, config))
    assert time.monotonic() - start < 60
    assert got["s", "fast", "id"].total_count == 4
    assert all(got["s", f"slow{i}", "id"].reason == "deadline" for i in range(3))
    assert spark.range(3).count() == 3  # the session goes on


def test_jobs_are_bounded(spark):
    frame = spark.range(1).selectExpr("id as a", "id as b")
    tables = [Planned(("s", str(i)), frame, size) for i, size in enumerate((5, 50, 7, 1000, 6, 8))]
    config = ProfileConfig(columns_per_job=4, bytes_per_job=100)
    jobs = list(jobs_of(tables, config, {("s", "2"): 9.0}))
    assert sorted([[t.name[1] for t in j.tables] for j in jobs]) == [["0", "4"], ["2"], ["3"], ["5", "1"]]
    assert [j.limit for j in jobs if j.tables[0].name[1] == "2"] == [9.0]


def test_admission():
    gate = Admission(10)
    assert gate.enter(8, lambda: False) and not gate.enter(3, lambda: True)
    gate.leave(8)
    assert gate.enter(50, lambda: True)  # too large for the limit, but alone


def test_facts(spark):
    run = spark.sql("select * from values ('a', 't', 'x', 5L), ('a', 't', 'y', 5L), ('b', 't', 'x', null) v(schema_name, table_name, column_name, total_count)")
    tables = spark.sql("select * from values ('a', 't', 'me', 'about', 7L, 9L), ('c', 't', 'you', null, 1L, 1L) v(table_schema, table_name, owner, description, size_bytes, total_size_bytes)")
    indexes = spark.sql("select 'a' as table_schema, 't' as table_name, 'i' as index_name, array('x') as columns, true as is_unique, false as is_primary, 'btree' as index_type")
    fresh = spark.sql("select 'a' as table_schema, 't' as table_name, timestamp_ntz '2020-01-01 00:00:00' as last_analyze, null as last_autoanalyze, null as last_vacuum, null as last_autovacuum")
    facts = {r.schema_name: r for r in table_facts(run, ProfileConfig(), tables, None, indexes, None, fresh).collect()}
    assert (facts["a"].row_count, facts["a"].owner, facts["a"].total_size_bytes, facts["a"].indexes[0].index_name) == (5, "me", 9, "i")
    assert facts["b"].indexes == [] and facts["b"].owner is None and facts["b"].data_freshness is None and set(facts) == {"a", "b"}
    off = ProfileConfig(include_row_counts=False, include_indexes=False, include_data_freshness=False)
    assert set(table_facts(run, off, tables, None, indexes, None, fresh).columns) == {"schema_name", "table_name", "owner", "description", "size_bytes", "total_size_bytes"}


def test_report_of_two_schemas(spark):
    key = "schema_name string, table_name string, "
    keys = constant_rows(spark, [("a", "t", "id", True)], key + "column_name string, is_primary_key boolean").withColumn("enum_values", F.lit(None).cast("array<string>"))
    links = constant_rows(spark, [("b", "t", "fk", "ref", "a", "t")], key + "constraint_name string, from_column string, to_schema string, to_table string")
    index = constant_rows(spark, [], key + "index_name string, columns array<string>, is_unique boolean, is_primary boolean")
    readers = union_readers(("a", {"t": spark.range(20)}), ("b", {"t": spark.range(3000).selectExpr("id", "id % 4 as ref", "concat(id, '@x.org') as contact")}))
    got = {r.schema_name: r.table for r in run_report(spark, readers, CatalogFrames(keys, links, index)).collect()}
    assert (got["a"].row_count, got["b"].row_count) == (20, 3000)
    marked = {s: {c.name: (c.is_primary_key, c.sensitivity_type) for c in t.columns} for s, t in got.items()}
    assert marked == {"a": {"id": (True, None)}, "b": {"id": (False, None), "ref": (False, None), "contact": (False, "email")}}
    assert [f.column_name for f in got["b"].filter_columns] == ["ref"]
    structs = run_report(spark, readers, CatalogFrames(keys, links, index), ProfileConfig(include_column_stats=False, include_sample_data=False), look_at_values=False)
    assert sorted(len(t.columns) for (t,) in structs.select("table").collect()) == [1, 3]
    assert document.response_document(structs, {"name": "db"}).count() == 1


def write(spark, path, low, high, extra="id % 7 as k"):
    df = spark.range(low, high).selectExpr("id", "if(id % 5 = 0, null, cast(id as string)) as s", "id / 3 as d", "id % 2 = 0 as b", "date_add(date '2020-01-01', cast(id % 40 as int)) as day", extra)
    df.coalesce(1).write.mode("append").parquet(path)


EXACT = ("total_count", "non_null_count", "null_percentage", "min", "max", "zero_count", "negative_count", "min_length", "max_length", "empty_count", "true_count", "false_count", "true_percentage", "min_text", "max_text")


def compare(spark, ledger, path):
    got = {r.column_name: r for r in ledger.profile(path).collect()}
    want = {r.column_name: r for r in column_profile({"t": spark.read.option("mergeSchema", True).parquet(path)}).collect()}
    assert got.keys() == want.keys()
    for name, row in want.items():
        assert [got[name][f] for f in EXACT] == [row[f] for f in EXACT], name
        for f in ("mean", "stddev", "variance", "sum", "avg_length"):
            assert got[name][f] == (None if row[f] is None else pytest.approx(row[f], rel=1e-9)), (name, f)
        assert abs(got[name].distinct_count - row.distinct_count) <= max(1, 0.04 * row.distinct_count)
        if row.p5 is not None:
            assert all(abs(got[name][p] - row[p]) <= 0.03 * (row.max - row.min) for p in ("p5", "p25", "median", "p75", "p95"))


def test_profile_after_a_file_is_added(spark, tmp_path):
    path, ledger = str(tmp_path / "t"), ProfileLedger(spark, str(tmp_path / "ledger"))
    write(spark, path, 0, 1000)
    write(spark, path, 1000, 3500)
    assert ledger.update(path) == 2
    compare(spark, ledger, path)
    write(spark, path, -200, 100)
    with pytest.raises(ValueError, match="update"):
        ledger.profile(path)
    assert ledger.update(path) == 1 and ledger.update(path) == 0
    compare(spark, ledger, path)


def test_old_files_stay_unread(spark, tmp_path):
    """Files whose bytes are destroyed, with the same size and time, do not hinder a second run."""
    path, ledger = tmp_path / "t", ProfileLedger(spark, str(tmp_path / "ledger"))
    write(spark, str(path), 0, 500)
    ledger.update(str(path))
    for file in path.glob("*.parquet"):
        stat = file.stat()
        file.write_bytes(b"x" * stat.st_size)
        os.utime(file, ns=(stat.st_atime_ns, stat.st_mtime_ns))
        (path / f".{file.name}.crc").unlink()
    write(spark, str(path), 500, 800)
    assert ledger.update(str(path)) == 1
    assert {r.total_count for r in ledger.profile(str(path)).collect()} == {800}


def test_changed_and_lost_files(spark, tmp_path):
    path, ledger = tmp_path / "t", ProfileLedger(spark, str(tmp_path / "ledger"))
    for low in (0, 100, 200):
        write(spark, str(path / str(low)), low, low + 100)
    assert ledger.update(str(path), files_per_job=2) == 3
    for file in (path / "0").iterdir():
        file.unlink()
    for file in (path / "100").iterdir():
        file.unlink()
    write(spark, str(path / "100"), 5000, 5050, "id as new_column")
    assert ledger.update(str(path)) == 1
    got = {r.column_name: r for r in ledger.profile(str(path)).collect()}
    assert got["id"].total_count == got["new_column"].total_count == 150 and got["new_column"].null_count == 100
    assert (got["id"].min, got["id"].max) == (200, 5049)


def test_files_without_rows(spark, tmp_path):
    path, ledger = str(tmp_path / "t"), ProfileLedger(spark, str(tmp_path / "ledger"))
    write(spark, path, 0, 0)
    assert ledger.update(path) == 1
    assert {(r.total_count, r.non_null_count, r.distinct_count) for r in ledger.profile(path).collect()} == {(0, 0, 0)}
    write(spark, path, 0, 1000)
    write(spark, path, 0, 0)
    assert ledger.update(path) == 2 and ledger.update(path) == 0
    compare(spark, ledger, path)


def test_an_unfinished_batch_counts_for_nothing(spark, tmp_path):
    path, ledger = str(tmp_path / "t"), ProfileLedger(spark, str(tmp_path / "ledger"))
    write(spark, path, 0, 50)
    ledger.update(path)
    states = spark.read.parquet(f"{ledger.folder}/states").withColumn("batch", F.lit("never finished"))
    states.write.mode("append").parquet(f"{ledger.folder}/states")
    assert {r.total_count for r in ledger.profile(path).collect()} == {50}
