"""Work that has to stay spread or to be done once, whatever the size of the tables."""

import glob

import pytest
from pyspark.sql import functions as F

from colsight.operators import filters, prompts
from colsight.plans.answering import AnswerLedger
from colsight.plans.column_profile import column_profile
from colsight.sources import records
from suite import catalogs, filtering, profiles, runs, writing
from suite.derived import DERIVED, derived, derived_frames

LINEITEM = """select id as l_orderkey, id * 7 % 50 as l_partkey, id * 3 % 11 as l_suppkey, n as l_linenumber, cast(n * 10 as double) as l_quantity, cast(id as double) as l_extendedprice,
    id % 9 / 100.0D as l_discount, n % 8 / 100.0D as l_tax, element_at(array('A', 'N', 'R'), cast(1 + (id + n) % 3 as int)) as l_returnflag,
    if(id % 2 = 0, 'O', 'F') as l_linestatus, timestamp_ntz '1995-01-01 00:00:00' as l_shipdate from (select id, explode(sequence(1, 3)) as n from range(1, 41))"""
ORDERS = """select id as o_orderkey, id % 10 as o_custkey, element_at(array('F', 'O', 'P'), cast(1 + id % 3 as int)) as o_orderstatus, cast(id * 100 as double) as o_totalprice,
    timestamp_ntz '1995-01-01 00:00:00' as o_orderdate, if(id % 2 = 0, '1-URGENT', '5-LOW') as o_orderpriority from range(1, 41)"""
CUSTOMER = "select id as c_custkey, concat('n', id) as c_name, cast(id % 5 as int) as c_nationkey, cast(id as double) as c_acctbal, 'M' as c_mktsegment from range(0, 10)"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    for name, sql in (("lineitem", LINEITEM), ("orders", ORDERS), ("customer", CUSTOMER)):
        spark.sql(sql).repartition(4).write.parquet(f"{folder}/{name}.parquet")
    documents = 'select id as doc_id, concat("a ", chr(10), id) as text, "en" as lang, "s" as source, 9L as n_chars from range(12000)'
    spark.sql(documents).repartition(4).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_a_batch_reads_its_own_prompts(spark, tmp_path, monkeypatch):
    read = []

    def ask(frame, model):
        read.append(set(frame.inputFiles()))
        return frame.withColumn("response", F.upper("prompt"))

    monkeypatch.setattr("colsight.plans.answering.sensitivity.ask", ask)
    questions = spark.range(40).selectExpr("id", "concat('q', id) as prompt")
    done = AnswerLedger(spark, str(tmp_path / "ledger"), None, batch_rows=10).ask(questions)
    assert {r.response for r in done.collect()} == {f"Q{i}" for i in range(40)}
    assert len(read) >= 4 and sum(map(len, read)) == len(set.union(*read))


def test_columns_without_foreign_key_stay_spread(spark):
    signals = spark.range(4000).selectExpr("'t' as table_name", "concat('c', id) as column_name", "if(id % 100 = 0, 's.u', null) as fk_referenced_table")
    counts = spark.sql("select 's' as schema_name, 'u' as table_name, 7L as row_count union all select null, null, 9L")
    kept = {name: spark.conf.get(name) for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = filters.with_referenced_rows(signals, counts, counts)
        most = found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        rows = {(r.fk_referenced_table, r.fk_referenced_rows): r["count"] for r in found.groupBy("fk_referenced_table", "fk_referenced_rows").count().collect()}
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert rows == {("s.u", 7): 40, (None, None): 3960} and most < 1500
    assert set(found.columns) == {"table_name", "column_name", "fk_referenced_table", "fk_referenced_rows"}


def test_large_files_are_written_by_several_tasks(spark, tables):
    path = profiles._large_files(spark, tables)
    assert len(glob.glob(f"{path}/*.csv")) == 4


def test_lines_do_not_meet_by_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a|b\n1|"x\ny"\n2|z\n')
    lines = records.stage_lines(spark, str(tmp_path / "a.csv"))
    files = lines.groupBy("file").agg(F.lit(True).alias("wrapped"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = records._split(lines, files, "wrapped")[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_parts_of_many_files(spark, tables, tmp_path, monkeypatch):
    folders = iter([str(tmp_path / "parts"), str(tmp_path / "ledger")])
    monkeypatch.setattr(runs, "shared_folder", lambda _: next(folders))
    read = {(r.first_read, r.second_read) for r in runs.prf_incremental(spark, tables).collect()}
    assert read == {(2, 1)}
    assert all(len(glob.glob(f"{tmp_path}/parts/part-{part}/*.parquet")) > 1 for part in range(3))


def test_numbered_lines_are_stored_once(spark, tables):
    names = ("columns", "key_usage", "statistics", "checks", "clauses", "tables")
    for name, frame in zip(names, derived_frames(spark, tables, *names), strict=True):
        plain = derived(spark, tables, name)
        assert frame.columns == plain.columns and frame.exceptAll(plain).isEmpty() and plain.exceptAll(frame).isEmpty()
        assert "o_orderpriority" not in plan_of(frame) or name == "tables"
        assert "Join" not in plan_of(frame)
    assert "Join" in plan_of(derived(spark, tables, "columns")) and set(names) < set(DERIVED)


@pytest.mark.parametrize("query", [filtering.fd_schema_signals, runs.prf_table_facts, catalogs.cat_indexes, catalogs.cat_check_values, catalogs.cat_column_comments])
def test_queries_take_the_stored_lines(spark, tables, query):
    assert "l_extendedprice" not in plan_of(query(spark, tables))


def test_verdicts_take_the_columns_once(spark, tables):
    for query in (writing.sn_parse, writing.sn_apply, writing.sn_rollup):
        assert "Window" not in plan_of(query(spark, tables))


@pytest.mark.parametrize("query", [writing.sn_parse, writing.sn_apply, writing.sn_rollup])
def test_entries_of_answers_are_not_broadcast(spark, tables, query):
    plan = query(spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert any("SortMergeJoin" in line and "batch" in line for line in plan.splitlines())


def test_the_spreading_key_stays_a_key(spark):
    signals = spark.range(4000).selectExpr("'t' as table_name", "concat('c', id) as column_name", "if(id % 100 = 0, 's.u', null) as fk_referenced_table")
    counts = spark.range(1).selectExpr("'s' as schema_name", "'u' as table_name", "7L as row_count")
    kept = {name: spark.conf.get(name) for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = filters.with_referenced_rows(signals, counts, counts)
        most = found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert found.where("fk_referenced_rows = 7").count() == 40 and found.count() == 4000 and most < 1500
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)


def test_only_foreign_keys_meet_the_row_counts(spark, tables):
    joins = [line for line in plan_of(filtering.fd_schema_score(spark, tables)).splitlines() if "Join" in line]
    assert sum("_target" in line for line in joins) == 2 and "_target" not in joins[0]


def test_a_few_questions_shuffle_no_answers(spark, tmp_path):
    ledger = AnswerLedger(spark, str(tmp_path / "ledger"), lambda prompts: "re: " + prompts)
    ledger.ask(spark.range(50).selectExpr("concat('q', id) as prompt"))
    few = ledger.ask(spark.sql("select 1L as id, 'q3' as prompt union all select 2L, 'new'"))
    assert "LeftSemi" in plan_of(few)
    assert {r.id: r.response for r in few.collect()} == {1: "re: q3", 2: "re: new"}


def test_small_files_for_fields_with_line_breaks(spark, tables):
    spark.read.parquet(f"{tables}/documents.parquet").coalesce(1).write.parquet(f"{tables}/one/documents.parquet")
    assert len(profiles.src_csv(spark, f"{tables}/one").inputFiles()) == 3


def test_leading_columns_are_ranked_once(spark, tables):
    columns = writing.wide_columns(spark, tables)
    found = prompts.kpi_prompts(writing._domains(spark, tables), writing.wide_tables(spark, tables), columns.drop("o_custkey"), 5)
    assert plan_of(found).count("WindowGroupLimit") == 2  # of columns, and of the tables of a domain


def test_numbers_are_counted_once(spark, tables):
    lines = spark.read.parquet(f"{tables}/lineitem.parquet").select("l_orderkey", "l_tax")
    plan = plan_of(column_profile({"lineitem": lines}))
    assert "Generate stack" not in plan


def test_a_column_line_is_compiled(spark, tables):
    assert "lambda" not in plan_of(writing.aug_column_summary(spark, tables))
    rows = [
        (["a", None, "b", "c"], ["x", None, "y"]), ([None, None, None, "d"], []), ([""], [""]), ([None, ""], [None]), ([], None), (None, list("abcdefgh")),
    ]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, sample_values array<string>, enum_values array<string>")
    frame = frame.selectExpr("*", "'c' as column_name", "'t' as data_type", "id = 0 as is_primary_key", "id <> 1 as is_nullable", "if(id = 2, 'about', '') as description")
    found = [r.line for r in frame.orderBy("id").select(prompts.column_line().alias("line")).collect()]
    assert found == [
        "  - c (t) [PK] enum: [x, y] samples: [a, b]", "  - c (t) [NOT NULL]", "  - c (t) enum: [] samples: [] pg_desc: about",
        "  - c (t) enum: [] samples: []", "  - c (t)", "  - c (t) enum: [a, b, c, d, e, f]",
    ]
