"""The stored run history, the ledger of answers and catalogs from Spark and from exports."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from colsight.functions.rows import constant_rows
from colsight.operators import history, sensitivity
from colsight.plans.answering import AnswerLedger, text_stage
from colsight.sources import provider
from colsight.sources.runstore import RunStore, VersionConflict
from colsight.sources.staging import columnar

def now():
    return F.expr("timestamp_ntz '2020-01-02 00:00:00'")



@pytest.fixture
def store(spark, tmp_path):
    runs = spark.range(200).selectExpr(
        "id", "case id % 4 when 0 then 'completed' when 1 then 'pending' when 2 then 'failed' else 'profiling' end as status",
        "timestamp_ntz '2020-01-01 00:00:00' - make_dt_interval(cast(id % 3 as int)) as created_at", "cast(null as string) as error_code",
        "cast(null as string) as error_message", "cast(null as timestamp_ntz) as completed_at",
    )
    return RunStore.create(spark, str(tmp_path / "store"), runs, buckets=8)


def rows(frame):
    return sorted(map(str, frame.collect()))


def test_changes_equal_their_projections(spark, store):
    want = columnar(store.read())
    changes = spark.sql("select * from values (3L, 'cancelled', 'X'), (3L, null, 'Y'), (500L, 'pending', null) v(id, status, error_code)")
    assert store.upsert(changes) == 1
    added = spark.sql("select 500L as id")
    want = columnar(history.update(history.insert(want, added), changes, "id"))
    assert rows(store.read()) == rows(want)
    ids = spark.range(0, 200, 7)
    assert store.delete(ids) == 2
    want = columnar(history.delete(want, ids, "id"))
    assert rows(store.read()) == rows(want)
    assert store.retain(24, now()) == 3
    want = columnar(history.retained(want, 24, now()))
    assert rows(store.read()) == rows(want)
    assert store.mark_interrupted(now()) == 4
    assert rows(store.read()) == rows(history.mark_interrupted(want, now()))
    assert store.mark_interrupted(now()) == 4 and store.delete(spark.range(0)) == 4  # nothing to change, no new version


def test_readers_see_whole_versions(spark, store):
    before, first = rows(store.read()), store.files()
    store.delete(spark.sql("select 5L as id"))
    changed = {bucket for bucket, path in store.files().items() if first[bucket] != path}
    assert len(changed) == 1 and len(first) == 8  # one bucket is written anew, the files of the others stay
    assert rows(store.read(0)) == before and store.read().count() == 199
    store.delete(spark.range(200))
    assert store.read().count() == 0 and store.files() == {} and store.read().columns == store.read(0).columns


def test_an_unfinished_change_is_not_seen(spark, store, tmp_path, monkeypatch):
    before = rows(store.read())
    with monkeypatch.context() as patch:
        patch.setattr("colsight.sources.runstore.constant_rows", lambda *_: 1 / 0)  # the writer dies before its manifest
        with pytest.raises(ZeroDivisionError):
            store.delete(spark.range(50))
    assert rows(store.read()) == before and store.delete(spark.range(50)) == 1
    with pytest.raises(VersionConflict):
        store._commit(1, store._manifest(0), store.read(0), "id")
    with pytest.raises(FileNotFoundError):
        RunStore(spark, str(tmp_path / "nothing")).read()


def counting(path):
    """A model that notes what it is asked, and fails where the prompt says so."""

    def model(prompts):
        with open(path, "a") as log:
            log.writelines(f"{p}\n" for p in prompts)
        if any("break" in p for p in prompts):
            raise RuntimeError("no answer")
        return prompts.map(lambda p: f"re: {p}")

    return model


def test_nothing_is_asked_twice(spark, tmp_path):
    log = str(tmp_path / "asked")
    ledger = AnswerLedger(spark, str(tmp_path / "ledger"), counting(log), batch_rows=5)
    questions = spark.range(23).selectExpr("id", "concat('question ', id % 20) as prompt").unionAll(spark.sql("select 99L, cast(null as string)"))
    first = {r.id: r.response for r in ledger.ask(questions).collect()}
    assert first == {i: f"re: question {i % 20}" for i in range(23)} | {99: None}
    more = questions.unionAll(spark.sql("select 100L, 'one more'"))
    assert {r.id: r.response for r in ledger.ask(more).collect()} == first | {100: "re: one more"}
    assert sorted(open(log).read().split("\n")[:-1]) == sorted([*[f"question {i}" for i in range(20)], "one more"])


def test_an_interrupted_run_goes_on(spark, tmp_path):
    """A run that dies after two batches: the next one asks only what is left. A failing batch keeps its defaults and is asked again."""
    log, folder = str(tmp_path / "asked"), str(tmp_path / "ledger")
    questions = spark.range(40).selectExpr("id", "concat('q', id) as prompt")
    ledger = AnswerLedger(spark, folder, counting(log), batch_rows=10)
    class Stop(Exception):
        pass

    ask, made = sensitivity.ask, []

    def limited(frame, model):
        made.append(1)
        if len(made) > 2:
            raise Stop
        return ask(frame, model)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("colsight.plans.answering.sensitivity.ask", limited)
        with pytest.raises(Stop):
            ledger.ask(questions)
    asked = open(log).read().split()
    assert 0 < len(asked) < 40
    done = AnswerLedger(spark, folder, counting(log), batch_rows=10).ask(questions)
    assert all(r.response == f"re: {r.prompt}" for r in done.collect())
    again = open(log).read().split()
    assert sorted(again) == sorted(f"q{i}" for i in range(40))
    broken = spark.sql("select 1L as id, 'break' as prompt union all select 2L, 'q3'")
    assert {r.id: r.response for r in ledger.ask(broken).collect()} == {1: None, 2: "re: q3"}
    assert [r.prompt for r in ledger.pending(broken).collect()] == ["break"]


def test_text_stage(spark, tmp_path):
    def model(prompts: pd.Series) -> pd.Series:
        def reply(p):
            if p.startswith("Write one to three"):
                return "about " + re.search(r"Table: (\S+)", p)[1]
            if p.startswith("Name up to"):
                return '{"terms": [{"business_term": "T", "description": "d"}]}'
            if p.startswith("Sort these"):
                return '{"domains": [{"domain": "D", "tables": ["t", "u", "ghost"]}]}'
            if p.startswith("Propose"):
                return '{"kpis": [{"name": "K", "description": "d", "calculation": "c", "linked_columns": ["t.id", "t.nothing"]}]}'
            if p.startswith("Decide"):
                return '{"columns": [{"column_name": "mail", "is_sensitive": true, "sensitivity_type": "email"}]}'
            raise RuntimeError("columns are not described")

        return prompts.map(reply)

    tables = spark.sql("select * from values ('t', 's', 'old', 5L), ('u', 's', null, null) v(table_name, schema_name, table_description, row_count)")
    kinds = "table_name string, ordinal int, column_name string, data_type string, is_primary_key boolean, is_nullable boolean, description string"
    columns = constant_rows(spark, [("t", 1, "id", "int", True, False, "the id"), ("t", 2, "mail", "string", False, True, None), ("u", 1, "x", "int", False, True, None)], kinds)
    columns = columns.withColumns({"enum_values": F.array().cast("array<string>"), "sample_values": F.array().cast("array<string>")})
    done = text_stage(AnswerLedger(spark, str(tmp_path / "l"), model), tables, columns)
    assert {r.table_name: (r.table_description, r.glossary[0].business_term) for r in done.tables.collect()} == {"t": ("about t", "T"), "u": ("about u", "T")}
    assert {(r.table_name, r.column_name): (r.description, r.sensitivity_type) for r in done.columns.collect()} == {("t", "id"): ("the id", None), ("t", "mail"): (None, "email"), ("u", "x"): (None, None)}
    assert [(r.domain, r.name, r.linked_columns) for r in done.kpis.collect()] == [("s / D", "K", ["t.id"])] and done.filters is None


def test_columns_are_described_last(spark, tmp_path):
    log = str(tmp_path / "asked")
    tables = spark.sql("select 't' as table_name, 's' as schema_name, 'old' as table_description, 5L as row_count")
    columns = spark.sql("select 't' as table_name, 1 as ordinal, 'id' as column_name, 'int' as data_type, true as is_primary_key, false as is_nullable, '' as description")
    columns = columns.withColumns({"enum_values": F.array().cast("array<string>"), "sample_values": F.array().cast("array<string>")})
    done = text_stage(AnswerLedger(spark, str(tmp_path / "l"), counting(log)), tables, columns)
    openings = [line[:13] for line in open(log).read().split("\n") if line.startswith(("Write", "Decide", "Name up", "Sort these"))]
    assert openings == ["Write one to ", "Decide for ev", "Name up to 5 ", "Sort these ta", "Write one or "]
    assert done.columns.count() == 1


def test_spark_catalog(spark, tmp_path):
    spark.sql(f"create database shop location '{tmp_path}'")
    try:
        spark.sql("create table shop.typed (a varchar(20) not null comment 'named', b decimal(10,2) default 3, c array<int>) using parquet comment 'a table'")
        spark.range(7).write.saveAsTable("shop.numbers")
        spark.sql("analyze table shop.numbers compute statistics")
        spark.sql("create view shop.few as select id from shop.numbers where id < 3")
        found = {name: [r.asDict() for r in frame.collect()] for name, frame in provider.spark_catalog(spark, ["shop"]).items()}
    finally:
        spark.sql("drop database shop cascade")
    tables = {r["table_name"]: r for r in found["tables"]}
    assert {n: (r["table_type"], r["row_estimate"], r["description"]) for n, r in tables.items()} == {
        "typed": ("BASE TABLE", None, "a table"), "numbers": ("BASE TABLE", 7, None), "few": ("VIEW", None, None),
    }
    columns = {(r["table_name"], r["column_name"]): r for r in found["columns"]}
    assert (columns["typed", "a"]["description"], columns["typed", "b"]["data_type"], columns["typed", "b"]["column_default"]) == ("named", "decimal(10,2)", "3")
    assert (columns["typed", "b"]["numeric_precision"], columns["typed", "c"]["ordinal_position"]) == (10, 3)
    assert [r["definition"] for r in found["views"]] == ["select id from shop.numbers where id < 3"]
    assert [r["schema_name"] for r in found["schemata"]] == ["shop"]


def test_export_folder(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "tables.parquet"))
    (tmp_path / "views.csv").write_text("a,b\n1,2\n")
    (tmp_path / "notes.txt").write_text("no frame")
    found = provider.export_folder(spark, str(tmp_path))
    assert sorted(found) == ["tables", "views"] and found["views"].first().b == 2
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        provider.export_folder(spark, str(tmp_path / "empty"))
