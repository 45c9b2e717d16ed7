"""Reading files, naming tables, sampling, sinks and isolation."""

import json

import pytest
from pyspark.sql import functions as F

from colsight.config import ProfileConfig
from colsight.operators import sampling
from colsight.plans import document
from colsight.plans.column_profile import column_profile
from colsight.functions.rows import constant_rows
from colsight.plans.dataset import file_profile, isolated_profile, table_profile, write_each
from colsight.plans.report import table_report
from colsight.sources import jdbc, readers, sinks
from colsight.sources.readers import FileSource
from colsight.sources.staging import columnar, shared_folder

NAMES = {
    "data/orders.csv": "orders", "data.csv.gz": "data_csv", "my-orders.csv": "my_orders", "---.csv": "s3_file",
    "a/b/EVENTS.PARQUET": "EVENTS", "logs.json.zst": "logs_json", "folder/": "folder",
}


def test_table_names_in_both_forms(spark):
    assert {p: readers.table_name(FileSource(p)) for p in NAMES} == NAMES
    df = spark.createDataFrame([(p,) for p in NAMES], "p string")
    assert {r.p: r.n for r in df.select("p", readers.table_name_of(F.col("p")).alias("n")).collect()} == NAMES
    assert readers.table_name(FileSource("x.csv", name="given")) == "given"


def test_formats():
    paths = {"a.parquet": "parquet", "a.parq": "parquet", "a.JSONL": "json", "a.ndjson": "json", "a.csv": "csv", "a.json.gz": "csv", "a": "csv"}
    assert {p: readers.file_format(FileSource(p)) for p in paths} == paths
    assert readers.file_format(FileSource("a.csv", file_format="json")) == "json"


@pytest.mark.parametrize("separator", [",", ";", "\t", "|"])
def test_separator_is_found(spark, tmp_path, separator):
    path = tmp_path / "t.csv"
    path.write_text("\n".join(separator.join(row) for row in (["a", "b", "c"], ["1", "x, y" if separator != "," else "x", "2.5"], ["2", "z", "3"])))
    df = readers.read(spark, FileSource(str(path)))
    assert df.columns == ["a", "b", "c"] and df.agg(F.sum("a")).first()[0] == 3


def test_csv_without_header_and_with_schema(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("1,x\n2,y\n")
    assert readers.read(spark, FileSource(str(path), has_header=False)).count() == 2
    typed = readers.read(spark, FileSource(str(path), has_header=False, schema="n bigint, s string", delimiter=","))
    assert [f.dataType.simpleString() for f in typed.schema] == ["bigint", "string"]


def test_json_lines_and_arrays(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "array.json").write_text("\n  " + json.dumps(rows, indent=2))
    for name in ("lines.json", "array.json"):
        assert {(r.a, r.b) for r in readers.read(spark, FileSource(str(tmp_path / name))).collect()} == {(1, "x"), (2, None)}


def test_json_lines_and_arrays_in_one_glob(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    (tmp_path / "b.json").write_text('\n[\n {"a": 4},\n {"a": 5}\n]')
    (tmp_path / "c.json").write_text('[{"a": 6},\n{"a": 7}]')
    got = readers.read(spark, FileSource(f"{tmp_path}/*.json"))
    assert got.columns == ["a"] and sorted(r.a for r in got.collect()) == [1, 2, 3, 4, 5, 6, 7]
    (tmp_path / "d.json").write_text('{"a": 8}\n{"a": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read(spark, FileSource(f"{tmp_path}/d.json")).collect()


def test_csv_quotes(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id,t\n1,"two\nlines, one; field"\n2,"He said ""hi"", bye"\n3,plain\n')
    got = {(r.id, r.t) for r in readers.read(spark, FileSource(str(tmp_path / "q.csv"))).collect()}
    assert got == {(1, "two\nlines, one; field"), (2, 'He said "hi", bye'), (3, "plain")}
    (tmp_path / "s.csv").write_text('a;b\n"1,2";"x,y,z"\n"3,4";"u,v"\n')
    assert readers.read(spark, FileSource(str(tmp_path / "s.csv"))).columns == ["a", "b"]
    (tmp_path / "u").mkdir()
    for name, text in (("1.csv", "a,b\n1,2\n"), ("2.csv", "a;b\n1;2\n")):
        (tmp_path / "u" / name).write_text(text)
    with pytest.raises(ValueError, match="separator"):
        readers.read(spark, FileSource(str(tmp_path / "u")))


def test_folders_after_two_stars(spark, tmp_path):
    for part, text in (("x/in", "a;b\n1;2\n"), ("y/z/in", "a;b\n3;4\n"), ("y/out", "a;b\n5;6\n")):
        (tmp_path / part).mkdir(parents=True)
        (tmp_path / part / "t.csv").write_text(text)
    got = readers.read(spark, FileSource(f"{tmp_path}/**/in/*.csv"))
    assert got.columns == ["a", "b"] and sorted(r.a for r in got.collect()) == [1, 3]


def test_any_number_of_paths(spark, tmp_path):
    (tmp_path / "t.csv").write_text("n\n1\n")
    assert len(readers.read_all(spark, [FileSource(str(tmp_path / "t.csv"))] * 60)) == 60


def test_globs(spark, tmp_path):
    for part in ("x/1", "x/2", "y/1"):
        spark.range(5).write.parquet(str(tmp_path / part / "a.parquet"))
    assert readers.read(spark, FileSource(f"{tmp_path}/x/*/a.parquet")).count() == 10
    assert readers.read(spark, FileSource(f"{tmp_path}/**/*.parquet")).count() == 15


def test_unreadable_paths_are_skipped(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a,b\n1,2\n")
    sources = [FileSource(str(tmp_path / "good.csv")), FileSource(str(tmp_path / "missing.parquet"))]
    profile = file_profile(spark, sources)
    assert {(r.table_name, r.column_name, r.max) for r in profile.collect()} == {("good", "a", 1.0), ("good", "b", 2.0)}
    with pytest.raises(RuntimeError):
        readers.read_all(spark, sources[1:])
    with pytest.raises(ValueError):
        readers.read_all(spark, [])


def test_copies_go_to_the_folder_of_the_session(spark):
    folder = shared_folder(spark)
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir")) and folder != shared_folder(spark)
    copied = columnar(spark.range(5).toDF("n"))
    assert copied.count() == 5 and spark.conf.get("spark.checkpoint.dir") in copied.inputFiles()[0]


def test_equal_names_do_not_collide(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "t.csv").write_text("n\n1\n")
    sources = [FileSource(str(tmp_path / f / "t.csv")) for f in ("a", "b")]
    assert list(readers.read_all(spark, sources)) == ["t", "t_2"]


def test_one_failing_table_keeps_the_others(spark, tmp_path):
    good = spark.range(3)
    profile = isolated_profile({"good": lambda: good, "bad": lambda: good.select("nothing")})
    assert {(r.table_name, r.total_count, r.failed) for r in profile.collect()} == {("good", 3, False), ("bad", None, True)}
    broken = good.selectExpr("raise_error('boom') as x")
    read = isolated_profile({"good": lambda: good, "bad": lambda: broken})
    assert {(r.table_name, r.column_name, r.total_count, r.failed) for r in read.collect()} == {("good", "id", 3, False), ("bad", "x", None, True)}
    errors = write_each({"good": lambda: good, "bad": lambda: broken}, str(tmp_path / "out"), ProfileConfig(max_concurrent_tables=2))
    assert list(errors) == ["bad"]
    assert spark.read.parquet(str(tmp_path / "out" / "good")).count() == 1


def test_samples(spark, tmp_path):
    spark.range(1000).selectExpr("id", "if(id % 2 = 0, null, cast(id as string)) as s").repartition(4).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert sampling.has_row_positions(df) and not sampling.has_row_positions(spark.range(3))
    for rows in (sampling.random_rows(df, 20, 1), sampling.random_file_rows(df, 20, 1), sampling.draw(spark.range(50), 20, 1)):
        ids = [r.id for r in rows.collect()]
        assert len(ids) == len(set(ids)) == 20
    values = {r.column_name: r.sample_values for r in sampling.column_values(df, 30, 7).collect()}
    assert len(values["id"]) == len(values["s"]) == 30
    assert all(s == (None if int(i) % 2 == 0 else i) for i, s in zip(values["id"], values["s"], strict=True))


def test_samples_of_rows_that_are_not_file_rows(spark, tmp_path):
    spark.range(40).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    exploded = df.selectExpr("id", "explode(array(1, 2, 3)) AS n")
    assert sampling.has_row_positions(df.where("id > 3").select("id")) and not sampling.has_row_positions(exploded)
    rows = sampling.draw(exploded, 10, 1).collect()
    assert len(rows) == len({(r.id, r.n) for r in rows}) == 10


def test_sample_of_a_small_table_is_the_table(spark):
    assert sampling.random_rows(spark.range(3), 10, 1).count() == 3


def test_json_safe_values(spark):
    df = spark.sql(
        "select 1.50BD as dec, date '2020-01-02' as day, timestamp_ntz '2020-01-02 03:04:05' as ts, timestamp_ntz '2020-01-02 03:04:05.000120' as fine,"
        " X'0AFF' as bin, array(1, null) as arr, named_struct('a', 1) as st, true as b"
    )
    assert sampling.json_safe_rows(df).first().asDict() == {
        "dec": "1.5", "day": "2020-01-02", "ts": "2020-01-02T03:04:05", "fine": "2020-01-02T03:04:05.000120", "bin": "0aff",
        "arr": "[1,null]", "st": '{"a":1}', "b": "true",
    }


def test_parts_that_are_switched_off_are_null(spark):
    df = spark.range(4).toDF("n")
    bare = table_profile({"t": df}, ProfileConfig(include_column_stats=False, include_sample_data=False)).first()
    assert bare.sample_values is None and "total_count" not in bare
    full = table_profile({"t": df}).first()
    assert sorted(full.sample_values) == ["0", "1", "2", "3"] and full.total_count == 4


def test_document_keeps_null_and_empty_apart(spark, tmp_path):
    profile = column_profile({"t": spark.range(2).toDF("n")})
    parts = spark.sql("select 't' as table_name, 'me' as owner, array() as indexes, 2L as row_count")
    structs = document.table_structs(profile, parts, schema_name="main")
    doc = json.loads(document.table_documents(structs).first().document)
    assert doc["indexes"] == [] and doc["relationships"] is None and doc["owner"] == "me"
    assert doc["columns"][0]["statistics"]["numeric"]["max"] == 1.0
    assert doc["columns"][0]["statistics"]["string"] is None
    response = json.loads(document.response_document(structs, {"name": "db", "version": "1", "encoding": "UTF-8", "size_bytes": 7}).first().document)
    assert response["database"]["size_bytes"] == 7 and response["kpis"] is None
    assert response["schemas"][0]["owner"] == "me" and response["schemas"][0]["tables"][0]["name"] == "t"
    sinks.write_documents(document.table_documents(structs), str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).first().name == "t"


def test_report(spark):
    df = spark.range(100).selectExpr("id", "id % 3 as order_status", "concat('u', id, '@example.com') as contact")
    none = "table_name string, constraint_name string, from_column string, to_schema string, to_table string"
    keys = constant_rows(spark, [("t", "id", True)], "table_name string, column_name string, is_primary_key boolean")
    keys = keys.withColumn("enum_values", F.lit(None).cast("array<string>"))
    index = "table_name string, index_name string, columns array<string>, is_unique boolean, is_primary boolean"
    report = table_report({"t": df}, keys, constant_rows(spark, [], none), constant_rows(spark, [], index))
    doc = json.loads(document.table_documents(report).first().document)
    columns = {c["name"]: c for c in doc["columns"]}
    assert doc["table_role"] == "unknown" and doc["row_count"] == 100
    assert [f["column_name"] for f in doc["filter_columns"]] == ["order_status"]
    assert columns["id"]["is_primary_key"] and not columns["id"]["is_sensitive"]
    assert (columns["contact"]["sensitivity_type"], columns["contact"]["sensitivity_level"]) == ("email", "high")
    assert len(columns["contact"]["sample_values"]) == 10


def test_jdbc_options():
    options = jdbc.options("postgres", "//host/db", table="s.t", split_by=("id", 0, 1000, 16))
    assert options["url"] == "jdbc:postgresql://host/db" and options["numPartitions"] == "16" and options["dbtable"] == "s.t"
    assert jdbc.options("mysql", "//h/d", query="select 1")["query"] == "select 1"
    with pytest.raises(ValueError):
        jdbc.options("mysql", "//h/d")
    with pytest.raises(ValueError):
        jdbc.options("mysql", "//h/d", query="select 1", split_by=("id", 0, 1, 2))


def test_limits_of_the_configuration():
    for wrong in ({"sample_size": 0}, {"top_values_limit": 0}, {"max_concurrent_tables": -1}, {"rank_sketch": 7}):
        with pytest.raises(ValueError):
            ProfileConfig(**wrong)
    assert ProfileConfig(sample_size=5000, top_values_limit=500, max_concurrent_tables=200).sample_size == 5000
