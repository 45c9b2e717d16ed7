"""Text sources in one pass, broken records and damaged files."""

import csv
import io
import json
import random

import pytest

from colsight.plans.files import bucket_of, file_run, named_sources
from colsight.sources import records
from colsight.sources.quarantine import sound_parquet
from colsight.sources.readers import FileSource


BLOCK = 700  # bytes: files of a few kilobytes are read by several tasks, as large ones are


def rejected(found):
    return sorted((r.line, r.reason, r.record) for r in found.rejected.collect())


def written(rows, **options):
    text = io.StringIO()
    csv.writer(text, lineterminator="\n", **options).writerows(rows)
    return text.getvalue()


@pytest.mark.parametrize(("separator", "line_end"), [(",", "\n"), ("|", "\r\n")])
def test_csv_records_over_lines_and_blocks(spark, tmp_path, separator, line_end):
    rng = random.Random(7)
    parts = ["plain", "two\nlines", 'say "hi"', "\n\n", "a, b; c | d", 'x"\n"y', "é漢😀"]
    rows = [[i, "".join(rng.choices(parts, k=rng.randint(1, 30))) or "-", i / 4] for i in range(300)]
    text = written([["id", "text", "n"], *rows], delimiter=separator, quoting=csv.QUOTE_NONNUMERIC)
    (tmp_path / "t.csv").write_bytes(text.replace("\n", "\n").encode() if line_end == "\n" else b"\r\n".join(line.encode() for line in written([["id", "text", "n"], *[[i, "t", x] for i, _, x in rows]], delimiter=separator).split("\n")))
    found = records.read_records(spark, FileSource(str(tmp_path / "t.csv"), block_bytes=BLOCK))
    assert [f.dataType.simpleString() for f in found.rows.schema] == ["int", "string", "double"]
    got = sorted(tuple(r) for r in found.rows.collect())
    assert got == [(i, x if line_end == "\n" else "t", n) for i, x, n in rows]
    assert rejected(found) == []


def test_rejected_csv_records(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,x\n2,y,z\n\n3,"open\n4,w\n')
    found = records.read_records(spark, FileSource(str(tmp_path / "t.csv")))
    assert sorted(tuple(r) for r in found.rows.collect()) == [(1, "x")]
    assert rejected(found) == [(3, "not the fields that the header names", "2,y,z"), (5, "a quote is never closed", '3,"open'), (6, "a quote is never closed", "4,w")]


def test_csv_types_and_schema(spark, tmp_path):
    (tmp_path / "t.csv").write_text("i,l,d,day,at,b,none,mixed\n1,9999999999,1.5,2020-01-02,2020-01-02 03:04:05,true,,1\n-2,1,1e3,2021-01-02,2020-01-02 03:04:05.25,FALSE,,x\n")
    found = records.read_records(spark, FileSource(str(tmp_path / "t.csv")))
    assert [f.dataType.simpleString() for f in found.rows.schema] == ["int", "bigint", "double", "date", "timestamp_ntz", "boolean", "string", "string"]
    given = records.read_records(spark, FileSource(str(tmp_path / "t.csv"), schema="a bigint, b bigint, c double, d date, e timestamp_ntz, f boolean, g string, h int"))
    assert [r.a for r in given.rows.collect()] == [1] and [r[1] for r in rejected(given)] == ["a value is not of its type"]
    (tmp_path / "n.csv").write_text("1;2\n3;4\n")
    bare = records.read_records(spark, FileSource(str(tmp_path / "n.csv"), has_header=False))
    assert bare.rows.columns == ["_c0", "_c1"] and sorted(map(tuple, bare.rows.collect())) == [(1, 2), (3, 4)]


def test_several_csv_files(spark, tmp_path):
    for name, body in (("a.csv", 'n,t\n1,"x\ny"\n'), ("b.csv", "n,t\n2,z\n"), ("c.csv", "")):
        (tmp_path / name).write_text(body)
    found = records.read_records(spark, FileSource(f"{tmp_path}/*.csv"))
    assert sorted(map(tuple, found.rows.collect())) == [(1, "x\ny"), (2, "z")]


def test_json_arrays_and_lines_in_parallel(spark, tmp_path):
    rng = random.Random(9)
    rows = [{"id": i, "t": "".join(rng.choices(["[", "]", "{", "}", '"', "\\", ",", "a", "é"], k=rng.randint(0, 60))), "x": [i, {"y": None}], "n": i / 2} for i in range(120)]
    (tmp_path / "pretty.json").write_text("\n" + json.dumps(rows[:40], indent=2) + "\n\n")
    (tmp_path / "compact.json").write_text(json.dumps(rows[40:60]))
    (tmp_path / "mixed.json").write_text("[" + ",\n".join(map(json.dumps, rows[60:80])) + "]")
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows[80:])) + "\n")
    (tmp_path / "empty.json").write_text("[]")
    found = records.read_records(spark, FileSource(f"{tmp_path}/*.json", block_bytes=BLOCK))
    assert rejected(found) == []
    assert sorted((r.id, r.t, r.n) for r in found.rows.collect()) == [(r["id"], r["t"], r["n"]) for r in rows]


def test_rejected_json_records(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"a": 1}\n{"a": \n5\n\n{"a": 2}\n')
    found = records.read_records(spark, FileSource(str(tmp_path / "lines.json")))
    assert sorted(r.a for r in found.rows.collect()) == [1, 2]
    assert rejected(found) == [(2, "not valid JSON", '{"a": '), (3, "not an object", "5")]
    (tmp_path / "array.json").write_text('[\n{"a": 1},\n{"a" 2},\n{"a": 3},\n{"a": 4')
    cut = records.read_records(spark, FileSource(str(tmp_path / "array.json")))
    assert sorted(r.a for r in cut.rows.collect()) == [1, 3]
    assert rejected(cut) == [(3, "not valid JSON", '{"a" 2},'), (5, "a bracket is never closed", '{"a": 4')]


def test_empty_text_sources(spark, tmp_path):
    for name in ("t.csv", "t.json"):
        (tmp_path / name).write_text("")
        found = records.read_records(spark, FileSource(str(tmp_path / name)))
        assert found.rows.count() == found.rejected.count() == 0


def parquet_folder(spark, path):
    spark.range(0, 4000, 1, 4).selectExpr("id", "sha2(cast(id as string), 256) as t").write.parquet(str(path))
    return sorted(path.glob("*.parquet"))


def damage(file, start, length):
    data = bytearray(file.read_bytes())
    data[start : start + length] = b"\x55" * length
    file.write_bytes(bytes(data))
    (file.parent / f".{file.name}.crc").unlink()


def test_damaged_files_lose_only_themselves(spark, tmp_path):
    files = parquet_folder(spark, tmp_path / "t.parquet")
    files[0].write_bytes(files[0].read_bytes()[:500])  # no footer
    (tmp_path / "t.parquet" / f".{files[0].name}.crc").unlink()
    damage(files[1], 10, files[1].stat().st_size // 2)  # pages that cannot be decoded under a sound footer
    spark.range(0).selectExpr("id", "'' as t").coalesce(1).write.mode("append").parquet(str(tmp_path / "t.parquet"))  # an empty file is no damage
    found = sound_parquet(spark, FileSource(str(tmp_path / "t.parquet")))
    assert found.rows.count() == 2000
    assert sorted((r.file.rsplit("/", 1)[1], r.reason) for r in found.rejected.collect()) == sorted([(files[0].name, "no valid footer"), (files[1].name, "damaged data")])


def test_file_run(spark, tmp_path):
    files = parquet_folder(spark, tmp_path / "t.parquet")
    files[0].write_bytes(b"PAR1 nothing of use PAR1")
    (tmp_path / "t.parquet" / f".{files[0].name}.crc").unlink()
    (tmp_path / "lines.json").write_text('{"a": 1}\n{"a"\n')
    (tmp_path / "whole.parquet").mkdir()
    run = file_run(spark, [FileSource(str(tmp_path / n)) for n in ("t.parquet", "lines.json", "missing.csv")])
    got = {(r.table_name, r.column_name): (r.total_count, r.failed) for r in run.profile.collect()}
    assert got == {("t", "id"): (3000, False), ("t", "t"): (3000, False), ("lines", "a"): (1, False), ("missing", None): (None, True)}
    assert sorted((r.table_name, r.line) for r in run.rejected.collect()) == [("lines", 2), ("t", None)]
    assert {(r.schema_name, r.table_name) for r in run.tables.collect()} == {("files", n) for n in ("t", "lines", "missing")}
    with pytest.raises(ValueError):
        file_run(spark, [])


def test_buckets_are_schemas():
    assert [bucket_of(p) for p in ("s3a://my-bucket/a/b.csv", "abfss://box@account/x", "/data/x.csv", "file:///x/y")] == ["my-bucket", "box@account", "files", "files"]
    sources = [FileSource(p) for p in ("s3a://a/x/t.csv", "s3a://a/y/t.csv", "s3a://b/t.csv")]
    assert list(named_sources(sources)) == [("a", "t"), ("a", "t_2"), ("b", "t")]
