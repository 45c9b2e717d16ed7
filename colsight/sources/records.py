"""Text sources read once: lines are stored with their place, and records, separator, layout and types are found on the copy.

A record may cover several lines: a CSV field with line breaks in quotes, an element of a JSON array. Whether a line goes on with
the record before it follows from a sum over all earlier lines of its file, of quotes or of brackets. Sums are taken
inside the blocks that tasks read, and over the blocks of a file, so a large file stays spread over many tasks: what is known of files and
blocks, a row for each, is broadcast, and lines never meet by file. What is no record is kept with its file, line and reason.
"""

from __future__ import annotations

import csv
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.functions.values import quoted
from colsight.operators.cells import union_all
from colsight.sources.readers import SEPARATORS, FileSource, file_format, matching_files, separator_counts
from colsight.sources.staging import columnar, shared_folder

REJECTED = "file string, line bigint, reason string, record string"
_PLACE = ["file", "block"]
_EARLIER = Window.unboundedPreceding, -1


@dataclass(frozen=True)
class Records:
    """The typed rows of a source, and what could not be read; both are stored."""

    rows: DataFrame
    rejected: DataFrame


def read_records(spark: SparkSession, source: FileSource) -> Records:
    """A CSV or JSON source in one pass over its files."""
    files = matching_files(spark, source.path) if "**" in source.path else source.path
    lines = stage_lines(spark, files, source.block_bytes)
    return _json_records(lines, source) if file_format(source) == "json" else _csv_records(lines, source)


def stage_lines(spark: SparkSession, files: str | list[str], block_bytes: int | None = None) -> DataFrame:
    """``file, block, seq, value``: every line, with the block of its file that one task reads; ``seq`` counts up inside a block."""
    reader = spark
    if block_bytes is not None:
        reader = spark.newSession()  # a session of its own, so that other reads keep their splits
        reader.conf.set("spark.sql.files.maxPartitionBytes", block_bytes)
    lines = reader.read.option("lineSep", "\n").text(files)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    path = shared_folder(spark)
    lines.select(*place, F.monotonically_increasing_id().alias("seq"), "value").write.parquet(path)
    return spark.read.parquet(path)


def _before(blocks: DataFrame, *columns: str) -> DataFrame:
    """Adds ``<column>_before``: the sum over the earlier blocks of the file; a file has one row per block here."""
    window = Window.partitionBy("file").orderBy("block").rowsBetween(*_EARLIER)
    return blocks.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(window), F.lit(0)) for c in columns})


def _grouped(lines: DataFrame, step: Column, is_start: Callable[[Column], Column], closed: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """``file, line, at, record`` of records over lines, and the lines of records that a file never closes.

    ``step`` is what a line adds to the sum ``at``, ``is_start`` tells from the sum before a line whether a record starts there, and ``closed`` from the sum of
    a whole file whether its last record is complete. The lines of one record, no more, are gathered.
    """
    stepped = lines.withColumn("step", step.cast("long"))
    blocks = stepped.groupBy(*_PLACE).agg(F.sum("step").alias("sum"), F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    blocks = columnar(_before(blocks, "sum", "n"))
    inside = Window.partitionBy(*_PLACE).orderBy("seq")
    # One block of a file enters a window partition.
    summed = stepped.join(F.broadcast(blocks.drop("sum", "n")), _PLACE).withColumns(
        {
            "at": F.col("sum_before") + F.coalesce(F.sum("step").over(inside.rowsBetween(*_EARLIER)), F.lit(0)),
            "line": F.col("n_before") + F.col("seq") - F.col("first") + 1,
        }
    )
    marked = columnar(summed.withColumn("start", is_start(F.col("at")).cast("long")).select("file", "block", "seq", "line", "at", "value", "start"))
    starts = _before(marked.groupBy(*_PLACE).agg(F.sum("start").alias("start")), "start").drop("start")
    numbered = marked.join(F.broadcast(starts), _PLACE).withColumn("number", F.col("start_before") + F.sum("start").over(inside))
    files = blocks.groupBy("file").agg(closed(F.sum("sum")).alias("closed"))
    counted = marked.groupBy("file").agg(F.sum("start").alias("records"))
    # Per record: its first line, its lines in order.
    open_ends = files.where("not closed").join(counted, "file").select("file", "records")
    told = numbered.join(F.broadcast(open_ends), "file", "left").withColumn("open", F.coalesce(F.col("number") == F.col("records"), F.lit(False)))
    told = columnar(told.select("file", "line", "at", "value", "number", "open"))
    ordered = F.array_sort(F.collect_list(F.struct("line", "value")))
    text = F.array_join(F.transform(ordered, lambda e: e["value"]), "\n")
    first = [F.min("line").alias("line"), F.min_by("at", "line").alias("at")]
    records = told.where("not open").groupBy("file", "number").agg(*first, text.alias("record"))
    return records.select("file", "line", "at", "record"), told.where("open").select("file", "line", F.col("value").alias("record"))


def _whole_lines(lines: DataFrame) -> DataFrame:
    """``file, line, record`` where each line is a record."""
    blocks = _before(lines.groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first")), "n")
    numbered = lines.join(F.broadcast(blocks.drop("n")), _PLACE)
    return numbered.select("file", (F.col("n_before") + F.col("seq") - F.col("first") + 1).alias("line"), F.col("value").alias("record"))


def _without_return(text: Column) -> Column:
    return F.regexp_replace(text, "\r$", "")


def _rejected(frame: DataFrame, reason: str | Column) -> DataFrame:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return frame.select("file", F.col("line").cast("bigint").alias("line"), reason.alias("reason"), "record")


def _split(lines: DataFrame, files: DataFrame, test: str) -> tuple[DataFrame, DataFrame]:
    """The lines of the files that meet a test, and the others; one row per file decides."""
    marked = lines.join(F.broadcast(files.select("file", F.expr(test).alias("meets"))), "file")
    return marked.where("meets").drop("meets"), marked.where("not meets").drop("meets")


# ── CSV ───────────────────────────────────────────────────────────────────────


def _csv_records(lines: DataFrame, source: FileSource) -> Records:
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = quotes % 2
    files = lines.groupBy("file").agg((F.max(odd) == 1).alias("wrapped"))
    wrapped, plain = _split(lines, files, "wrapped")
    records, unclosed = _grouped(wrapped, odd, lambda at: at % 2 == 0, lambda total: total % 2 == 0)
    records = records.drop("at").unionByName(_whole_lines(plain)).withColumn("record", _without_return(F.col("record")))
    records = columnar(records.where(F.trim("record") != ""))
    firsts = columnar(records.groupBy("file").agg(F.min("line").alias("line"), F.min_by("record", "line").alias("record")))
    separator = source.delimiter or _separator(records, firsts)
    given = T._parse_datatype_string(source.schema).fields if source.schema else None
    header = firsts.orderBy("file").select("record").first()
    names = [f.name for f in given] if given else _names(next(csv.reader([header[0]], delimiter=separator)) if header else [], source.has_header)
    if source.has_header:
        records = records.join(firsts.select("file", "line"), ["file", "line"], "left_anti")  # one row per file
    options = {"sep": separator, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_rejected"}
    texts = ", ".join(f"{quoted(name)} string" for name in [*names, "_rejected"])
    parsed = columnar(records.withColumn("row", F.from_csv("record", texts, options)))
    whole = parsed.where("row._rejected is null")
    kinds = [f.dataType.simpleString() for f in given] if given else _inferred(whole, names)
    values = [F.col(f"row.{quoted(name)}") for name in names]
    typed = [value.try_cast(kind).alias(name) for value, kind, name in zip(values, kinds, names, strict=True)]
    unfit = F.lit(False)
    if given:
        for value, kind in zip(values, kinds, strict=True):
            unfit = unfit | (value.isNotNull() & value.try_cast(kind).isNull())
    rejected = [
        _rejected(parsed.where("row._rejected is not null"), "not the fields that the header names"),
        _rejected(whole.where(unfit), "a value is not of its type"),
        _rejected(unclosed, "a quote is never closed"),
    ]
    return Records(_stored(whole.where(~unfit).select(*typed)), columnar(union_all(rejected)))


def _stored(rows: DataFrame) -> DataFrame:
    """A Parquet copy; a source without any record has no columns, which Parquet cannot hold."""
    return columnar(rows) if rows.columns else rows.sparkSession.createDataFrame([], T.StructType([]))


def _names(header: list[str], has_header: bool) -> list[str]:
    """Column names of a header; empty and repeated ones by their position, as the reader of Spark names them."""
    if not has_header:
        return [f"_c{at}" for at in range(len(header))]
    lower = [name.lower() for name in header]
    return [f"_c{at}" if not name else f"{name}{at}" if lower.count(name.lower()) > 1 else name for at, name in enumerate(header)]


def _separator(records: DataFrame, firsts: DataFrame) -> str:
    """As :func:`colsight.sources.readers.sniff_separator`, over records that are stored already."""
    counts = firsts.select(*separator_counts("record"))
    ends = counts.agg(*[F.struct(F.min(c), F.max(c)) for c in counts.columns]).first()
    if not any(high for _, high in ends):
        return SEPARATORS[0]
    fields = {at: low for at, (low, high) in enumerate(ends) if low == high and low}
    if not fields:
        raise ValueError("no separator splits the first lines evenly; give delimiter")
    agreeing = records.select(*separator_counts("record")).agg(*[F.count_if(F.col(f"n{at}") == n) for at, n in fields.items()]).first()
    return SEPARATORS[max(zip(agreeing, fields.values(), [-at for at in fields], fields, strict=True))[3]]


# Types in the order in which they are tried: name and pattern of the texts that count as one.
_TYPES = (
    ("int", r"^[+-]?\d{1,10}$"), ("bigint", r"^[+-]?\d{1,19}$"), ("decimal(38,0)", r"^[+-]?\d{20,38}$"),
    ("double", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), ("date", r"^\d{4}-\d{2}-\d{2}$"),
    ("timestamp_ntz", r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?$"), ("timestamp", r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}.*$"),
    ("boolean", r"(?i)^(true|false)$"),
)


def _inferred(parsed: DataFrame, names: list[str]) -> list[str]:
    """The narrowest type that every value of a column has: one aggregate over the stored records."""
    checks = []
    for at, name in enumerate(names):
        value = F.trim(F.col(f"row.{quoted(name)}"))
        fits = [F.coalesce(F.bool_and(value.rlike(pattern) & value.try_cast(kind).isNotNull()), F.lit(False)).alias(f"t{k}") for k, (kind, pattern) in enumerate(_TYPES)]
        checks.append(F.struct(*fits).alias(f"c{at}"))
    found = parsed.agg(*checks).first() if checks else []
    return [next((kind for (kind, _), fits in zip(_TYPES, column, strict=True) if fits), "string") for column in found]


# ── JSON ──────────────────────────────────────────────────────────────────────


def _json_records(lines: DataFrame, source: FileSource) -> Records:
    place = F.struct("block", "seq")
    filled = lines.where(F.trim(F.regexp_replace("value", r"[\r\t]", "")) != "")
    files = filled.groupBy("file").agg(F.ltrim(F.min_by("value", place)).startswith("[").alias("array"))
    arrays, plain = _split(lines, files, "array")
    # A text in JSON holds no line break, so every line begins outside of texts.
    bare = F.regexp_replace("value", r'"(\\.|[^"\\])*"', "")
    opened, shut = (F.length(bare) - F.length(F.regexp_replace(bare, marks, "")) for marks in (r"[\[{]", r"[\]}]"))
    chunks, unclosed = _grouped(arrays, opened - shut, lambda at: at <= 1, lambda total: total == 0)
    text = F.regexp_replace(F.regexp_replace("record", r"^\s+|\s+$", ""), r",$", "")
    opening = F.regexp_replace(text, r"^\[", "")
    inner = F.regexp_replace(F.when(F.col("at") == 0, opening).otherwise(text), r"^\s+|\s+$", "")
    # The bracket that closes the file stands alone or at the end of the last element.
    balanced = F.when(_depth(inner) < 0, F.regexp_replace(inner, r"\s*\]$", "")).otherwise(inner)
    elements = chunks.select("file", "line", "record", balanced.alias("text")).where(F.trim("text") != "")
    held = elements.withColumn("items", F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), "text", F.lit("]"))), "$", "array<variant>"))
    exploded = held.select("file", "line", "record", F.explode_outer("items").alias("item"))
    whole = _whole_lines(plain).where(F.trim(F.regexp_replace("record", r"[\r\t]", "")) != "")
    parsed = columnar(exploded.unionByName(whole.select("file", "line", "record", F.try_parse_json("record").alias("item"))))
    good = F.coalesce(F.schema_of_variant("item").startswith("OBJECT"), F.lit(False))
    schema = source.schema or _object_schema(parsed.where(good))
    typed = parsed.where(good).select(F.try_variant_get("item", "$", f"struct<{schema}>").alias("row"))
    rejected = _rejected(parsed.where(~good), F.when(F.col("item").isNull(), "not valid JSON").otherwise("not an object"))
    rejected = columnar(rejected.unionByName(_rejected(unclosed, "a bracket is never closed")))
    names = [f.name for f in T._parse_datatype_string(schema).fields] if schema else []
    return Records(_stored(typed.select(*[F.col(f"row.{quoted(n)}").alias(n) for n in names])), rejected)


def _depth(text: Column) -> Column:
    """How many brackets a text opens more than it closes."""
    bare = F.regexp_replace(text, r'"(\\.|[^"\\])*"', "")
    return F.length(F.regexp_replace(bare, r"[^\[{]", "")) - F.length(F.regexp_replace(bare, r"[^\]}]", ""))


def _object_schema(parsed: DataFrame) -> str:
    """The fields of all objects; numbers with a fraction are doubles, fields of unlike types texts."""
    found = parsed.agg(F.schema_of_variant_agg("item")).first()[0]
    if not found or not found.startswith("OBJECT<"):
        return ""
    kinds = found.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING").replace("VARIANT", "STRING")
    fields = T._parse_datatype_string(kinds).fields
    return ", ".join(f"{quoted(f.name)} {_plain(f.dataType).simpleString()}" for f in fields)


def _plain(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.DecimalType):
        return T.DoubleType() if kind.scale else kind
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_plain(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _plain(f.dataType)) for f in kind.fields])
    return kind
