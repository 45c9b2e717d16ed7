"""Reading files: format by name, separator and JSON layout by looking at every file."""

from __future__ import annotations

import logging
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colsight.sources.staging import columnar

logger = logging.getLogger(__name__)

# How the format and the table name follow from a file name.
PARQUET_ENDINGS = (".parquet", ".parq")
JSON_ENDINGS = (".json", ".jsonl", ".ndjson")
NAME_ENDINGS = (".csv", ".parquet", ".parq", ".json", ".jsonl", ".ndjson", ".gz", ".zst", ".bz2", ".lz4")
UNNAMED = "s3_file"

SEPARATORS = (",", "\t", ";", "|")


@dataclass(frozen=True)
class FileSource:
    """A path or glob that is profiled as one table."""

    path: str
    name: str | None = None
    file_format: str = "auto"
    delimiter: str | None = None
    has_header: bool = True
    schema: str | None = None  # saves the pass that infers CSV and JSON types
    multi_line: bool = True  # quoted CSV fields may hold line breaks; then a file is read in one piece
    block_bytes: int | None = None  # how much of a text file one task reads in a single pass; None: as the session says


def _last_segment(path: str) -> str:
    return path.rstrip("/").split("/")[-1]


def file_format(source: FileSource) -> str:
    if source.file_format != "auto":
        return source.file_format
    segment = _last_segment(source.path).lower()
    if segment.endswith(PARQUET_ENDINGS):
        return "parquet"
    return "json" if segment.endswith(JSON_ENDINGS) else "csv"


def table_name(source: FileSource) -> str:
    """The given name, or the last path segment without endings and odd characters."""
    if source.name:
        return source.name
    segment = _last_segment(source.path)
    for ending in NAME_ENDINGS:
        if segment.lower().endswith(ending):
            segment = segment[: -len(ending)]
    return re.sub(r"[^a-zA-Z0-9_]", "_", segment).strip("_") or UNNAMED


def table_name_of(path: Column) -> Column:
    """The same rule over a column of paths, for many files named in one job."""
    segment = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    for ending in NAME_ENDINGS:
        segment = F.regexp_replace(segment, f"(?i){re.escape(ending)}$", "")
    name = F.regexp_replace(F.regexp_replace(segment, "[^a-zA-Z0-9_]", "_"), "^_+|_+$", "")
    return F.when(name == "", UNNAMED).otherwise(name)


def matching_files(spark: SparkSession, pattern: str) -> list[str]:
    """Files whose whole path fits a glob in which ``**`` stands for any number of folders."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern.partition("*")[0].rpartition("/")[0] or ".")
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rules = {"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", system.makeQualified(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)).toString())
    fits = re.compile("".join(rules.get(part, re.escape(part)) for part in parts))
    found, listing = [], system.listFiles(root, True)
    while listing.hasNext():
        path = listing.next().getPath().toString()
        # a table may be a folder that fits, with part files in it
        if fits.fullmatch(path) or fits.fullmatch(path.rpartition("/")[0]):
            name = path.rpartition("/")[2]
            found += [path] * (not name.startswith(("_", ".")))
    if not found:
        raise FileNotFoundError(pattern)
    return sorted(found)


def _first_lines(spark: SparkSession, files: str | list[str]) -> DataFrame:
    """``file, first``: the first line of each file that is not blank."""
    place = F.struct("_metadata.file_block_start", F.monotonically_increasing_id())
    lines = spark.read.text(files).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), "value", place.alias("place"))
    return lines.groupBy("file").agg(F.min_by("value", "place").alias("first"))


def separator_counts(line: str | Column) -> list[Column]:
    """How often each candidate occurs outside quotes."""
    bare = F.regexp_replace(line, '"[^"]*"', "")
    return [(F.length(bare) - F.length(F.replace(bare, F.lit(s), F.lit("")))).alias(f"n{at}") for at, s in enumerate(SEPARATORS)]


def sniff_separator(spark: SparkSession, files: str | list[str]) -> str:
    """The candidate found equally often, outside quotes, in the first line of every file.

    Of several, the one that splits the most lines of all files in the same way as the first lines; more fields
    win a tie. A source whose first lines hold no candidate has one column; one whose first lines disagree is refused.
    """
    counts = _first_lines(spark, files).select(*separator_counts("first"))
    ends = counts.agg(*[F.struct(F.min(c), F.max(c)) for c in counts.columns]).first()
    if not any(high for _, high in ends):
        return SEPARATORS[0]
    fields = {at: low for at, (low, high) in enumerate(ends) if low == high and low}
    if not fields:
        raise ValueError(f"no separator splits the first lines of {files} evenly; give delimiter")
    lines = spark.read.text(files).select(*separator_counts("value"))
    agreeing = lines.agg(*[F.count_if(F.col(f"n{at}") == n) for at, n in fields.items()]).first()
    return SEPARATORS[max(zip(agreeing, fields.values(), [-at for at in fields], fields, strict=True))[3]]


def json_layouts(spark: SparkSession, files: str | list[str]) -> dict[str, bool]:
    """The files that are not blank, and whether the first character is that of an array."""
    first = _first_lines(spark, files).select("file", F.ltrim("first").startswith("[").alias("array"))
    return {r.file: r.array for r in first.collect()}


def _read_json(reader, spark: SparkSession, files: str | list[str]) -> DataFrame:  # noqa: ANN001
    """Line files and array files apart, each in its own way; a broken record fails the read.

    An array file is one record to the reader and cannot be split; lines can.
    """
    reader = reader.option("mode", "FAILFAST")
    layouts = json_layouts(spark, files)
    arrays, lines = (sorted(f for f, array in layouts.items() if array == wanted) for wanted in (True, False))
    if not arrays:
        return reader.json(files)
    whole = reader.json(arrays, multiLine=True)
    return whole.unionByName(reader.json(lines, multiLine=False), allowMissingColumns=True) if lines else whole


def read(spark: SparkSession, source: FileSource) -> DataFrame:
    """A file source as a DataFrame; ``**`` in a glob stands for any number of folders."""
    reader = spark.read
    path: str | list[str] = matching_files(spark, source.path) if "**" in source.path else source.path
    if source.schema:
        reader = reader.schema(source.schema)
    kind = file_format(source)
    if kind == "parquet":
        return reader.parquet(*([path] if isinstance(path, str) else path))
    if kind == "json":
        return _read_json(reader, spark, path)
    separator = source.delimiter or sniff_separator(spark, path)
    # Quotes are doubled inside quotes, as spreadsheets and databases write them.
    return reader.csv(
        path, sep=separator, header=source.has_header, inferSchema=not source.schema, quote='"', escape='"', multiLine=source.multi_line
    )


def probe(spark: SparkSession, source: FileSource) -> DataFrame:
    """One row, to see that the source can be read."""
    return read(spark, source).limit(1)


def read_all(spark: SparkSession, sources: Sequence[FileSource], stage: bool = False) -> dict[str, DataFrame]:
    """Every readable source under its table name; an unreadable one is skipped with a warning.

    ``stage`` copies CSV and JSON to Parquet first, for work that scans a table more than once.
    """
    if not sources:
        raise ValueError("no paths are given")
    tables: dict[str, DataFrame] = {}
    for source in sources:
        try:
            df = read(spark, source)
            if stage and file_format(source) != "parquet":
                df = columnar(df)
        except Exception as error:  # any reader failure only loses this path
            logger.warning("skipping %s: %s", source.path, str(error).splitlines()[0])
            continue
        name = base = table_name(source)
        suffix = 2
        while name in tables:
            name, suffix = f"{base}_{suffix}", suffix + 1
        tables[name] = df
    if not tables:
        raise RuntimeError("none of the given paths could be read")
    return tables
