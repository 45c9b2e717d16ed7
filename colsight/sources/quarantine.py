"""Parquet sources with damaged files: the sound ones as a table, the others listed with their reason."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsight.functions.rows import constant_rows
from colsight.functions.values import quoted
from colsight.sources.readers import FileSource, matching_files
from colsight.sources.records import REJECTED, Records


def _rows_read(df: DataFrame) -> DataFrame:
    """``file, rows``: the rows of each file whose every column can be decoded, up to the first damage."""
    decoded = df.select(F.col("_metadata.file_path").alias("file"), F.xxhash64(*[F.to_json(F.struct(quoted(c))) for c in df.columns]).alias("all"))
    # The hash takes part in the result, or the plan would count rows without decoding them.
    return decoded.groupBy("file").agg(F.when(F.bit_xor("all").isNotNull(), F.count(F.lit(1))).alias("rows"))


def _rows_promised(df: DataFrame) -> DataFrame:
    """``file, promised``: the rows of each file by its footer; no column is read."""
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("promised"))


def sound_parquet(spark: SparkSession, source: FileSource, threads: int = 8) -> Records:
    """The rows of the files of a Parquet source that can be read to their end; ``rejected`` has one row for each other file, without a line.

    Two aggregates find the damaged files: rows that can be decoded against rows that the footer names. Only files without any row are then
    opened one by one, to tell empty ones from those whose footer is lost; all others are listed, never opened again.
    """
    paths = matching_files(spark, source.path) if "**" in source.path else [source.path]
    reader = spark.read.option("ignoreCorruptFiles", True).option("mergeSchema", True)
    df = (reader.schema(source.schema) if source.schema else reader).parquet(*paths)
    files = spark.read.format("binaryFile").load(paths).select("path", F.col("_metadata.file_path").alias("file"))
    names = files.where(~F.element_at(F.split("file", "/"), -1).rlike("^[_.]"))
    known = names.join(_rows_promised(df), "file", "left").join(_rows_read(df), "file", "left")
    suspect = known.where("promised is null or rows is null or rows <> promised").select("path", "file", "promised").collect()  # damaged or empty files

    def reason(path: str, promised: int | None) -> str | None:
        if promised is not None:
            return "damaged data"
        try:
            spark.read.parquet(path).count()
        except Exception as error:  # noqa: BLE001  whatever is wrong with the file is its reason
            return "no valid footer" if "footer" in str(error).lower() or "not a parquet file" in str(error).lower() else str(error).splitlines()[0]
        return None

    with ThreadPoolExecutor(threads) as pool:
        reasons = list(pool.map(lambda f: reason(f.path, f.promised), suspect))
    bad = [(f.file, None, why, None) for f, why in zip(suspect, reasons, strict=True) if why]
    rows = df.where(~F.col("_metadata.file_path").isin([file for file, *_ in bad])) if bad else df  # prunes the listing
    return Records(rows, constant_rows(spark, bad, REJECTED))
