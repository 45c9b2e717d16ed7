"""The shared folder for intermediate tables, and columnar copies of row-oriented sources."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that every executor reaches")
        base = tempfile.mkdtemp(prefix="colsight-")
    return f"{base.rstrip('/')}/colsight-{uuid.uuid4().hex}"


def estimated_bytes(df: DataFrame) -> int:
    """The size of a frame by the optimizer's estimate; nothing is read for it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def columnar(df: DataFrame) -> DataFrame:
    """A Parquet copy in the shared folder: of a CSV, JSON or JDBC source, or of a result used often.

    The profile reads a table in several column-pruned scans. That is one read of a columnar
    source, but one full parse per scan of a row-oriented one; writing it once costs less. The copy
    also ends the lineage, so a lost executor does not repeat the work behind it.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
