"""Writing profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON document per row as text lines."""
    documents.select("document").write.mode("overwrite").text(path)


def write_profile(profile: DataFrame, path: str) -> None:
    """The flat profile, partitioned by table so that a later run can replace one table."""
    profile.write.mode("overwrite").partitionBy("table_name").parquet(path)
