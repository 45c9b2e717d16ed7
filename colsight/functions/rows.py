"""Small constant frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _literal(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def table_key(*frames: DataFrame, column: bool = False) -> list[str]:
    """The columns that name a table in all of ``frames``: with its schema where every one of them carries it."""
    schema = ["schema_name"] if all("schema_name" in frame.columns for frame in frames) else []
    return [*schema, "table_name", *["column_name"] * column]


def constant_rows(spark: SparkSession, rows: Sequence[Sequence[object]], schema: str) -> DataFrame:
    """A frame written into the plan itself.

    ``createDataFrame`` would spread the same few rows over as many tasks as the cluster has cores.
    """
    fields = T._parse_datatype_string(schema).fields
    if not rows:
        casts = [f"cast(null as {f.dataType.simpleString()}) as `{f.name}`" for f in fields]
        return spark.range(0).selectExpr(*casts)
    values = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in rows)
    frame = spark.sql(f"select * from values {values}").toDF(*[f.name for f in fields])
    return frame.select(*[frame[f.name].cast(f.dataType).alias(f.name) for f in fields])
