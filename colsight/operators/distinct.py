"""Exact distinct counts: bits for whole numbers and days that lie close together, value frequencies for the rest."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.functions.values import quoted
from colsight.operators.cells import ColumnRef, Dataset, empty, frequencies, side_by_side, union_all
from colsight.sources.staging import estimated_bytes

DENSE_BITS = 16  # bits of a bitmap for each row of a task, where a cell would take some sixteen bytes


def distinct_counts(frequency: Mapping[T.DataType, DataFrame], spark: SparkSession) -> DataFrame:
    """``(cid, distinct_count)``; columns without a non-null value have no row."""
    # Summing n keeps it in the plan, so this reads the same shuffle as the other users of the
    # frequencies instead of a second one without the count column.
    counted = side_by_side(frequency, spark).groupBy("cid").agg(
        F.count(F.lit(1)).alias("distinct_count"), F.sum("n").alias("present")
    )
    return counted.where("present > 0").select("cid", "distinct_count")


def whole_number(ref: ColumnRef) -> str | None:
    """SQL text of a column as a whole number: itself, or its day; None for other types."""
    c = quoted(ref.name)
    if isinstance(ref.data_type, T.IntegralType):
        return f"cast({c} as bigint)"
    if isinstance(ref.data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return f"cast(unix_date(cast({c} as date)) as bigint)"
    return None


def only_days(ref: ColumnRef) -> str:
    """SQL text: whether all times of a column are at midnight, so that a day stands for one value; NULL without any."""
    c = quoted(ref.name)
    return f"bool_and({c} = date_trunc('DAY', {c}))" if isinstance(ref.data_type, (T.TimestampType, T.TimestampNTZType)) else "true"


def splits(df: DataFrame) -> int:
    """About how many tasks read a table, by the optimizer's estimate of its size."""
    per_task = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return max(1, -(-estimated_bytes(df) // per_task))


def is_dense(least: int, most: int, present: int, tasks: int) -> bool:
    """Whether a bitmap of a task, over the whole range, is smaller than its cells."""
    return present > 0 and most - least < DENSE_BITS * max(1, present // tasks)


def dense_columns(data: Dataset, refs: Iterable[ColumnRef]) -> list[ColumnRef]:
    """Those of ``refs`` that are whole numbers or days in a dense range: one aggregate per table, one row per column to the driver."""
    dense = []
    for table, df in data.tables.items():
        held = [r for r in refs if r.table == table and whole_number(r)]
        if not held:
            continue
        fields = [f"struct(min({whole_number(r)}) as least, max({whole_number(r)}) as most, count({quoted(r.name)}) as present, {only_days(r)} as whole) as c{r.cid}" for r in held]
        found, tasks = df.selectExpr(*fields).first(), splits(df)
        for r, (least, most, present, whole) in zip(held, found, strict=True):
            if present and whole and is_dense(least, most, present, tasks):
                dense.append(r)
    return dense


def bitmap_counts(data: Dataset, refs: Iterable[ColumnRef]) -> DataFrame:
    """``(cid, distinct_count)`` of columns of whole numbers: a task sends 4 KB of bits for 32,768 neighbouring values.

    Bits of equal buckets are joined before and after the shuffle; the buckets of a column lie apart, so their counts add up.
    """
    cells = []
    for table, df in data.tables.items():
        values = [f"{r.cid}, {whole_number(r)}" for r in refs if r.table == table]
        if values:
            cells.append(df.selectExpr(f"stack({len(values)}, {', '.join(values)}) as (cid, v)").where("v is not null"))
    if not cells:
        return empty(data.spark, "cid int, distinct_count bigint")
    placed = union_all(cells).selectExpr("cid", "bitmap_bucket_number(v) as bucket", "bitmap_bit_position(v) as place")
    bits = placed.groupBy("cid", "bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
    return bits.groupBy("cid").agg(F.sum(F.bitmap_count("bits")).alias("distinct_count"))


def distinct_counts_of(data: Dataset) -> DataFrame:
    """``(cid, distinct_count)`` of all columns, each in the cheaper way."""
    dense = dense_columns(data, data.columns)
    rest = [r for r in data.columns if r not in dense]
    parts = [bitmap_counts(data, dense)] * bool(dense) + [distinct_counts(frequencies(data, rest), data.spark)] * bool(rest)
    return union_all(parts)

