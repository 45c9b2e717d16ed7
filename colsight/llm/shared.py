"""What the operators of this package share: text expressions, stored steps, totals over a global order."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsight.sources.staging import columnar as stored  # noqa: F401  a step written to and read from the shared folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_BYTES = 32 << 20


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def boxed(df: DataFrame, **internal: Column) -> DataFrame:
    """All columns in one struct ``row``, so that no column of the caller clashes with ``internal`` ones."""
    row = F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row")
    return df.select(row, *[column.alias(name) for name, column in internal.items()])


def unboxed(df: DataFrame, columns: Iterable[str], **added: Column) -> DataFrame:
    """The caller's columns again, and ``added`` ones, which replace columns of the same name."""
    names = {name.lower() for name in added}
    kept = [F.col(f"row.{quoted(c)}") for c in columns if c.lower() not in names]
    return df.select(*kept, *[column.alias(name) for name, column in added.items()])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Maximal runs of characters that are not ASCII white space; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def broadcast_if_small(df: DataFrame, width: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A stored step, marked for broadcast if its rows of ``width`` bytes stay within ``limit`` bytes.

    Beyond that the join shuffles both sides; the result is the same.
    """
    return F.broadcast(df) if df.count() * width <= limit else df


def sorted_chunks(df: DataFrame, *order: Column | str) -> DataFrame:
    """The rows in one global order, stored: ``chunk`` numbers the sorted ranges, ``place`` grows with the order.

    Ranges also split a run of equal keys, so a hot key does not fill one task. The step is stored because range bounds are sampled anew for each plan.
    """
    keys = [*order, "_tie"]
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = ranged.withColumns({"chunk": F.spark_partition_id(), "place": F.monotonically_increasing_id()})
    return stored(placed.drop("_tie"))


def row_numbers(df: DataFrame, *order: Column | str) -> DataFrame:
    """Adds ``number``: 0, 1, 2 ... over all rows in the given order."""
    chunks = sorted_chunks(df, *order)
    first = chunks.groupBy("chunk").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    earlier = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = first.select("chunk", "first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    numbered = chunks.join(F.broadcast(starts), "chunk")  # a row for each task of the sort
    return numbered.select(*df.columns, (F.col("place") - F.col("first") + F.col("offset")).alias("number"))


def running_totals(df: DataFrame, group: str, order: list[Column | str], **values: Column) -> DataFrame:
    """Adds for each of ``values`` a column: its total over the rows of the same group that come earlier.

    ``group`` must not be null. A group of any size is spread over the sorted ranges: totals inside
    a range and totals of the ranges before it are summed apart. ``place`` tells the rows apart.
    """
    chunks = sorted_chunks(df, group, *order)
    earlier = Window.unboundedPreceding, -1
    sums = chunks.groupBy("chunk", group).agg(*[F.sum(value).alias(name) for name, value in values.items()])
    ranges = Window.partitionBy(group).orderBy("chunk").rowsBetween(*earlier)
    offsets = sums.select("chunk", group, *[F.coalesce(F.sum(name).over(ranges), F.lit(0)).alias(f"_{name}") for name in values])
    inside = Window.partitionBy("chunk", group).orderBy("place").rowsBetween(*earlier)
    summed = chunks.withColumns({name: F.coalesce(F.sum(value).over(inside), F.lit(0)) for name, value in values.items()})
    totals = [(F.col(name) + F.col(f"_{name}")).alias(name) for name in values]
    return summed.join(offsets, ["chunk", group]).select(*df.columns, "place", *totals)
