"""Tables as cells: one row per (column, value), the common input of the value-frequency work.

All tables of a run are numbered together, so one shuffle per value type serves every column of
every table. Cells of the same Spark type share a branch and keep that type: integers are never
compared as doubles and doubles never as text.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.functions import types as kinds
from colsight.functions.rows import constant_rows
from colsight.functions.values import grouping_key, quoted


@dataclass(frozen=True)
class ColumnRef:
    """One profiled column: ``cid`` numbers the columns of all tables of a run."""

    cid: int
    table: str
    ordinal: int
    name: str
    data_type: T.DataType
    category: str


@dataclass(frozen=True)
class Dataset:
    """Named tables and their numbered columns."""

    tables: Mapping[str, DataFrame]
    columns: tuple[ColumnRef, ...]

    @classmethod
    def of(cls, tables: Mapping[str, DataFrame]) -> Dataset:
        refs: list[ColumnRef] = []
        for table, df in tables.items():
            for ordinal, field in enumerate(df.schema.fields, start=1):
                category = kinds.category_of(field.dataType)
                refs.append(ColumnRef(len(refs), table, ordinal, field.name, field.dataType, category))
        return cls(dict(tables), tuple(refs))

    def of_category(self, *categories: str) -> list[ColumnRef]:
        return [ref for ref in self.columns if ref.category in categories]

    @property
    def spark(self) -> SparkSession:
        return next(iter(self.tables.values())).sparkSession


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return constant_rows(spark, [], schema)


def column_frame(data: Dataset) -> DataFrame:
    """The column list as a frame; its size is the number of columns, never the data."""
    rows = [
        (r.cid, r.table, r.ordinal, r.name, r.data_type.simpleString(), r.category) for r in data.columns
    ]
    schema = "cid int, table_name string, ordinal int, column_name string, data_type string, category string"
    return constant_rows(data.spark, rows, schema)


def typed_cells(data: Dataset, refs: Iterable[ColumnRef], keyed: bool) -> dict[T.DataType, DataFrame]:
    """Non-null cells ``(cid, v)`` per value type. ``keyed`` replaces each value by its grouping key."""
    by_type: dict[T.DataType, dict[str, list[str]]] = {}
    for ref in refs:
        value = grouping_key(ref.name, ref.data_type) if keyed else quoted(ref.name)
        value_type = _key_type(ref.data_type) if keyed else ref.data_type
        by_type.setdefault(value_type, {}).setdefault(ref.table, []).append(f"{ref.cid}, {value}")
    return {
        value_type: union_all(
            data.tables[table].selectExpr(f"stack({len(cells)}, {', '.join(cells)}) as (cid, v)").where("v is not null")
            for table, cells in per_table.items()
        )
        for value_type, per_table in by_type.items()
    }


def _key_type(data_type: T.DataType) -> T.DataType:
    if isinstance(data_type, T.IntegralType):
        return T.LongType()
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType, T.BinaryType)):
        return T.StringType()
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return T.StringType()
    return data_type


def frequencies(data: Dataset, refs: Iterable[ColumnRef]) -> dict[T.DataType, DataFrame]:
    """``(cid, v, n)`` per value type: how often each distinct non-null key occurs.

    The count is combined on the map side, so a value that fills a third of the rows reaches the
    shuffle as one row per input split.
    """
    cells = typed_cells(data, refs, keyed=True)
    return {t: df.groupBy("cid", "v").agg(F.count(F.lit(1)).alias("n")) for t, df in cells.items()}


def numeric_frequencies(frequency: Mapping[T.DataType, DataFrame], spark: SparkSession) -> DataFrame:
    """``(cid, d, n)`` of the numeric columns, the value as double."""
    numeric = [
        df.selectExpr("cid", "cast(v as double) as d", "n")
        for value_type, df in frequency.items()
        if isinstance(value_type, T.NumericType)
    ]
    return union_all(numeric) if numeric else empty(spark, "cid int, d double, n bigint")


def side_by_side(frequency: Mapping[T.DataType, DataFrame], spark: SparkSession) -> DataFrame:
    """All value types in one frame ``(cid, v0, v1, …, n)``: each type keeps a column of its own."""
    if not frequency:
        return empty(spark, "cid int, v0 string, n bigint")
    branches = []
    for own, df in frequency.items():
        slots = [
            f"{'v' if value_type == own else f'cast(null as {value_type.simpleString()})'} as v{i}"
            for i, value_type in enumerate(frequency)
        ]
        branches.append(df.selectExpr("cid", *slots, "n"))
    return union_all(branches)
