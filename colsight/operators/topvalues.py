"""Most frequent values of the columns that pass the cardinality gate."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.config import ProfileConfig
from colsight.functions import types as kinds
from colsight.functions.numbers import percentage
from colsight.operators.cells import ColumnRef, Dataset, empty, side_by_side, typed_cells, union_all


def passes_gate(data: Dataset, config: ProfileConfig, enum_columns: Collection[tuple[str, str]] = ()) -> Column:
    """Which columns get top values, over ``cid`` and ``distinct_count``.

    Boolean columns always do, enum columns where the engine has enums, string and numeric columns
    when their distinct count is within the threshold.
    """
    always = [r.cid for r in data.of_category(kinds.BOOLEAN)]
    if config.dialect.has_enum:
        always += [r.cid for r in data.columns if (r.table, r.name) in set(enum_columns)]
    limited = [r.cid for r in data.of_category(kinds.STRING, kinds.NUMERIC)]
    # One comparison instead of an OR over cid: the optimizer would push the cid part of an OR
    # below the frequency aggregate, and a filtered shuffle cannot be shared with the other users.
    limit = (
        F.when(F.col("cid").isin(always), F.lit(2**62))
        .when(F.col("cid").isin(limited), F.lit(config.top_values_cardinality_threshold))
        .otherwise(F.lit(-1))
    )
    return F.col("distinct_count") <= limit


def text_candidates(data: Dataset, sketched: Mapping[int, int], config: ProfileConfig, enum_columns: Collection[tuple[str, str]] = ()) -> list[ColumnRef]:
    """The text columns that may pass the gate, by the ``approx_distinct`` of their ``cid``; the others need not be read again.

    A column is ruled out at twice the threshold, fifty deviations of the sketch away; what is left is counted exactly.
    """
    named = set(enum_columns) if config.dialect.has_enum else set()
    most = 2 * config.top_values_cardinality_threshold
    return [r for r in data.of_category(kinds.STRING) if (r.table, r.name) in named or (sketched.get(r.cid) or 0) <= most]


def value_counts(data: Dataset, frequency: Mapping[T.DataType, DataFrame], gated: DataFrame, texts: Collection[ColumnRef] | None = None) -> DataFrame:
    """``(cid, value, n)`` of the gated columns, the value as text.

    Numbers and booleans reuse the frequency shuffle. Text is grouped again from the source,
    because the frequency holds digests of long text; only gated columns survive the broadcast
    join, so the many distinct values of the other columns never reach this shuffle. ``texts`` are the text columns
    that a sketch has not ruled out (:func:`text_candidates`); without it all are read.
    """
    plain = {t: df for t, df in frequency.items() if isinstance(t, (T.NumericType, T.BooleanType))}
    texts = typed_cells(data, data.of_category(kinds.STRING) if texts is None else texts, keyed=False)
    branches = []
    slots = [f"v{i}" for i in range(len(plain))]
    if plain:
        branches.append(side_by_side(plain, data.spark).withColumn("text", F.lit(None).cast("string")))
    for cells in texts.values():
        nulls = [F.lit(None).cast(t).alias(slot) for slot, t in zip(slots, plain, strict=True)]
        branches.append(cells.select("cid", *nulls, F.lit(1).cast("bigint").alias("n"), F.col("v").cast("string").alias("text")))
    if not branches:
        return empty(data.spark, "cid int, value string, n bigint")
    value = F.coalesce(*[F.col(slot).cast("string") for slot in slots], F.col("text"))
    # The gate is one row per column.
    kept = union_all(branches).join(F.broadcast(gated.select("cid")), "cid")
    return kept.groupBy("cid", value.alias("value")).agg(F.sum("n").alias("n"))


def top_values(counts: DataFrame, limit: int) -> DataFrame:
    """``(cid, rank, value, n)``: most frequent first, ties by value."""
    order = Window.partitionBy("cid").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def top_value_entries(top: DataFrame) -> DataFrame:
    """``(cid, entries)``: the ranked values of a column as one ordered array (at most 50)."""
    return top.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("entries"))


def as_top_values(entries: Column, total: Column) -> Column:
    """Array of ``(value, count, percentage of all rows)``; empty when there is no value."""
    shaped = F.transform(
        entries,
        lambda e: F.struct(
            e["value"].alias("value"), e["n"].alias("count"), percentage(e["n"], total).alias("percentage")
        ),
    )
    return F.coalesce(shaped, F.array().cast("array<struct<value:string,count:bigint,percentage:double>>"))
