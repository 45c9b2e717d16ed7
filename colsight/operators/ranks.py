"""Exact order statistics without sorting a column in one task.

``percentile`` holds every distinct value of a group in one task's memory, which a near-unique
column of a large table does not survive. Here a sketch of the column's rows gives two values around each
wanted rank. These values cut a column into segments, whose rows are counted; only the segments in which a wanted
rank lies are sorted, each in its own window partition. Ranks are counted, so a sketch that misses a rank costs a longer sort,
of the segment beside it, and never a wrong result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colsight.functions import types as kinds
from colsight.functions.values import quoted
from colsight.operators.cells import Dataset, empty, union_all

# The percentiles a numeric column reports.
PERCENTILES = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
MEDIAN = {"median": 0.5}


def rank_error(size: int) -> float:
    """The share of rows by which a rank of a KLL sketch of this size is wrong, with room to spare."""
    return 3 / size**0.9


def _ends(shares: Mapping[str, float]) -> list[str]:
    return [f"{name}_{end}" for name in shares for end in ("from", "to")]


def rank_intervals(data: Dataset, shares: Mapping[str, float], size: int) -> DataFrame:
    """``(cid, <name>_from, <name>_to, …)``: values between which the rows of each share of a numeric column end.

    One aggregate per table; sketches are all that is shuffled, and two numbers for each rank what comes out of it.
    """
    error, scans = rank_error(size), []
    schema = "cid int, " + ", ".join(f"{end} double" for end in _ends(shares))
    for table, df in data.tables.items():
        refs = [r for r in data.of_category(kinds.NUMERIC) if r.table == table]
        if not refs:
            continue
        sketches = [f"kll_sketch_agg_double(cast({quoted(r.name)} as double), {size}) as k{r.cid}" for r in refs]
        rows = []
        for r in refs:
            points = [p for share in shares.values() for p in (max(0.0, share - error), min(1.0, share + error))]
            values = ", ".join(
                f"'{end}', if(kll_sketch_get_n_double(k{r.cid}) > 0, kll_sketch_get_quantile_double(k{r.cid}, {p}D), null)"
                for end, p in zip(_ends(shares), points, strict=True)
            )
            rows.append(f"named_struct('cid', {r.cid}, {values})")
        scans.append(df.selectExpr(*sketches).selectExpr(f"inline(array({', '.join(rows)}))"))
    return union_all(scans) if scans else empty(data.spark, schema)


def values_at_ranks(frequency: DataFrame, ranks: Mapping[str, str], intervals: DataFrame) -> DataFrame:
    """``frequency(cid, d, n)`` to ``(cid, rows, <name>…)``: the value at each named rank.

    A rank is SQL text over ``rows``, the number of non-null rows of the column, giving a 0-based position. ``intervals`` holds
    one row per ``cid`` with columns in pairs, ``…_from`` and ``…_to``; any values give the same result.
    """
    # A segment is named by the number of interval ends below a value, so segments follow the order of values.
    tests = [f"if(coalesce({end} {'<=' if end.endswith('_from') else '<'} d, false), 1, 0)" for end in intervals.columns if end != "cid"]
    # Two numbers for each rank of a column.
    placed = frequency.join(F.broadcast(intervals), "cid").selectExpr("cid", "d", "n", f"{' + '.join(tests)} as segment")
    totals = placed.groupBy("cid", "segment").agg(F.sum("n").alias("n"))

    # At most one row more per column than there are interval ends enters these windows.
    column = Window.partitionBy("cid")
    wanted = ", ".join(f"struct('{name}' as name, {rank} as rank)" for name, rank in ranks.items())
    located = (
        totals.withColumns({"rows": F.sum("n").over(column), "before": F.sum("n").over(column.orderBy("segment")) - F.col("n")})
        .selectExpr("*", f"filter(array({wanted}), w -> w.rank >= before and w.rank < before + n) as wanted")
        .where("size(wanted) > 0")
        .select("cid", "segment", "rows", "before", "wanted")
    )
    candidates = placed.join(F.broadcast(located), ["cid", "segment"])  # at most one row per rank and column
    within = Window.partitionBy("cid", "segment").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        candidates.withColumn("end", F.col("before") + F.sum("n").over(within))
        .selectExpr("cid", "d", "rows", "explode(filter(wanted, w -> w.rank >= end - n and w.rank < end)) as w")
        .groupBy("cid")
        .agg(F.max("rows").alias("rows"), *[F.expr(f"max(if(w.name = '{name}', d, null)) as {name}") for name in ranks])
    )


def percentiles(frequency: DataFrame, intervals: DataFrame) -> DataFrame:
    """Linearly interpolated percentiles per ``cid``; ``intervals`` are those of :data:`PERCENTILES`."""
    ranks = {}
    for name, p in PERCENTILES.items():
        ranks[f"{name}_low"] = f"cast(floor((rows - 1) * {p}D) as bigint)"
        ranks[f"{name}_high"] = f"cast(ceil((rows - 1) * {p}D) as bigint)"
    found = values_at_ranks(frequency, ranks, intervals)
    return found.selectExpr(
        "cid",
        *[
            f"{name}_low + ({name}_high - {name}_low) * ((rows - 1) * {p}D - floor((rows - 1) * {p}D)) as {name}"
            for name, p in PERCENTILES.items()
        ],
    )


def upper_medians(frequency: DataFrame, intervals: DataFrame) -> DataFrame:
    """The element at offset ``rows // 2`` of the sorted non-null values; ``intervals`` are those of :data:`MEDIAN`."""
    return values_at_ranks(frequency, {"median": "rows div 2"}, intervals).drop("rows")
