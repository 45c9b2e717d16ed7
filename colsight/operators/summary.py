"""Statistics that need one pass and no shuffle of the data: counts, moments, lengths, ranges."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsight.config import ProfileConfig
from colsight.functions import types as kinds
from colsight.functions.numbers import percentage
from colsight.functions.values import quoted
from colsight.operators.cells import ColumnRef, Dataset, union_all

# Output of one scan, per column; NULL where the category does not have the statistic.
_FIELDS = {
    "total_count": "bigint", "non_null_count": "bigint",
    "min": "double", "max": "double", "mean": "double", "stddev": "double", "variance": "double",
    "sum": "double", "zero_count": "bigint", "negative_count": "bigint",
    "min_length": "int", "max_length": "int", "avg_length": "double", "empty_count": "bigint",
    "true_count": "bigint", "false_count": "bigint",
    "min_text": "string", "max_text": "string", "approx_distinct": "bigint",
}
SKETCH_ERROR = 0.02  # one deviation of approx_distinct


def _aggregates(ref: ColumnRef, config: ProfileConfig) -> dict[str, str]:
    """SQL text of every aggregate of one column."""
    c = quoted(ref.name)
    d = f"cast({c} as double)"
    moment = "pop" if config.dialect.population_moments else "samp"
    count_if = "sum(if({}, 1, 0))" if config.dialect.null_counts_on_empty else "count_if({})"
    out = {"total_count": "count(1)", "non_null_count": f"count({c})"}
    if ref.category == kinds.NUMERIC:
        out |= {
            "min": f"min({c})",
            "max": f"max({c})",
            "mean": f"avg({d})",
            "stddev": f"stddev_{moment}({d})",
            "variance": f"var_{moment}({d})",
            "sum": f"sum({d})",
            "zero_count": count_if.format(f"{c} = 0"),
            "negative_count": count_if.format(f"{c} < 0"),
        }
    elif ref.category == kinds.STRING:
        out |= {
            "min_length": f"min(length({c}))",
            "max_length": f"max(length({c}))",
            "avg_length": f"avg(length({c}))",
            "empty_count": count_if.format(f"{c} = ''"),
            "approx_distinct": f"approx_count_distinct({c}, {SKETCH_ERROR})",
        }
    elif ref.category == kinds.BOOLEAN:
        out |= {"true_count": f"count_if({c})", "false_count": f"count_if(not {c})"}
    elif ref.category == kinds.TEMPORAL:
        out |= {"min_text": f"cast(min({c}) as string)", "max_text": f"cast(max({c}) as string)"}
    return out


def _wanted(ref: ColumnRef, config: ProfileConfig, fields: Collection[str]) -> dict[str, str]:
    return {name: aggregate for name, aggregate in _aggregates(ref, config).items() if name in fields}


def _scan(df: DataFrame, refs: list[ColumnRef], config: ProfileConfig, fields: Collection[str]) -> DataFrame:
    """One global aggregate over the pruned columns, turned into one row per column."""
    aggregates, rows = [], []
    for ref in refs:
        computed = _wanted(ref, config, fields)
        aggregates += [f"{aggregate} as c{ref.cid}_{name}" for name, aggregate in computed.items()]
        values = [
            f"'{name}', cast({f'c{ref.cid}_{name}' if name in computed else 'null'} as {_FIELDS[name]})" for name in fields
        ]
        rows.append(f"named_struct('cid', {ref.cid}, {', '.join(values)})")
    return df.selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(rows)}))")


def _slices(refs: list[ColumnRef], config: ProfileConfig, fields: Collection[str]) -> list[list[ColumnRef]]:
    """Consecutive columns whose aggregates together stay within ``aggregates_per_scan``.

    Columns with a sketch are kept apart: it is not compiled, nor are the aggregates beside it.
    """
    sketched = [ref for ref in refs if "approx_distinct" in _wanted(ref, config, fields)]
    if sketched and len(sketched) < len(refs):
        return _slices([ref for ref in refs if ref not in sketched], config, fields) + _slices(sketched, config, fields)
    slices: list[list[ColumnRef]] = []
    used = config.aggregates_per_scan
    for ref in refs:
        size = len(_wanted(ref, config, fields))
        if size == 0:
            continue
        if used + size > config.aggregates_per_scan:
            slices.append([])
            used = 0
        slices[-1].append(ref)
        used += size
    return slices


def summaries(data: Dataset, config: ProfileConfig, fields: Collection[str] = tuple(_FIELDS)) -> DataFrame:
    """One row per column that has any of the given fields: ``cid`` and those fields.

    A table is read in slices of columns. The slices of a columnar source together read it once,
    and each aggregate stays small enough for the JVM to compile: one aggregate over a whole wide
    table becomes a method too large for the JIT and runs several times slower.
    """
    return union_all(
        _scan(df, refs, config, fields)
        for table, df in data.tables.items()
        for refs in _slices([ref for ref in data.columns if ref.table == table], config, fields)
    )


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table_name, row_count)``; on parquet the count comes from the file footers."""
    return union_all(
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(table).alias("table_name"), "row_count")
        for table, df in tables.items()
    )


def common_counts(summary: DataFrame, distinct: DataFrame) -> DataFrame:
    """Null and distinct counts with their percentages of all rows."""
    # Both sides hold one row per profiled column.
    joined = summary.join(F.broadcast(distinct), "cid", "left")
    total = F.col("total_count")
    nulls = total - F.col("non_null_count")
    distinct_count = F.coalesce("distinct_count", F.lit(0))
    return joined.withColumns(
        {
            "distinct_count": distinct_count,
            "null_count": nulls,
            "null_percentage": percentage(nulls, total),
            "distinct_percentage": percentage(distinct_count, total),
        }
    )


def true_percentage() -> Column:
    """Share of true among true and false; nulls do not count, NULL for other categories."""
    share = percentage(F.col("true_count"), F.col("true_count") + F.col("false_count"))
    return F.when(F.col("true_count").isNotNull(), share)
