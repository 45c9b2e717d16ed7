"""Approximate percentiles: the cheap alternative for very large numeric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from colsight.functions import types as kinds
from colsight.functions.values import quoted
from colsight.operators.cells import Dataset, empty, union_all
from colsight.operators.ranks import PERCENTILES


def approximate_percentiles(data: Dataset, accuracy: int) -> DataFrame:
    """``(cid, p5, p25, median, p75, p95)`` with rank error at most ``rows / accuracy``.

    One aggregate per table over its numeric columns; nothing but sketches is shuffled.
    """
    scans = []
    for table, df in data.tables.items():
        refs = [r for r in data.of_category(kinds.NUMERIC) if r.table == table]
        if not refs:
            continue
        points = ", ".join(str(p) for p in PERCENTILES.values())
        sketches = [
            f"percentile_approx(cast({quoted(r.name)} as double), array({points}), {accuracy}) as q{r.cid}" for r in refs
        ]
        rows = []
        for r in refs:
            values = ", ".join(f"'{name}', q{r.cid}[{i}]" for i, name in enumerate(PERCENTILES))
            rows.append(f"named_struct('cid', {r.cid}, {values})")
        scans.append(df.selectExpr(*sketches).selectExpr(f"inline(array({', '.join(rows)}))"))
    if not scans:
        return empty(data.spark, "cid int, " + ", ".join(f"{name} double" for name in PERCENTILES))
    return union_all(scans)
