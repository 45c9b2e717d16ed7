"""Random sample rows and the sample values of each column."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsight.functions.rows import constant_rows
from colsight.functions.values import column, json_safe_text


def random_rows(df: DataFrame, size: int, seed: int) -> DataFrame:
    """``size`` rows drawn uniformly without replacement.

    Each task keeps its ``size`` smallest random numbers and only those are merged, so no sort of
    the table takes place.
    """
    return df.orderBy(F.rand(seed)).limit(size)


_WHERE = {"_file": "_metadata.file_path", "_row": "_metadata.row_index"}


_ROW_FOR_ROW = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation", "Relation"}


def _is_plain_scan(df: DataFrame) -> bool:
    """Whether the plan only projects and filters one source, so that a row of it is a row of a file."""
    waiting = [df._jdf.queryExecution().analyzed()]
    while waiting:
        node = waiting.pop()
        if node.nodeName().split(" ")[0] not in _ROW_FOR_ROW or node.children().size() > 1:
            return False
        waiting += [node.children().apply(i) for i in range(node.children().size())]
    return True


def has_row_positions(df: DataFrame) -> bool:
    """Whether the rows of ``df`` can be addressed by file and position, as those of Parquet can."""
    if not _is_plain_scan(df):
        return False
    try:
        df.selectExpr(*_WHERE.values())
    except AnalysisException:
        return False
    return True


def random_file_rows(df: DataFrame, size: int, seed: int) -> DataFrame:
    """``size`` uniform rows of a Parquet table with ``_draw``, reading only the files they lie in.

    The draw sees row positions alone, which need no column data; then the rows are fetched from
    the at most ``size`` files that hold them.
    """
    positions = df.selectExpr(*[f"{path} as {name}" for name, path in _WHERE.items()])
    drawn = random_rows(positions, size, seed).collect()  # at most 1000 positions
    rows = [(place, row["_file"], row["_row"]) for place, row in enumerate(drawn)]
    wanted = constant_rows(df.sparkSession, rows, "_draw int, _file string, _row bigint")
    files = sorted({row["_file"] for row in drawn})
    located = df.where(F.col("_metadata.file_path").isin(files)).selectExpr(
        "*", *[f"{path} as {name}" for name, path in _WHERE.items()]
    )
    return located.join(F.broadcast(wanted), ["_file", "_row"]).drop("_file", "_row")


def draw(df: DataFrame, size: int, seed: int) -> DataFrame:
    """``size`` random rows with ``_draw``, a number that orders them."""
    if has_row_positions(df):
        return random_file_rows(df, size, seed)
    return df.select(F.rand(seed).alias("_draw"), "*").orderBy("_draw").limit(size)


def column_values(df: DataFrame, size: int, seed: int) -> DataFrame:
    """``(ordinal, column_name, sample_values)`` over one draw of rows: NULLs and row order kept."""
    cells = []
    for ordinal, field in enumerate(df.schema.fields, start=1):
        cells += [F.lit(ordinal), F.lit(field.name), json_safe_text(column(field.name), field.dataType)]
    stacked = F.stack(F.lit(len(df.schema.fields)), *cells).alias("ordinal", "column_name", "value")
    # A struct keeps NULL values in the list; the list has at most `size` entries.
    ordered = F.array_sort(F.collect_list(F.struct("_draw", "value")))
    values = F.transform(ordered, lambda e: e["value"])
    return draw(df, size, seed).select("_draw", stacked).groupBy("ordinal", "column_name").agg(values.alias("sample_values"))


def json_safe_rows(rows: DataFrame) -> DataFrame:
    """Every column as its JSON-safe text."""
    return rows.select(
        *[json_safe_text(column(f.name), f.dataType).alias(f.name) for f in rows.schema.fields]
    )
