"""The statistics of every column of a set of tables, as one plan."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from datetime import date

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.config import ProfileConfig
from colsight.functions import types as kinds
from colsight.functions.rows import table_key
from colsight.operators import topvalues
from colsight.operators.approx import approximate_percentiles
from colsight.operators.cells import Dataset, column_frame, frequencies, numeric_frequencies
from colsight.operators.distinct import bitmap_counts, dense_columns, distinct_counts
from colsight.operators.outliers import with_outlier_counts
from colsight.operators.ranks import MEDIAN, PERCENTILES, percentiles, rank_intervals, upper_medians
from colsight.operators.summary import common_counts, summaries, true_percentage
from colsight.sources.staging import columnar

NUMERIC_FIELDS = (
    "min", "max", "mean", "median", "stddev", "variance", "sum", "p5", "p25", "p75", "p95",
    "zero_count", "negative_count", "outlier_count",
)
STRING_FIELDS = ("min_length", "max_length", "avg_length", "empty_count")
BOOLEAN_FIELDS = ("true_count", "false_count", "true_percentage")
COMMON_FIELDS = ("total_count", "non_null_count", "null_count", "null_percentage", "distinct_count", "distinct_percentage")


def _few_days(known: Row | None) -> bool:
    """Whether the first and last date of a column are less than so many days apart as it has values."""
    if known is None or known.min_text is None:
        return False
    try:
        first, last = (date.fromisoformat(text[:10]) for text in (known.min_text, known.max_text))
    except ValueError:  # times of day, intervals, years beyond four digits
        return False
    return (last - first).days < known.non_null_count


def column_profile(
    tables: Mapping[str, DataFrame],
    config: ProfileConfig | None = None,
    enum_columns: Collection[tuple[str, str]] = (),
) -> DataFrame:
    """One row per (table, column) with all statistics of the column's category.

    Work on the data: one pruned aggregate per table, a sketch of ranks, one shuffle of distinct values per value
    type, and the top values of low-cardinality text. Everything joined here is one row per column. The aggregate runs when
    the plan is made: its sketches rule text columns out of the top values before any text is read for them, and its ranges
    choose the days that are counted as bits.
    """
    config = config or ProfileConfig()
    data = Dataset.of(tables)
    summary = columnar(summaries(data, config))
    known = {r.cid: r for r in summary.select("cid", "non_null_count", "min_text", "max_text", "approx_distinct").collect()}  # one row per column
    days = dense_columns(data, [r for r in data.of_category(kinds.TEMPORAL) if _few_days(known.get(r.cid))])
    frequency = frequencies(data, [r for r in data.columns if r not in days])
    # Numbers are read five times: for distinct counts, ranks (twice), outliers and top values.
    frequency = {t: columnar(df) if isinstance(t, T.NumericType) else df for t, df in frequency.items()}
    numbers = numeric_frequencies(frequency, data.spark)
    distinct = distinct_counts(frequency, data.spark)
    if days:
        distinct = distinct.unionAll(bitmap_counts(data, days))
    profile = column_frame(data).join(F.broadcast(common_counts(summary, distinct)), "cid")

    mode = config.dialect.percentile_mode
    if mode == "upper_median":
        ranked = upper_medians(numbers, rank_intervals(data, MEDIAN, config.rank_sketch))
    elif mode == "approx":
        ranked = with_outlier_counts(numbers, approximate_percentiles(data, config.approx_accuracy))
    else:
        ranked = with_outlier_counts(numbers, percentiles(numbers, rank_intervals(data, PERCENTILES, config.rank_sketch)))
    profile = profile.join(F.broadcast(ranked), "cid", "left")
    absent = {name: F.lit(None).cast("double") for name in PERCENTILES} | {"outlier_count": F.lit(None).cast("bigint")}
    profile = profile.withColumns({name: null for name, null in absent.items() if name not in ranked.columns})

    gate = topvalues.passes_gate(data, config, enum_columns)
    texts = topvalues.text_candidates(data, {cid: r.approx_distinct for cid, r in known.items()}, config, enum_columns)
    values = topvalues.value_counts(data, frequency, distinct.where(gate), texts)
    entries = topvalues.top_value_entries(topvalues.top_values(values, config.top_values_limit))
    profile = profile.join(entries, "cid", "left").withColumns(
        {
            "top_values": F.when(gate, topvalues.as_top_values(F.col("entries"), F.col("total_count"))),
            "true_percentage": true_percentage(),
        }
    )
    return profile.select(
        "table_name", "ordinal", "column_name", "data_type", "category",
        *COMMON_FIELDS, *NUMERIC_FIELDS, *STRING_FIELDS, *BOOLEAN_FIELDS, "min_text", "max_text", "top_values",
    )


def column_statistics(profile: DataFrame) -> DataFrame:
    """The profile with each category's statistics in its own struct, NULL for the other categories."""

    def part(category: str, *fields: F.Column) -> F.Column:
        return F.when(F.col("category") == category, F.struct(*fields))

    temporal = (F.col("min_text").alias("min"), F.col("max_text").alias("max"))
    statistics = F.struct(
        *[c for c in COMMON_FIELDS if c != "non_null_count"],
        part(kinds.NUMERIC, *NUMERIC_FIELDS).alias("numeric"),
        part(kinds.STRING, *STRING_FIELDS).alias("string"),
        part(kinds.BOOLEAN, *BOOLEAN_FIELDS).alias("boolean"),
        part(kinds.TEMPORAL, *temporal).alias("temporal"),
        "top_values",
    )
    return profile.select(*table_key(profile), "ordinal", "column_name", "data_type", statistics.alias("statistics"))
