"""Column statistics over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from colsight.config import ProfileConfig, dialect
from colsight.functions import types as kinds
from colsight.operators import summary, topvalues
from colsight.operators.approx import approximate_percentiles
from colsight.operators.cells import Dataset, column_frame, frequencies, numeric_frequencies
from colsight.operators.distinct import distinct_counts, distinct_counts_of
from colsight.operators.outliers import with_outlier_counts
from colsight.operators.ranks import MEDIAN, PERCENTILES, percentiles, rank_intervals, upper_medians
from colsight.plans.column_profile import column_profile, column_statistics
from colsight.plans.dataset import isolated_profile
from suite.tables import NAMES, gap_ctes, gap_views, load, per_column

SKETCH = ProfileConfig().rank_sketch


def named(data: Dataset, frame: DataFrame, *columns: str | F.Column) -> DataFrame:
    """Statistics with table and column name in place of the column number."""
    return column_frame(data).join(F.broadcast(frame), "cid").select("table_name", "column_name", *columns)


def views(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset.of(gap_views(spark, sf_dir))


def numbers(data: Dataset) -> DataFrame:
    return numeric_frequencies(frequencies(data, data.of_category(kinds.NUMERIC)), data.spark)


def rounded(name: str, digits: int = 4) -> F.Column:
    return F.round(name, digits).alias(name)


def st_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.row_counts({name: load(spark, sf_dir, name) for name in NAMES})


def st_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category of every column, with the number of values it classifies."""
    data = views(spark, sf_dir)
    counted = summary.summaries(data, ProfileConfig(), ["non_null_count"])
    by_type = column_frame(data).join(F.broadcast(counted), "cid")
    return by_type.select(
        "table_name", "column_name", kinds.category_of_name(F.col("data_type")).alias("category"), "non_null_count"
    )


def st_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = views(spark, sf_dir)
    scanned = summary.summaries(data, ProfileConfig(), ["total_count", "non_null_count"])
    counts = summary.common_counts(scanned, distinct_counts_of(data))
    return named(data, counts, "total_count", "null_count", "null_percentage", "distinct_count", "distinct_percentage")


def _category_summary(spark: SparkSession, sf_dir: str, category: str, fields: list[str], engine: str = "postgres") -> DataFrame:
    data = views(spark, sf_dir)
    scanned = summary.summaries(data, ProfileConfig(dialect=dialect(engine)), fields)
    wanted = [ref.cid for ref in data.of_category(category)]
    return named(data, scanned.where(F.col("cid").isin(wanted)), *fields)


def st_numeric_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["min", "max", "mean", "stddev", "variance", "sum"]
    frame = _category_summary(spark, sf_dir, kinds.NUMERIC, fields)
    return frame.withColumns(
        {"mean": rounded("mean"), "stddev": rounded("stddev"), "variance": rounded("variance", 0), "sum": rounded("sum", 0)}
    )


def st_zero_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero and negative counts of full tables and of an empty selection, in both conventions."""
    fields = ["zero_count", "negative_count"]
    full = _category_summary(spark, sf_dir, kinds.NUMERIC, fields).withColumn("source", F.lit("full"))
    # No row has a negative line number, so the selection reads the table and keeps nothing.
    none = load(spark, sf_dir, "lineitem").where("l_linenumber < 0").select("l_quantity")
    data = Dataset.of({"lineitem": none})
    parts = [full]
    for engine in ("postgres", "redshift"):
        scanned = summary.summaries(data, ProfileConfig(dialect=dialect(engine)), fields)
        parts.append(named(data, scanned, *fields).withColumn("source", F.lit(engine)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def st_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = views(spark, sf_dir)
    return named(data, percentiles(numbers(data), rank_intervals(data, PERCENTILES, SKETCH)), *[rounded(p) for p in ("p5", "p25", "median", "p75", "p95")])


def st_percentiles_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns with few distinct values, where the sketch is exact."""
    lines = load(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity", "l_discount", "l_tax")
    data = Dataset.of({"lineitem": lines})
    return named(data, approximate_percentiles(data, 10_000), "p5", "p25", "median", "p75", "p95")


def st_percentiles_rank_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate percentiles of every numeric column, checked: is the share of values below each within 1/1000?"""
    lines = load(spark, sf_dir, "lineitem")
    data = Dataset.of({"lineitem": lines})
    points = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    found = named(data, approximate_percentiles(data, 10_000), *points).collect()  # one row for each column

    def near(row: Row, name: str) -> F.Column:
        at, n = F.col(row.column_name), F.count(row.column_name)
        below, upto = F.count_if(at < row[name]) / n, F.count_if(at <= row[name]) / n
        return ((below <= points[name] + 0.001) & (upto >= points[name] - 0.001)).alias(name)

    checks = [F.struct(F.lit(r.column_name).alias("column_name"), *[near(r, name) for name in points]) for r in found]
    return lines.agg(F.array(*checks).alias("checks")).select(F.inline("checks"))


def st_median_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = views(spark, sf_dir)
    return named(data, upper_medians(numbers(data), rank_intervals(data, MEDIAN, SKETCH)), "median")


def st_pop_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _category_summary(spark, sf_dir, kinds.NUMERIC, ["stddev", "variance"], "mysql")
    return frame.withColumns({"stddev": rounded("stddev"), "variance": rounded("variance", 0)})


def st_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["min_length", "max_length", "avg_length", "empty_count"]
    data = Dataset.of(
        gap_views(spark, sf_dir)
        | {"documents": load(spark, sf_dir, "documents").select("text", "lang", "source")}
        | {"pages": load(spark, sf_dir, "pages").select("url", "html")}
    )
    scanned = summary.summaries(data, ProfileConfig(), fields)
    wanted = [ref.cid for ref in data.of_category(kinds.STRING)]
    frame = named(data, scanned.where(F.col("cid").isin(wanted)), *fields)
    return frame.withColumn("avg_length", rounded("avg_length"))


def st_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _category_summary(spark, sf_dir, kinds.BOOLEAN, ["true_count", "false_count"])
    return frame.withColumn("true_percentage", summary.true_percentage())


def st_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = Dataset.of(gap_views(spark, sf_dir) | {"events": load(spark, sf_dir, "events").select("ts")})
    scanned = summary.summaries(data, ProfileConfig(), ["min_text", "max_text"])
    wanted = [ref.cid for ref in data.of_category(kinds.TEMPORAL)]
    return named(data, scanned.where(F.col("cid").isin(wanted)), "min_text", "max_text")


def st_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five most frequent values of every text column of the views, whatever its cardinality."""
    data = views(spark, sf_dir)
    texts = column_frame(data).where(F.col("category") == kinds.STRING).select("cid")
    top = topvalues.top_values(topvalues.value_counts(data, {}, texts), 5)
    totals = summary.summaries(data, ProfileConfig(), ["total_count"])
    share = topvalues.percentage(F.col("n"), F.col("total_count"))
    joined = top.join(F.broadcast(totals), "cid")
    return named(data, joined, "rank", "value", "n", share.alias("percentage"))


def st_top_values_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top values of the columns that the default gate lets through."""
    config = ProfileConfig()
    data = views(spark, sf_dir)
    frequency = frequencies(data, data.columns)
    gated = distinct_counts(frequency, spark).where(topvalues.passes_gate(data, config))
    sketched = summary.summaries(data, config, ["approx_distinct"]).where("approx_distinct is not null").collect()  # one row per column
    texts = topvalues.text_candidates(data, {r.cid: r.approx_distinct for r in sketched}, config)
    top = topvalues.top_values(topvalues.value_counts(data, frequency, gated, texts), config.top_values_limit)
    return named(data, top, "rank", "value", "n")


def st_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = views(spark, sf_dir)
    values = numbers(data)
    ranked = percentiles(values, rank_intervals(data, PERCENTILES, SKETCH))
    return named(data, with_outlier_counts(values, ranked), "outlier_count")


def flat_profile(profile: DataFrame) -> DataFrame:
    """A column profile with rounded floats and the top values joined to text."""
    floats = {"mean": 4, "stddev": 4, "variance": 0, "sum": 0, "avg_length": 4}
    floats |= {p: 4 for p in ("p5", "p25", "median", "p75", "p95")}
    top = F.array_join(F.transform("top_values", lambda e: F.concat_ws("=", e["value"], e["count"].cast("string"))), ";")
    return (
        profile.withColumns({name: rounded(name, digits) for name, digits in floats.items()})
        .withColumn("top_values", top)
        .drop("ordinal", "data_type")
    )


def st_column_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = column_statistics(column_profile(gap_views(spark, sf_dir)))
    s = "statistics."
    top = F.array_join(
        F.transform(s + "top_values", lambda e: F.concat_ws("=", e["value"], e["count"].cast("string"))), ";"
    )
    return nested.select(
        "table_name", "column_name",
        *[s + c for c in ("total_count", "null_count", "null_percentage", "distinct_count", "distinct_percentage")],
        F.round(s + "numeric.mean", 4).alias("mean"), F.round(s + "numeric.median", 4).alias("median"),
        F.col(s + "numeric.zero_count"), F.col(s + "numeric.outlier_count"),
        F.col(s + "string.max_length"), F.col(s + "boolean.true_percentage"), F.col(s + "temporal.max").alias("max_text"),
        top.alias("top_values"),
    )


def st_failure_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that cannot be planned, and one that fails while it is read: the latter keeps its columns, the others all."""
    tables = {name: load(spark, sf_dir, name) for name in ("orders", "customer")}
    broken = {
        "lineitem": lambda: load(spark, sf_dir, "lineitem").select("no_such_column"),
        "part": lambda: load(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 0, F.raise_error("damaged")).alias("p_name")),
    }
    return isolated_profile({**{n: (lambda df=df: df) for n, df in tables.items()}, **broken}).select(
        "table_name", "column_name", "total_count", "distinct_count", "failed"
    )


def st_other_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of columns whose type has no comparable form of its own."""
    data = Dataset.of(
        {
            "embeddings": load(spark, sf_dir, "embeddings").select("embedding"),
            "events": load(spark, sf_dir, "events").select(F.parse_json("props").alias("props")),
        }
    )
    return named(data, distinct_counts(frequencies(data, data.columns), spark), "distinct_count")


QUERIES = {
    f.__name__: f
    for f in (
        st_row_count, st_classify, st_common, st_numeric_basic, st_zero_negative, st_percentiles,
        st_percentiles_approx, st_percentiles_rank_error, st_median_upper, st_pop_dialect, st_string, st_boolean, st_temporal,
        st_top_values, st_top_values_gate, st_outliers, st_column_statistics, st_failure_isolation,
        st_other_distinct,
    )
}

_WHO = "'{t}' as table_name, '{c}' as column_name"
_COMMON = """count(*) as total_count, count(*) - count({c}) as null_count,
    round((count(*) - count({c})) * 100.0::double / count(*), 2) as null_percentage,
    count(distinct {c}) as distinct_count, round(count(distinct {c}) * 100.0::double / count(*), 2) as distinct_percentage"""
_QUANTILES = ", ".join(
    f"round(quantile_cont({{c}}::double, {p}), 4) as {n}"
    for n, p in {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}.items()
)
_TOP = """select '{t}' as table_name, '{c}' as column_name, rank, value, n, total from (
    select {c}::varchar as value, count(*) as n, (select count(*) from {view}) as total, count(*) over () as d,
        row_number() over (order by count(*) desc, {c}::varchar)::int as rank
    from {view} where {c} is not null group by {c})"""
_TOP_TEXT = """(select coalesce(string_agg(value || '=' || n, ';' order by n desc, value), '') from
    (select {c}::varchar as value, count(*) as n from {view} where {c} is not null group by {c} order by n desc, value limit 10))"""


def _fences(column: str, view: str) -> str:
    return (
        f"(select count(*) from {view}, (select quantile_cont({column}::double, 0.25) as q1, quantile_cont({column}::double, 0.75) as q3 from {view})"
        f" where {column} < q1 - 1.5 * (q3 - q1) or {column} > q3 + 1.5 * (q3 - q1))"
    )


def _statistics_sql() -> str:
    from suite.tables import CATEGORIES

    parts = []
    for table, columns in CATEGORIES.items():
        for name, category in columns.items():
            numeric, text = category == "numeric", category == "string"
            view = f"{table}_gaps"
            pick = lambda on, sql, kind: f"{sql}::{kind}" if on else f"null::{kind}"
            gated = category == "boolean" or ((numeric or text) and "GATE")
            top = _TOP_TEXT.format(c=name, view=view)
            if gated == "GATE":
                top = f"case when count(distinct {name}) <= 100 then {top} end"
            elif not gated:
                top = "null::varchar"
            truths = f"round(count(*) filter ({name}) * 100.0::double / count({name}), 2)"
            parts.append(
                f"select '{table}' as table_name, '{name}' as column_name, {_COMMON.format(c=name)}, "
                + ", ".join(
                    [
                        pick(numeric, f"round(avg({name}), 4)", "double") + " as mean",
                        pick(numeric, f"round(quantile_cont({name}::double, 0.5), 4)", "double") + " as median",
                        pick(numeric, f"count(*) filter ({name} = 0)", "bigint") + " as zero_count",
                        pick(numeric, _fences(name, view), "bigint") + " as outlier_count",
                        pick(text, f"max(length({name}))", "int") + " as max_length",
                        pick(category == "boolean", truths, "double") + " as true_percentage",
                        pick(category == "temporal", f"max({name})::varchar", "varchar") + " as max_text",
                        f"{top} as top_values",
                    ]
                )
                + f" from {view}"
            )
    return gap_ctes() + "\n" + "\nunion all\n".join(parts)


def _kinds_sql() -> str:
    from suite.tables import CATEGORIES

    return gap_ctes() + "\n" + "\nunion all\n".join(
        f"select '{t}' as table_name, '{c}' as column_name, '{kind}' as category, count({c}) as non_null_count from {t}_gaps"
        for t, columns in CATEGORIES.items()
        for c, kind in columns.items()
    )


_LENGTHS = """min(length({c}))::int as min_length, max(length({c}))::int as max_length,
    round(avg(length({c})), 4) as avg_length, count(*) filter ({c} = '') as empty_count"""
_SIGNS = "count(*) filter ({c} = 0) as zero_count, count(*) filter ({c} < 0) as negative_count"

ORACLE = {
    "st_row_count": " union all ".join(f"select '{n}' as table_name, count(*) as row_count from {n}" for n in NAMES),
    "st_classify": _kinds_sql(),
    "st_common": per_column(f"select {_WHO}, {_COMMON} from {{view}}"),
    "st_numeric_basic": per_column(
        f"select {_WHO}, min({{c}})::double as min, max({{c}})::double as max, round(avg({{c}}), 4) as mean, "
        "round(stddev_samp({c}), 4) as stddev, round(var_samp({c}), 0) as variance, round(sum({c}::double), 0) as sum from {view}",
        "numeric",
    ),
    "st_zero_negative": per_column(f"select {_WHO}, {_SIGNS}, 'full' as source from {{view}}", "numeric")
    + " union all select 'lineitem', 'l_quantity', 0, 0, 'postgres' union all select 'lineitem', 'l_quantity', null, null, 'redshift'",
    "st_percentiles": per_column(f"select {_WHO}, {_QUANTILES} from {{view}}", "numeric"),
    "st_percentiles_rank_error": "select unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', "
    "'l_discount', 'l_tax']) as column_name, true as p5, true as p25, true as median, true as p75, true as p95 from (select 1 from lineitem limit 1)",
    "st_percentiles_approx": " union all ".join(
        f"select 'lineitem' as table_name, '{c}' as column_name, "
        + ", ".join(
            f"quantile_disc({c}::double, {p}) as {n}"
            for n, p in {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}.items()
        )
        + " from lineitem"
        for c in ("l_linenumber", "l_quantity", "l_discount", "l_tax")
    ),
    "st_median_upper": per_column(
        f"select {_WHO}, median from (select {{c}}::double as median, row_number() over (order by {{c}}) - 1 as position,"
        " (count(*) over ()) // 2 as half from {view} where {c} is not null) where position = half",
        "numeric",
    ),
    "st_pop_dialect": per_column(
        f"select {_WHO}, round(stddev_pop({{c}}), 4) as stddev, round(var_pop({{c}}), 0) as variance from {{view}}", "numeric"
    ),
    "st_string": per_column(f"select {_WHO}, {_LENGTHS} from {{view}}", "string")
    + "".join(
        f" union all select '{t}', '{c}', {_LENGTHS.format(c=c)} from {t}"
        for t, c in (("documents", "text"), ("documents", "lang"), ("documents", "source"), ("pages", "url"), ("pages", "html"))
    ),
    "st_boolean": per_column(
        f"select {_WHO}, count(*) filter ({{c}}) as true_count, count(*) filter (not {{c}}) as false_count, "
        "round(count(*) filter ({c}) * 100.0::double / count({c}), 2) as true_percentage from {view}",
        "boolean",
    ),
    "st_temporal": per_column(
        f"select {_WHO}, min({{c}})::varchar as min_text, max({{c}})::varchar as max_text from {{view}}", "temporal"
    )
    + " union all select 'events', 'ts', min(ts)::varchar, max(ts)::varchar from events",
    "st_top_values": per_column(
        f"select table_name, column_name, rank, value, n, round(n * 100.0::double / total, 2) as percentage from ({_TOP}) where rank <= 5",
        "string",
    ),
    "st_top_values_gate": per_column(
        f"select table_name, column_name, rank, value, n from ({_TOP.replace('n, total from', 'n, d from')}) where rank <= 10 and d <= 100",
        "string", "numeric", "boolean",
    ),
    "st_outliers": per_column(f"select {_WHO}, {_fences('{c}', '{view}')} as outlier_count", "numeric"),
    "st_column_statistics": _statistics_sql(),
    "st_failure_isolation": " union all ".join(
        f"select '{t}' as table_name, '{c}' as column_name, count(*) as total_count, count(distinct {c}) as distinct_count, false as failed from {t}"
        for t, columns in {
            "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
            "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
        }.items()
        for c in columns.split()
    )
    + " union all select 'lineitem', null, null, null, true union all select 'part', unnest(['p_partkey', 'p_name']), null, null, true",
    "st_other_distinct": "select 'embeddings' as table_name, 'embedding' as column_name, count(distinct embedding) as distinct_count from embeddings"
    " union all select 'events', 'props', count(distinct props::json::varchar) from events",
}
