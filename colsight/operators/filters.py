"""Which columns make good analytical filters: signals, scores, triage, and the judge's verdicts.

Every function takes and returns one row per (table, column); nothing here touches table data. Frames that carry
``schema_name`` beside ``table_name`` are matched by both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsight.functions import types as kinds
from colsight.functions.rows import table_key

# Thresholds, weights, type lists and name patterns of the scoring rules.
SMALL_REFERENCED_TABLE = 500
FACT_ROWS, DIMENSION_ROWS = 10_000, 5_000
CARDINALITY_SCORES = {
    "constant": 0.0, "boolean": 0.85, "low_categorical": 0.95, "high_categorical": 0.70,
    "high_cardinality": 0.30, "near_unique": 0.05,
}
WEIGHTS = {"schema_score": 0.35, "cardinality_score": 0.30, "dtype_score": 0.20, "naming_score": 0.15}
ACCEPT_ABOVE, REJECT_BELOW, INCLUDE_FROM = 0.85, 0.15, 0.50
TEMPORAL_TYPES = (
    "date", "time", "timestamp", "datetime", "year", "timestamp with time zone", "timestamp without time zone",
    "timestamp_ntz", "timestamp_ltz", "timestamp_tz", "timestamptz", "timetz",
)
BOOLEAN_TYPES = ("boolean", "bool")
TEXT_TYPES = (
    "character varying", "varchar", "character", "char", "text", "name", "citext", "bpchar", "tinytext",
    "mediumtext", "longtext", "string",
)
FLOAT_TYPES = (
    "float", "double", "double precision", "real", "decimal", "numeric", "money", "bignumeric", "float64",
)
INTEGER_TYPES = (
    "smallint", "integer", "bigint", "int", "serial", "tinyint", "mediumint", "int64", "long", "short", "byte",
    "hugeint", "uhugeint", "ubigint", "uinteger", "usmallint", "utinyint",
)
RANGE_TYPES = ("integer", "int", "bigint", "smallint", "float", "double", "decimal", "numeric", "real")
AUDIT_NAME = (
    r"(?i)^(?:created|updated|modified|inserted|deleted)_(?:at|on|date|time|timestamp)$|^last_login$|_timestamp$"
)
ANTI_FILTER_NAME = r"(?i)_(?:description|notes|comment|text|blob|json|xml|hash|token|uuid)$"
ID_OR_NAME = r"(?i)_id$|^id$|_name$|^name$"
TEMPORAL_NAME = r"(?i)_(?:date|time|at|on|year|month|quarter|week)$|^(?:date|time|fiscal)_"
FILTER_NAME = (
    r"(?i)_(?:status|type|category|code|class|group|tier|level|flag|mode|state|region|country|city|department|channel)$"
    r"|^(?:is|has)_"
)
ISO_CODE_VALUE = r"^[A-Z]{2,3}\n?\z"
CODE_VALUE = r"^[A-Z0-9_\-]{2,5}\n?\z"
IDENTIFIER_VALUE = r"(?i)^[A-Z]{2,5}[-_]\p{Nd}"
LONG_VALUE, SHORT_AVERAGE = 30, 25

# ── Schema signals ────────────────────────────────────────────────────────────


def index_signals(indexes: DataFrame) -> DataFrame:
    """``(table_name, column_name, is_non_unique_index, composite_partners)`` from non-primary indexes.

    ``indexes`` holds ``table_name, index_name, columns, is_unique, is_primary``. Partners are the
    other columns of the same index, in first-seen order over the indexes by name.
    """
    key = table_key(indexes)
    member = indexes.where(~F.col("is_primary")).select(
        *key, "index_name", (~F.col("is_unique")).alias("non_unique"), "columns", F.explode("columns").alias("column_name")
    )
    partners = F.expr("filter(columns, c -> c <> column_name)")
    ordered = F.array_sort(F.collect_list(F.struct("index_name", partners.alias("partners"))))
    return member.groupBy(*key, "column_name").agg(
        F.max("non_unique").alias("is_non_unique_index"),
        F.array_distinct(F.flatten(F.transform(ordered, lambda e: e["partners"]))).alias("composite_partners"),
    )


def schema_signals(
    columns: DataFrame,
    relationships: DataFrame,
    indexes: DataFrame,
    row_counts: DataFrame | None = None,
    estimates: DataFrame | None = None,
) -> DataFrame:
    """Key, index and enum signals added to ``columns(table_name, column_name, is_primary_key, enum_values)``.

    ``relationships`` holds ``table_name, constraint_name, from_column, to_schema, to_table``; of
    several on one column the last constraint by name counts. With ``row_counts`` the result has ``fk_referenced_rows`` as
    well: they are looked up for the foreign keys, before these meet the columns.
    """
    keys = columns.where("is_primary_key").groupBy(*table_key(columns)).agg(F.count(F.lit(1)).cast("int").alias("pk_size"))
    target = F.concat_ws(".", "to_schema", "to_table")
    foreign = relationships.groupBy(*table_key(relationships), F.col("from_column").alias("column_name")).agg(
        F.max_by(target, "constraint_name").alias("fk_referenced_table")
    )
    if row_counts is not None:
        foreign = with_referenced_rows(foreign, row_counts, estimates)
    pk_size = F.when(F.col("is_primary_key"), F.col("pk_size")).otherwise(0)
    return (
        columns.join(keys, table_key(columns), "left")
        .join(foreign, table_key(columns, foreign, column=True), "left")
        .join(index_signals(indexes), table_key(columns, indexes, column=True), "left")
        .withColumns(
            {
                "pk_column_count": pk_size,
                "is_composite_pk_member": pk_size > 1,
                "is_foreign_key": F.col("fk_referenced_table").isNotNull(),
                "is_non_unique_index": F.coalesce("is_non_unique_index", F.lit(False)),
                "composite_partners": F.coalesce("composite_partners", F.array().cast("array<string>")),
                "has_enum_type": F.coalesce(F.size("enum_values") > 0, F.lit(False)),
            }
        )
        .drop("pk_size")
    )


def with_referenced_rows(signals: DataFrame, row_counts: DataFrame, estimates: DataFrame | None = None) -> DataFrame:
    """Adds ``fk_referenced_rows``: the profiled row count of the referenced table, else the estimate.

    Both inputs hold ``schema_name, table_name, row_count``. A profiled table with an unknown count
    stays unknown.
    """

    # Columns without a foreign key match nothing; a key of their own spreads them, where NULL would gather them all in one task. It is one key
    # with a mark in front: a second, constant one is taken out of the join's keys by the optimizer.
    own = F.concat(F.lit("-"), F.xxhash64(*table_key(signals), "column_name").cast("string"))
    target = F.concat(F.lit("+"), "fk_referenced_table")
    signals = signals.withColumn("_target", F.coalesce(target, own))

    def keyed(frame: DataFrame, count: str, seen: str) -> DataFrame:
        target = F.concat(F.lit("+"), F.concat_ws(".", "schema_name", "table_name")).alias("_target")
        return frame.select(target, F.col("row_count").alias(count), F.lit(True).alias(seen))

    joined = signals.join(keyed(row_counts, "_profiled", "_known"), "_target", "left")
    if estimates is None:
        rows, extra = F.col("_profiled"), ["_profiled", "_known"]
    else:
        joined = joined.join(keyed(estimates, "_estimated", "_guessed"), "_target", "left")
        rows = F.when(F.col("_known"), F.col("_profiled")).otherwise(F.col("_estimated"))
        extra = ["_profiled", "_known", "_estimated", "_guessed"]
    return joined.withColumn("fk_referenced_rows", rows).drop("_target", *extra)


def schema_score() -> Column:
    """The strongest schema signal; 0.0 without one. NULL flags count as absent."""

    def signal(condition: Column, score: float | Column) -> Column:
        return F.when(condition, score)

    small = F.col("fk_referenced_rows") < SMALL_REFERENCED_TABLE
    strongest = F.greatest(
        signal(F.col("has_check_constraint") | F.col("has_enum_type"), 0.95),
        signal(F.col("is_foreign_key"), F.when(small, 0.9).otherwise(0.6)),
        signal(F.col("is_non_unique_index"), 0.7),
        signal(F.size("composite_partners") > 0, 0.5),
        signal(F.col("is_primary_key") & (F.col("pk_column_count") == 1), 0.05),
    )
    return F.coalesce(strongest, F.lit(0.0))


def table_roles(columns: DataFrame, row_counts: DataFrame, relationships: DataFrame) -> DataFrame:
    """``(table_name, table_role)``: fact, dimension or unknown."""
    category = kinds.category_of_name(F.col("data_type"))
    shapes = columns.groupBy(*table_key(columns)).agg(
        F.count_if(category == kinds.NUMERIC).alias("numbers"), F.count_if(category == kinds.STRING).alias("texts")
    )
    links = relationships.groupBy(*table_key(relationships)).agg(F.count(F.lit(1)).alias("links"))
    joined = shapes.join(row_counts, table_key(shapes, row_counts), "left").join(links, table_key(shapes, links), "left")
    rows, fks = F.coalesce("row_count", F.lit(0)), F.coalesce("links", F.lit(0))
    role = (
        F.when((rows > FACT_ROWS) & (fks >= 2) & (F.col("numbers") >= 2), "fact")
        .when((rows < DIMENSION_ROWS) & (fks == 0) & (F.col("texts") >= 2), "dimension")
        .otherwise("unknown")
    )
    return joined.select(*table_key(shapes), role.alias("table_role"))


# ── Statistical signals ───────────────────────────────────────────────────────


def cardinality_bucket(distinct: Column, rows: Column) -> Column:
    return (
        F.when((rows == 0) | (distinct <= 1), "constant")
        .when(distinct == 2, "boolean")
        .when(distinct <= 50, "low_categorical")
        .when(distinct <= 500, "high_categorical")
        .when((distinct <= 10_000) | (distinct <= rows * 0.10), "high_cardinality")
        .otherwise("near_unique")
    )


def cardinality_score(bucket: Column) -> Column:
    score = F.lit(0.05)
    for name, value in CARDINALITY_SCORES.items():
        score = F.when(bucket == name, value).otherwise(score)
    return score


def bare_type(data_type: Column) -> Column:
    """Lower-case type name without anything in parentheses."""
    return F.trim(F.regexp_replace(F.trim(F.lower(data_type)), r"\(.*\)", ""))


def dtype_score(data_type: Column, bucket: Column, is_primary_key: Column) -> Column:
    name = bare_type(data_type)
    few = bucket.isin("low_categorical", "high_categorical", "boolean")
    return (
        F.when(name.isin(*TEMPORAL_TYPES, *BOOLEAN_TYPES), 0.90)
        .when(name.isin(*TEXT_TYPES), F.when(few, 0.80).otherwise(0.15))
        .when(name.isin(*INTEGER_TYPES), F.when(is_primary_key, 0.05).when(few, 0.75).otherwise(0.10))
        .when(name.isin(*FLOAT_TYPES), 0.05)
        .otherwise(0.30)
    )


def null_penalty(ratio: Column) -> Column:
    return F.when(ratio < 0.05, 1.0).when(ratio < 0.30, 0.9).when(ratio < 0.60, 0.7).when(ratio < 0.80, 0.4).otherwise(0.1)


def naming_score(column_name: Column, bucket: Column) -> Column:
    name = F.trim(column_name)
    many = bucket.isin("high_cardinality", "near_unique")
    return (
        F.when(name.rlike(AUDIT_NAME), 0.10)
        .when(name.rlike(ANTI_FILTER_NAME), 0.05)
        .when(name.rlike(ID_OR_NAME) & many, 0.05)
        .when(name.rlike(TEMPORAL_NAME), 0.85)
        .when(name.rlike(FILTER_NAME), 0.80)
        .otherwise(0.50)
    )


def value_pattern(values: Column) -> Column:
    """``(pattern, score)`` of an array of top values; NULL entries are ignored."""
    present = F.filter(values, lambda v: v.isNotNull())
    total = F.size(present)

    def share(test: Column) -> Column:
        return F.size(test) / total

    iso = share(F.filter(present, lambda v: v.rlike(ISO_CODE_VALUE)))
    code = share(F.filter(present, lambda v: v.rlike(CODE_VALUE)))
    identifier = share(F.filter(present, lambda v: v.rlike(IDENTIFIER_VALUE)))
    # Upper case in the sense of "has cased characters, all of them upper".
    prose = share(
        F.filter(present, lambda v: (F.length(v) > LONG_VALUE) & ~((F.upper(v) == v) & (F.lower(v) != v)))
    )
    average = F.aggregate(present, F.lit(0), lambda acc, v: acc + F.length(v)) / total

    def pattern(name: str, score: float) -> Column:
        return F.struct(F.lit(name).alias("pattern"), F.lit(score).alias("score"))

    return (
        F.when(values.isNull() | (total <= 0), pattern("unknown", 0.50))
        .when(iso >= 0.8, pattern("code", 0.90))
        .when(code >= 0.8, pattern("code", 0.80))
        .when(identifier >= 0.5, pattern("identifier", 0.10))
        .when(prose >= 0.5, pattern("free_text", 0.10))
        .when(average <= SHORT_AVERAGE, pattern("categorical", 0.80))
        .otherwise(pattern("mixed", 0.50))
    )


def with_statistical_signals(columns: DataFrame) -> DataFrame:
    """Adds every statistical signal.

    Needs ``column_name, data_type, is_primary_key, enum_values, row_count, distinct_count,
    null_percentage, values``; a NULL ``distinct_count`` means the column has no statistics.
    """
    rows = F.coalesce("row_count", F.lit(0))
    measured, enums = F.col("distinct_count").isNotNull(), F.size("enum_values")
    distinct = F.when(measured, F.col("distinct_count")).when(enums > 0, enums).otherwise(0).cast("bigint")
    bucket = F.when(measured | (enums > 0), cardinality_bucket(distinct, rows)).otherwise("near_unique")
    ratio = F.when(measured, F.coalesce("null_percentage", F.lit(0.0)) / 100.0).otherwise(0.0)
    first = columns.withColumns(
        {"row_count": rows, "cardinality_bucket": bucket, "null_ratio": ratio, "_pattern": value_pattern(F.col("values"))}
    ).withColumn("distinct_count", distinct)
    bucket = F.col("cardinality_bucket")
    repetition = F.when(F.col("distinct_count") > 0, rows / F.col("distinct_count")).otherwise(0.0)
    return first.withColumns(
        {
            "repetition_factor": repetition,
            "cardinality_score": cardinality_score(bucket),
            "dtype_score": dtype_score(F.col("data_type"), bucket, F.col("is_primary_key")),
            "naming_score": naming_score(F.col("column_name"), bucket),
            "null_penalty": null_penalty(F.col("null_ratio")),
            "value_pattern": F.col("_pattern.pattern"),
            "value_pattern_score": F.col("_pattern.score"),
        }
    ).drop("_pattern")


# ── Composite score, triage and judge ─────────────────────────────────────────


def composite_score() -> Column:
    """Weighted signals times the null penalty, four decimals; kept in double throughout."""
    weighted = sum((F.lit(w) * F.col(name) for name, w in WEIGHTS.items()), F.lit(0.0))
    return F.round(weighted * F.col("null_penalty"), 4)


def filter_type(data_type: Column, bucket: Column) -> Column:
    name = bare_type(data_type)
    few = bucket.isin("low_categorical", "high_categorical")
    return (
        F.when(name.isin(*TEMPORAL_TYPES), "temporal")
        .when(name.isin(*BOOLEAN_TYPES) | (bucket == "boolean"), "boolean")
        .when(name.isin(*RANGE_TYPES) & ~few, "range")
        .otherwise("categorical")
    )


def triage(score: Column, schema: Column) -> Column:
    return (
        F.when((score > ACCEPT_ABOVE) & (schema > 0), "accept").when(score < REJECT_BELOW, "reject").otherwise("review")
    )


def with_composite(signals: DataFrame) -> DataFrame:
    """Adds ``composite_score``, ``filter_type`` and ``triage`` to columns that carry all signals."""
    return signals.withColumns(
        {"composite_score": composite_score(), "filter_type": filter_type(F.col("data_type"), F.col("cardinality_bucket"))}
    ).withColumn("triage", triage(F.col("composite_score"), F.col("schema_score")))


def judge_payloads(candidates: DataFrame) -> DataFrame:
    """``(table_name, ordinal, column_name, payload)``: the evidence of each column under review, as JSON."""
    pattern = F.when(F.col("value_pattern") != "unknown", F.col("value_pattern"))
    evidence = F.struct(
        "column_name",
        "data_type",
        F.round("composite_score", 3).alias("composite_score"),
        F.col("filter_type").alias("preliminary_filter_type"),
        "cardinality_bucket",
        "distinct_count",
        F.round("null_ratio", 3).alias("null_ratio"),
        F.round("naming_score", 2).alias("naming_score"),
        F.round("dtype_score", 2).alias("dtype_score"),
        F.round("cardinality_score", 2).alias("cardinality_score"),
        F.round("schema_score", 2).alias("schema_score"),
        "is_foreign_key",
        "has_enum_type",
        "has_check_constraint",
        pattern.alias("value_pattern"),
    )
    review = candidates.where("triage = 'review'")
    return review.select(*table_key(candidates), "ordinal", "column_name", F.to_json(evidence).alias("payload"))


def reconcile(heuristic: Column, judged: Column, has_schema: Column) -> Column:
    """``(score, source)`` from the two opinions."""
    difference = F.abs(heuristic - judged)
    mean = (heuristic + judged) / 2
    leaning = F.when(has_schema, F.lit(0.7) * heuristic + F.lit(0.3) * judged).otherwise(
        F.lit(0.4) * heuristic + F.lit(0.6) * judged
    )

    def verdict(score: Column, source: str) -> Column:
        return F.struct(F.round(score, 4).alias("score"), F.lit(source).alias("source"))

    return (
        F.when(difference < 0.2, verdict(mean, "llm_agreed"))
        .when(difference <= 0.4, verdict(leaning, "llm_adjusted"))
        .otherwise(verdict(mean, "flagged_for_review"))
    )


def filter_columns(candidates: DataFrame, judgments: DataFrame | None = None) -> DataFrame:
    """The chosen columns with ``filter_name, confidence, confidence_source, filter_type, reasoning, position``.

    ``judgments`` holds ``table_name, column_name, filter_name, llm_confidence, llm_filter_type,
    reasoning``, at most one row per column. Positions follow falling confidence; accepted columns
    come before reviewed ones of the same confidence, then the column order of the table.
    """
    verdicts = "filter_name string, llm_confidence double, llm_filter_type string, reasoning string"
    if judgments is None:
        empty = [f"cast(null as {part.split()[1]}) as {part.split()[0]}" for part in verdicts.split(", ")]
        joined = candidates.selectExpr("*", *empty)
    else:
        joined = candidates.join(judgments, table_key(candidates, judgments, column=True), "left")
    judged = (F.col("triage") == "review") & F.col("llm_confidence").isNotNull()
    decided = reconcile(F.col("composite_score"), F.col("llm_confidence"), F.col("schema_score") > 0)
    heuristic = F.struct(F.col("composite_score").alias("score"), F.lit("heuristic_only").alias("source"))
    scored = joined.where("triage <> 'reject'").withColumn("_verdict", F.when(judged, decided).otherwise(heuristic))
    kept = scored.where((F.col("triage") == "accept") | (F.col("_verdict.score") >= INCLUDE_FROM))
    order = Window.partitionBy(*table_key(candidates)).orderBy(
        F.desc("_verdict.score"), F.when(F.col("triage") == "accept", 0).otherwise(1), "ordinal"
    )
    return kept.select(
        *table_key(candidates),
        F.when(judged, F.coalesce("filter_name", F.lit(""))).otherwise(F.col("column_name")).alias("filter_name"),
        "column_name",
        F.col("_verdict.score").alias("confidence"),
        F.col("_verdict.source").alias("confidence_source"),
        F.when(judged, F.coalesce("llm_filter_type", "filter_type")).otherwise(F.col("filter_type")).alias("filter_type"),
        F.when(judged, F.col("reasoning")).alias("reasoning"),
        F.row_number().over(order).alias("position"),
    )


def filter_column_lists(chosen: DataFrame) -> DataFrame:
    """``(table_name, filter_columns)``; tables without a chosen column have no row, hence NULL after a join."""
    entry = F.struct(
        "position", "filter_name", "column_name", "confidence", "confidence_source", "filter_type", "reasoning"
    )
    # Bounded by the number of columns of a table.
    ordered = F.array_sort(F.collect_list(entry))
    return chosen.groupBy(*table_key(chosen)).agg(F.transform(ordered, lambda e: e.dropFields("position")).alias("filter_columns"))
