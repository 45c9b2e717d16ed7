"""Filter detection over measured columns, and schema signals over the derived catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsight.config import ProfileConfig
from colsight.functions.rows import constant_rows
from colsight.operators import catalog, filters, summary, topvalues
from colsight.operators.cells import Dataset, column_frame, frequencies
from colsight.operators.distinct import distinct_counts
from colsight.plans import detect, document
from colsight.plans.report import CatalogFrames, run_report
from colsight.plans.run import union_readers
from colsight.sources.staging import columnar, shared_folder
from suite.derived import ctes, derived, derived_frames
from suite.tables import load

# Views with telling names: SQL expression and Spark type of each column.
COLUMNS = {
    "customer": {
        "customer_id": ("c_custkey", "bigint"), "customer_name": ("c_name", "string"), "nation_id": ("c_nationkey", "int"),
        "balance": ("c_acctbal", "double"), "segment_group": ("c_mktsegment", "string"),
    },
    "orders": {
        "order_id": ("o_orderkey", "bigint"), "customer_id": ("o_custkey", "bigint"), "order_status": ("o_orderstatus", "string"),
        "amount": ("o_totalprice", "double"), "order_date": ("o_orderdate", "timestamp_ntz"),
        "priority_level": ("o_orderpriority", "string"), "is_final": ("o_orderstatus = 'F'", "boolean"),
        "mostly_null": ("case when o_orderkey % 10 = 0 then o_orderpriority end", "string"),
    },
    "lineitem": {
        "order_id": ("l_orderkey", "bigint"), "part_id": ("l_partkey", "bigint"), "supplier_id": ("l_suppkey", "bigint"),
        "line_no": ("l_linenumber", "int"), "quantity": ("l_quantity", "double"), "return_flag": ("l_returnflag", "string"),
        "line_status": ("l_linestatus", "string"), "ship_date": ("l_shipdate", "timestamp_ntz"),
        "line_state": ("nullif(l_linestatus, 'O')", "string"),
    },
    "part": {
        "part_id": ("p_partkey", "bigint"), "part_name": ("p_name", "string"), "brand_code": ("p_brand", "string"),
        "part_type": ("p_type", "string"), "size": ("p_size", "int"), "price": ("p_retailprice", "double"),
        "part_comment": ("p_type", "string"),
    },
    "events": {
        "id": ("event_id", "bigint"), "created_at": ("ts", "timestamp_ntz"), "user_id": ("user_id", "bigint"),
        "event_type": ("event_type", "string"), "value": ("value", "double"), "props_json": ("props", "string"),
    },
}
PRIMARY_KEYS = (
    ("customer", "customer_id"), ("orders", "order_id"), ("lineitem", "order_id"), ("lineitem", "line_no"),
    ("part", "part_id"), ("events", "id"),
)
FOREIGN_KEYS = (
    ("lineitem", "order_id", "orders"), ("lineitem", "part_id", "part"), ("lineitem", "supplier_id", "supplier"),
    ("orders", "customer_id", "customer"), ("customer", "nation_id", "nation"),
)
INDEXES = (
    ("orders", "ix_status_date", ("order_status", "order_date"), False),
    ("orders", "ix_customer", ("customer_id",), False),
    ("lineitem", "ix_ship", ("ship_date", "return_flag", "line_status"), True),
)
CHECKS = (("orders", "priority_level"), ("part", "part_type"))
ESTIMATES = (("main", "supplier", 100), ("main", "nation", 25))


def views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        t: load(spark, sf_dir, t).selectExpr(*[f"{sql} as {name}" for name, (sql, _) in columns.items()])
        for t, columns in COLUMNS.items()
    }


def measured(spark: SparkSession, sf_dir: str, top: bool = False) -> DataFrame:
    """Row, null and distinct counts of every view column; with top values if asked for."""
    config = ProfileConfig()
    data = Dataset.of(views(spark, sf_dir))
    frequency = frequencies(data, data.columns)
    distinct = distinct_counts(frequency, spark)
    counts = summary.common_counts(summary.summaries(data, config, ["total_count", "non_null_count"]), distinct)
    profile = column_frame(data).join(F.broadcast(counts), "cid")
    if top:
        gate = topvalues.passes_gate(data, config)
        values = topvalues.value_counts(data, frequency, distinct.where(gate))
        entries = topvalues.top_value_entries(topvalues.top_values(values, config.top_values_limit))
        profile = profile.join(F.broadcast(entries), "cid", "left").withColumn(
            "top_values", F.when(gate, topvalues.as_top_values(F.col("entries"), F.col("total_count")))
        )
    return profile.withColumnRenamed("total_count", "row_count")


def _keys(spark: SparkSession) -> DataFrame:
    rows = [(t, c, True) for t, c in PRIMARY_KEYS]
    keys = constant_rows(spark, rows, "table_name string, column_name string, is_primary_key boolean")
    return keys.withColumn("enum_values", F.lit(None).cast("array<string>"))


def _relationships(spark: SparkSession) -> DataFrame:
    rows = [(t, f"fk_{t}_{to}", c, "main", to) for t, c, to in FOREIGN_KEYS]
    return constant_rows(spark, rows, "table_name string, constraint_name string, from_column string, to_schema string, to_table string")


def _indexes(spark: SparkSession) -> DataFrame:
    rows = [(t, name, ",".join(columns), unique, False) for t, name, columns, unique in INDEXES]
    flat = constant_rows(spark, rows, "table_name string, index_name string, columns string, is_unique boolean, is_primary boolean")
    return flat.withColumn("columns", F.split("columns", ","))


def _row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = summary.row_counts({t: load(spark, sf_dir, t) for t in COLUMNS})
    return counts.select(F.lit("main").alias("schema_name"), "table_name", "row_count")


def candidates(spark: SparkSession, sf_dir: str, top: bool = False) -> DataFrame:
    checks = constant_rows(spark, CHECKS, "table_name string, column_name string")
    estimates = constant_rows(spark, ESTIMATES, "schema_name string, table_name string, row_count bigint")
    profile = measured(spark, sf_dir, top).drop("row_count")
    return detect.candidates(
        profile, _keys(spark), _relationships(spark), _indexes(spark), _row_counts(spark, sf_dir), checks, estimates
    )


def _derived_signals(spark: SparkSession, sf_dir: str, *counts: DataFrame) -> DataFrame:
    """Schema signals of the derived catalog, where every line item is a column; with ``counts`` the rows of referenced tables too."""
    name = F.concat_ws(".", "table_schema", "table_name").alias("table_name")
    columns, constraints, usage, referential, statistics = derived_frames(
        spark, sf_dir, "columns", "constraints", "key_usage", "referential", "statistics"
    )
    known = catalog.columns(columns, catalog.primary_keys(constraints, usage)).withColumn(
        "enum_values", catalog.parse_enum(F.col("data_type"))
    )
    links = catalog.foreign_keys(referential, usage, constraints)
    indexes = catalog.indexes_from_statistics(statistics)
    return filters.schema_signals(
        known.select(name, "column_name", "is_primary_key", "enum_values"),
        links.select(name, "constraint_name", "from_column", "to_schema", "to_table"),
        indexes.select(name, "index_name", "columns", "is_unique", "is_primary"),
        *counts,
    )


def fd_schema_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = _derived_signals(spark, sf_dir)
    return signals.withColumn("composite_partners", F.array_join("composite_partners", ",")).drop("enum_values")


def _referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = derived(spark, sf_dir, "tables")
    profiled = tables.where("table_id % 2 = 0").selectExpr(
        "table_schema as schema_name", "table_name", "if(row_estimate > 0, row_estimate, null) as row_count"
    )
    estimates = tables.selectExpr("table_schema as schema_name", "table_name", "data_length as row_count")
    return _derived_signals(spark, sf_dir, profiled, estimates)


def fd_fk_ref_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _referenced(spark, sf_dir).where("is_foreign_key")
    return found.select("table_name", "column_name", "fk_referenced_table", "fk_referenced_rows")


def fd_schema_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    referenced = _referenced(spark, sf_dir).withColumn("has_check_constraint", F.lit(False))
    return referenced.select("table_name", "column_name", filters.schema_score().alias("schema_score"))


def fd_table_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = column_frame(Dataset.of(views(spark, sf_dir)))
    return filters.table_roles(columns, _row_counts(spark, sf_dir).drop("schema_name"), _relationships(spark))


def fd_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = measured(spark, sf_dir)
    bucket = filters.cardinality_bucket(F.col("distinct_count"), F.col("row_count"))
    return columns.select("table_name", "column_name", bucket.alias("bucket")).withColumn(
        "score", filters.cardinality_score(F.col("bucket"))
    )


def _bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = measured(spark, sf_dir)
    bucket = filters.cardinality_bucket(F.col("distinct_count"), F.col("row_count"))
    return columns.withColumn("bucket", bucket)


def fd_dtype_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = _bucketed(spark, sf_dir).join(F.broadcast(_keys(spark)), ["table_name", "column_name"], "left")
    key = F.coalesce("is_primary_key", F.lit(False))
    score = filters.dtype_score(F.col("data_type"), F.col("bucket"), key)
    return columns.select("table_name", "column_name", score.alias("dtype_score"))


def fd_null_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    penalty = filters.null_penalty(F.col("null_percentage") / 100.0)
    return measured(spark, sf_dir).select("table_name", "column_name", penalty.alias("null_penalty"))


def fd_naming_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = filters.naming_score(F.col("column_name"), F.col("bucket"))
    return _bucketed(spark, sf_dir).select("table_name", "column_name", score.alias("naming_score"))


def fd_value_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = filters.value_pattern(F.col("top_values.value"))
    columns = measured(spark, sf_dir, top=True).select("table_name", "column_name", pattern.alias("p"))
    return columns.select("table_name", "column_name", F.col("p.pattern").alias("pattern"), F.col("p.score").alias("score"))


def fd_stat_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir, top=True).select(
        "table_name", "column_name", "distinct_count", "row_count", F.round("repetition_factor", 4).alias("repetition_factor"),
        F.round("null_ratio", 4).alias("null_ratio"), "cardinality_bucket", "cardinality_score", "dtype_score",
        "naming_score", "null_penalty", "value_pattern", "value_pattern_score",
    )


def fd_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("table_name", "column_name", "schema_score", "composite_score")


def fd_filter_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("table_name", "column_name", "filter_type")


def fd_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("table_name", "column_name", "triage")


def fd_judge_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.judge_payloads(candidates(spark, sf_dir, top=True)).drop("ordinal")


def judgments(columns: DataFrame) -> DataFrame:
    """Opinions on every second column, spread over the whole range of confidence."""
    confidence = (F.col("distinct_count") * 37 % 100) / 100.0
    return columns.where("ordinal % 2 = 1").select(
        "table_name", "column_name", F.concat(F.lit("by "), "column_name").alias("filter_name"),
        confidence.alias("llm_confidence"), F.lit("range").alias("llm_filter_type"), F.lit("because").alias("reasoning"),
    )


def fd_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = candidates(spark, sf_dir)
    judged = scored.join(judgments(scored).select("table_name", "column_name", "llm_confidence"), ["table_name", "column_name"])
    verdict = filters.reconcile(F.col("composite_score"), F.col("llm_confidence"), F.col("schema_score") > 0)
    return judged.select("table_name", "column_name", verdict.alias("v")).select("table_name", "column_name", "v.score", "v.source")


def fd_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = columnar(candidates(spark, sf_dir))  # one row per column, read twice
    return filters.filter_columns(scored, judgments(scored))


def prf_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of all views, written one per table with their manifest, read back and taken apart by column."""
    path = shared_folder(spark)
    document.write_report(report_structs(spark, sf_dir), path)
    documents, manifest = spark.read.json(f"{path}/documents"), spark.read.parquet(f"{path}/manifest")
    listed = F.array_join(F.transform("filter_columns", lambda f: F.concat_ws(":", f["column_name"], f["confidence"].cast("string"))), ",")
    tables = documents.select(
        F.col("schema").alias("schema_name"), F.col("name").alias("table_name"), "row_count", "table_role", listed.alias("filter_columns"), F.explode("columns").alias("c")
    )
    rows = tables.join(manifest.select("schema_name", "table_name", F.col("columns").alias("listed_columns")), ["schema_name", "table_name"])
    s = "c.statistics."
    return rows.select(
        "schema_name", "table_name", F.col("c.name").alias("column_name"), F.col("c.ordinal_position").alias("ordinal"), "c.data_type", "row_count", "table_role",
        "filter_columns", "listed_columns", F.col("c.is_primary_key").alias("is_primary_key"), F.col("c.is_sensitive").alias("is_sensitive"),
        F.size("c.sample_values").alias("samples"), *[F.col(s + f).alias(f) for f in ("total_count", "null_percentage", "distinct_count", "distinct_percentage")],
        F.col(s + "numeric.max").alias("numeric_max"), F.col(s + "string.max_length").alias("max_length"), F.size(s + "top_values").alias("top_values"),
    )


def report_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = constant_rows(spark, CHECKS, "table_name string, column_name string")
    estimates = constant_rows(spark, ESTIMATES, "schema_name string, table_name string, row_count bigint")
    catalog_frames = CatalogFrames(_keys(spark), _relationships(spark), _indexes(spark), checks, estimates)
    readers = union_readers(("main", views(spark, sf_dir)))
    return run_report(spark, readers, catalog_frames, ProfileConfig(columns_per_job=10, max_concurrent_tables=2))


QUERIES = {
    f.__name__: f
    for f in (
        fd_schema_signals, fd_fk_ref_rows, fd_schema_score, fd_table_role, fd_cardinality, fd_dtype_score,
        fd_null_penalty, fd_naming_score, fd_value_pattern, fd_stat_signals, fd_composite, fd_filter_type, fd_triage,
        fd_judge_payload, fd_reconcile, fd_detect, prf_document,
    )
}


# ── SQL ───────────────────────────────────────────────────────────────────────

# The weights, thresholds and patterns below are fixed values of the scoring rules, as in colsight.operators.filters.


def _measured_sql() -> str:
    """One row per column: counts, and the top values as a list."""
    parts = []
    for table, columns in COLUMNS.items():
        for ordinal, (name, (sql, kind)) in enumerate(columns.items(), start=1):
            top = (
                f"(select list(v order by n desc, v) from (select ({sql})::varchar as v, count(*) as n from {table}"
                f" where ({sql}) is not null group by 1 order by n desc, v limit 10))"
            )
            gated = {"boolean": "true", "timestamp_ntz": "false"}.get(kind, f"count(distinct ({sql})) <= 100")
            parts.append(
                f"select '{table}' as table_name, {ordinal} as ordinal, '{name}' as column_name, '{kind}' as data_type, count(*) as row_count,"
                f" count(distinct ({sql})) as distinct_count, round((count(*) - count(({sql}))) * 100.0::double / count(*), 2) as null_percentage,"
                f" case when {gated} then {top} end as top from {table}"
            )
    return " union all ".join(parts)


def _values(rows: tuple, names: str, width: int) -> str:
    body = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row[:width]) + ")" for row in rows)
    return f"(select * from (values {body}) t({names}))"


_INDEX_ROWS = tuple(
    (t, c, unique, ",".join(x for x in columns if x != c)) for t, _, columns, unique in INDEXES for c in columns
)
_MANY = "bucket in ('high_cardinality', 'near_unique')"
_FEW = "bucket in ('low_categorical', 'high_categorical', 'boolean')"
_BUCKET = """case when row_count = 0 or distinct_count <= 1 then 'constant' when distinct_count = 2 then 'boolean'
    when distinct_count <= 50 then 'low_categorical' when distinct_count <= 500 then 'high_categorical'
    when distinct_count <= 10000 or distinct_count <= row_count * 0.10 then 'high_cardinality' else 'near_unique' end"""
_CARDINALITY = """(case bucket when 'constant' then 0.0 when 'boolean' then 0.85 when 'low_categorical' then 0.95 when 'high_categorical' then 0.70
    when 'high_cardinality' then 0.30 else 0.05 end)::double"""
_DTYPE = f"""(case when data_type in ('timestamp_ntz', 'boolean') then 0.90 when data_type = 'string' then case when {_FEW} then 0.80 else 0.15 end
    when data_type in ('int', 'bigint') then case when pk then 0.05 when {_FEW} then 0.75 else 0.10 end else 0.05 end)::double"""
_PENALTY = """(case when ratio < 0.05 then 1.0 when ratio < 0.30 then 0.9 when ratio < 0.60 then 0.7 when ratio < 0.80 then 0.4 else 0.1 end)::double"""
_NAMING = f"""(case when regexp_matches(column_name, '^(created|updated|modified|inserted|deleted)_(at|on|date|time|timestamp)$|^last_login$|_timestamp$', 'i') then 0.10
    when regexp_matches(column_name, '_(description|notes|comment|text|blob|json|xml|hash|token|uuid)$', 'i') then 0.05
    when regexp_matches(column_name, '(_|^)(id|name)$', 'i') and {_MANY} then 0.05
    when regexp_matches(column_name, '_(date|time|at|on|year|month|quarter|week)$|^(date|time|fiscal)_', 'i') then 0.85
    when regexp_matches(column_name, '_(status|type|category|code|class|group|tier|level|flag|mode|state|region|country|city|department|channel)$|^(is|has)_', 'i') then 0.80
    else 0.50 end)::double"""


def _share(test: str) -> str:
    return f"len(list_filter(top, lambda v: {test})) / len(top)"


_PATTERN = f"""case when top is null or len(top) = 0 then 'unknown'
    when {_share("regexp_full_match(v, '[A-Z]{2,3}')")} >= 0.8 then 'code' when {_share("regexp_full_match(v, '[A-Z0-9_-]{2,5}')")} >= 0.8 then 'code'
    when {_share("regexp_matches(v, '^[A-Z]{2,5}[-_][0-9]', 'i')")} >= 0.5 then 'identifier'
    when {_share("len(v) > 30 and not (upper(v) = v and lower(v) <> v)")} >= 0.5 then 'free_text'
    when list_avg(list_transform(top, lambda v: len(v))) <= 25 then 'categorical' else 'mixed' end"""
_PATTERN_SCORE = f"""(case pattern when 'unknown' then 0.50 when 'identifier' then 0.10 when 'free_text' then 0.10 when 'categorical' then 0.80 when 'mixed' then 0.50
    else case when {_share("regexp_full_match(v, '[A-Z]{2,3}')")} >= 0.8 then 0.90 else 0.80 end end)::double"""
_SCHEMA = """(case when checked then 0.95 when fk is not null and coalesce(fk_rows, 500) < 500 then 0.9 when non_unique then 0.7 when fk is not null then 0.6
    when partners <> '' then 0.5 when pk and pks = 1 then 0.05 else 0.0 end)::double"""
_TYPE = """case when data_type = 'timestamp_ntz' then 'temporal' when data_type = 'boolean' or bucket = 'boolean' then 'boolean'
    when data_type in ('int', 'bigint', 'double') and bucket not in ('low_categorical', 'high_categorical') then 'range' else 'categorical' end"""
_TRIAGE = "case when composite > 0.85 and schema_score > 0 then 'accept' when composite < 0.15 then 'reject' else 'review' end"

_DECIDED = """case when diff < 0.2 then mean when diff <= 0.4 then case when schema_score > 0 then 0.7::double * composite + 0.3::double * judged
    else 0.4::double * composite + 0.6::double * judged end else mean end"""


def _rounded(score: str) -> str:
    """Four decimals of the double as it is: round() on a double first scales it, which turns 0.22524999999999998 into a tie."""
    return f"round(({score})::decimal(38, 20), 4)::double"


_CTE = f"""with m as ({_measured_sql()}),
    k as {_values(PRIMARY_KEYS, 'table_name, column_name', 2)}, f as {_values(FOREIGN_KEYS, 'table_name, column_name, fk', 3)},
    i as {_values(_INDEX_ROWS, 'table_name, column_name, is_unique, partners', 4)}, c as {_values(CHECKS, 'table_name, column_name', 2)},
    r as (select fk, case fk {' '.join(f"when '{t}' then (select count(*) from {t})" for t in COLUMNS)}
        when 'supplier' then 100 when 'nation' then 25 end as fk_rows from (select distinct fk from f)),
    s1 as (select m.*, k.column_name is not null as pk, (select count(*) from k kk where kk.table_name = m.table_name) as pks, f.fk, fk_rows,
        coalesce(not i.is_unique, false) as non_unique, coalesce(i.partners, '') as partners, c.column_name is not null as checked,
        null_percentage / 100.0::double as ratio, {_BUCKET} as bucket, {_PATTERN} as pattern
        from m left join k using (table_name, column_name) left join f using (table_name, column_name) left join r on r.fk = f.fk
        left join i using (table_name, column_name) left join c using (table_name, column_name)),
    s2 as (select *, {_CARDINALITY} as cardinality_score, {_DTYPE} as dtype_score, {_NAMING} as naming_score, {_PENALTY} as null_penalty,
        {_SCHEMA} as schema_score, {_TYPE} as filter_type, {_PATTERN_SCORE} as pattern_score from s1),
    s3 as (select *, {_rounded('(0.35::double * schema_score + 0.30::double * cardinality_score + 0.20::double * dtype_score + 0.15::double * naming_score) * null_penalty')} as composite from s2),
    s4 as (select *, {_TRIAGE} as triage, case when ordinal % 2 = 1 then (distinct_count * 37 % 100) / 100.0::double end as judged from s3),
    s5 as (select *, abs(composite - judged) as diff, (composite + judged) / 2 as mean from s4),
    s as (select *, {_rounded(_DECIDED)} as decided,
        case when diff < 0.2 then 'llm_agreed' when diff <= 0.4 then 'llm_adjusted' else 'flagged_for_review' end as source from s5)
"""
_C = "select table_name, column_name, "

_SIGNAL_CTES = ctes("columns", "constraints", "key_usage", "referential", "statistics", "tables").rstrip() + """,
    p as (select distinct k.table_schema, k.table_name, k.column_name from d_key_usage k join d_constraints t using (table_schema, table_name, constraint_name) where constraint_type = 'PRIMARY KEY'),
    f as (select tc.table_schema, tc.table_name, k.column_name, p2.table_schema || '.' || p2.table_name as fk from d_referential rc
        join d_key_usage k on k.constraint_name = rc.constraint_name and k.table_schema = rc.constraint_schema
        join d_key_usage p2 on p2.constraint_name = rc.unique_constraint_name and p2.ordinal_position = k.ordinal_position
        join d_constraints tc on tc.constraint_name = rc.constraint_name and tc.table_schema = rc.constraint_schema),
    x as (select a.table_schema, a.table_name, a.column_name, a.non_unique = 1 as non_unique,
        coalesce(string_agg(b.column_name, ',' order by b.seq_in_index) filter (b.column_name <> a.column_name), '') as partners
        from d_statistics a join d_statistics b using (table_schema, table_name, index_name) where index_name <> 'PRIMARY' group by all),
    g as (select c.table_schema || '.' || c.table_name as table_name, column_name, p.column_name is not null as is_primary_key,
        case when p.column_name is not null then (select count(*) from p pp where pp.table_name = c.table_name) else 0 end::int as pk_column_count,
        fk as fk_referenced_table, coalesce(non_unique, false) as is_non_unique_index, coalesce(partners, '') as composite_partners, data_type like 'enum(%' as has_enum_type
        from d_columns c left join p using (table_schema, table_name, column_name) left join f using (table_schema, table_name, column_name)
        left join x using (table_schema, table_name, column_name)),
    t as (select table_schema || '.' || table_name as fk_referenced_table, case when table_id % 2 <> 0 then data_length when row_estimate > 0 then row_estimate end as fk_referenced_rows from d_tables)
"""



def _shape_sql() -> str:
    """Greatest number, longest text and number of top values of each column."""
    parts = []
    for table, columns in COLUMNS.items():
        for name, (sql, kind) in columns.items():
            most = f"max(({sql}))::double" if kind in ("int", "bigint", "double") else "max(null::double)"
            longest = f"max(length(({sql})))" if kind == "string" else "max(null::bigint)"
            parts.append(f"select '{table}' as table_name, '{name}' as column_name, {most} as numeric_max, {longest} as max_length from {table}")
    return " union all ".join(parts)


ORACLE = {
    "prf_document": _CTE
    + f""", x as ({_shape_sql()}), w as (select table_name, any_value(row_count) as n, count(*) filter (data_type in ('int', 'bigint', 'double')) as numbers,
        count(*) filter (data_type = 'string') as texts, count(fk) as links, count(*) as listed_columns from s group by table_name),
        o as (select table_name, string_agg(column_name || ':' || composite, ',' order by composite desc, triage <> 'accept', ordinal) as filter_columns
            from s where triage = 'accept' or (triage = 'review' and composite >= 0.50) group by table_name)
        select 'main' as schema_name, s.table_name, s.column_name, ordinal, data_type, row_count, filter_columns, listed_columns, pk as is_primary_key, false as is_sensitive,
        case when n > 10000 and links >= 2 and numbers >= 2 then 'fact' when n < 5000 and links = 0 and texts >= 2 then 'dimension' else 'unknown' end as table_role,
        least(row_count, 10) as samples, row_count as total_count, null_percentage, distinct_count, round(distinct_count * 100.0::double / row_count, 2) as distinct_percentage,
        numeric_max, max_length, len(top) as top_values
        from s join x using (table_name, column_name) join w using (table_name) left join o using (table_name)""",
    "fd_schema_signals": _SIGNAL_CTES
    + "select *, pk_column_count > 1 as is_composite_pk_member, fk_referenced_table is not null as is_foreign_key from g",
    "fd_fk_ref_rows": _SIGNAL_CTES
    + "select table_name, column_name, fk_referenced_table, fk_referenced_rows from g left join t using (fk_referenced_table) where fk_referenced_table is not null",
    "fd_schema_score": _SIGNAL_CTES
    + """select table_name, column_name, (case when has_enum_type then 0.95 when fk_referenced_table is not null and fk_referenced_rows < 500 then 0.9
        when is_non_unique_index then 0.7 when fk_referenced_table is not null then 0.6 when composite_partners <> '' then 0.5
        when is_primary_key and pk_column_count = 1 then 0.05 else 0.0 end)::double as schema_score from g left join t using (fk_referenced_table)""",
    "fd_table_role": _CTE
    + """, w as (select table_name, any_value(row_count) as n, count(*) filter (data_type in ('int', 'bigint', 'double')) as numbers,
        count(*) filter (data_type = 'string') as texts, count(fk) as links from s group by table_name)
        select table_name, case when n > 10000 and links >= 2 and numbers >= 2 then 'fact' when n < 5000 and links = 0 and texts >= 2 then 'dimension' else 'unknown' end as table_role from w""",
    "fd_cardinality": _CTE + _C + "bucket, cardinality_score as score from s",
    "fd_dtype_score": _CTE + _C + "dtype_score from s",
    "fd_null_penalty": _CTE + _C + "null_penalty from s",
    "fd_naming_score": _CTE + _C + "naming_score from s",
    "fd_value_pattern": _CTE + _C + "pattern, pattern_score as score from s",
    "fd_stat_signals": _CTE
    + _C
    + """distinct_count, row_count, round(row_count::double / distinct_count, 4) as repetition_factor, round(ratio, 4) as null_ratio, bucket as cardinality_bucket,
        cardinality_score, dtype_score, naming_score, null_penalty, pattern as value_pattern, pattern_score as value_pattern_score from s""",
    "fd_composite": _CTE + _C + "schema_score, composite as composite_score from s",
    "fd_filter_type": _CTE + _C + "filter_type from s",
    "fd_triage": _CTE + _C + "triage from s",
    "fd_judge_payload": _CTE
    + _C
    + """'{"column_name":"' || column_name || '","data_type":"' || data_type || '","composite_score":' || round(composite, 3) || ',"preliminary_filter_type":"' || filter_type
        || '","cardinality_bucket":"' || bucket || '","distinct_count":' || distinct_count || ',"null_ratio":' || round(ratio, 3) || ',"naming_score":' || naming_score
        || ',"dtype_score":' || dtype_score || ',"cardinality_score":' || cardinality_score || ',"schema_score":' || schema_score || ',"is_foreign_key":' || (fk is not null)
        || ',"has_enum_type":false,"has_check_constraint":' || checked || case when pattern <> 'unknown' then ',"value_pattern":"' || pattern || '"' else '' end || '}' as payload
        from s where triage = 'review'""",
    "fd_reconcile": _CTE + _C + "decided as score, source from s where judged is not null",
    "fd_detect": _CTE
    + """, d as (select *, triage = 'review' and judged is not null as by_judge from s where triage <> 'reject'),
        e as (select *, case when by_judge then decided else composite end as confidence from d)
        select table_name, case when by_judge then 'by ' || column_name else column_name end as filter_name, column_name, confidence,
        case when by_judge then source else 'heuristic_only' end as confidence_source, case when by_judge then 'range' else filter_type end as filter_type,
        case when by_judge then 'because' end as reasoning,
        row_number() over (partition by table_name order by confidence desc, triage <> 'accept', ordinal)::int as position
        from e where triage = 'accept' or confidence >= 0.50""",
}
