"""Sensitivity, text context and answers over wide derived tables, and the run history.

A customer stands for a table here and all its line items for the columns, so that tables have
dozens of columns. Model answers are assembled from the same rows.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsight.functions import text
from colsight.operators import answers, filters, history, prompts, sensitivity
from colsight.plans.answering import AnswerLedger, text_stage
from colsight.sources.runstore import RunStore
from colsight.sources.staging import columnar, shared_folder
from suite.filtering import COLUMNS as MEASURED
from suite.filtering import ORACLE as FILTERING
from suite.filtering import _CTE as SCORED
from suite.filtering import candidates, measured
from suite.tables import load

_TABLE_NAME = "concat('s', cast(o_custkey % 10 as varchar(20)), '.customer_', cast(o_custkey as varchar(20)))"
COLUMNS = f"""select {_TABLE_NAME} as table_name, o_custkey, ord as ordinal, concat('c', cast(ord as varchar(20))) as column_name,
    case l_partkey % 3 when 0 then 'integer' when 1 then 'varchar(20)' else concat('enum(''', l_returnflag, ''',''', l_linestatus, ''')') end as data_type,
    ord = 1 as is_primary_key, l_linestatus = 'O' as is_nullable, case when l_suppkey % 3 = 0 then concat('supplied by ', cast(l_suppkey as varchar(20))) end as description,
    l_returnflag, l_linestatus, l_partkey
    from (select *, cast(row_number() over (partition by o_custkey order by o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) as int) as ord
        from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey)"""
TABLES = f"""select {_TABLE_NAME.replace('o_custkey', 'c_custkey')} as table_name, c_custkey, cast(floor(c_custkey / 100) as bigint) as part, c_nationkey, c_mktsegment,
    case c_nationkey % 3 when 0 then '' when 1 then null else c_mktsegment end as table_description,
    case when c_custkey % 2 = 0 then cast(floor(c_acctbal) as bigint) end as row_count from {{customer}}"""
ENTRY = """concat('{"column_name":"', column_name, '","is_sensitive":', case l_returnflag when 'A' then 'true' when 'R' then '"True"' else 'false' end,
    ',"sensitivity_type":', case l_partkey % 4 when 0 then '"email"' when 1 then '"mystery"' when 2 then 'null' else '"ssn"' end, '}')"""
# How an answer wraps its entries: readable, fenced, refused, off the point, with extras, repeated.
RESPONSE = """case o_custkey % 6 when 0 then concat('{"columns":[', entries, ']}')
    when 1 then concat('Sure:', chr(10), '```json', chr(10), '{"columns":[', entries, ']}', chr(10), '```')
    when 2 then concat('I cannot say: ', entries) when 3 then concat('{"other":[', entries, ']}')
    when 4 then concat('{"columns":[{"column_name":"ghost","is_sensitive":true},', entries, ',"odd"]}')
    else concat('{"columns":[', entries, ',{"column_name":"c1","is_sensitive":false}]}') end"""


def wide_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.sql(COLUMNS, lineitem=load(spark, sf_dir, "lineitem"), orders=load(spark, sf_dir, "orders"))
    samples = F.array("l_returnflag", F.lit(None).cast("string"), F.col("l_partkey").cast("string"), "l_linestatus")
    enums = F.when(F.col("l_partkey") % 3 == 2, F.array("l_returnflag", "l_linestatus"))
    return base.withColumns({"sample_values": samples, "enum_values": enums})


def wide_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TABLES, customer=load(spark, sf_dir, "customer"))


def ordered_join(position: str, value: str) -> F.Column:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.expr(value).alias("v"))))
    return F.array_join(F.transform(pairs, lambda e: e["v"]), ",")


# ── Sensitivity ───────────────────────────────────────────────────────────────


def sn_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitivity.batches(wide_columns(spark, sf_dir), 20).select("table_name", "column_name", "batch")


def sn_sample_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as samples: cut to the allowed length, NULL in between, never more than five."""
    values = F.expr("array(text, null, lang, source, text, text)")
    shown = sensitivity.sample_texts(values)
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(shown, "|").alias("samples"))


def sn_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = sensitivity.batches(wide_columns(spark, sf_dir), 20)
    tables = wide_tables(spark, sf_dir).select("table_name", "table_description")
    return sensitivity.prompts(batched.join(tables, "table_name"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored row per batch: the entries of its answer, and the names of its columns."""
    batched = sensitivity.batches(wide_columns(spark, sf_dir), 20)
    pairs = F.array_sort(F.collect_list(F.struct("ordinal", F.expr(ENTRY).alias("entry"), "column_name")))
    grouped = batched.groupBy("table_name", "batch", "o_custkey").agg(pairs.alias("p"))
    # An entry without a name is NULL and left out of the answer.
    entries = F.array_join("p.entry", ",").alias("entries")
    return columnar(grouped.select("table_name", "batch", "o_custkey", entries, F.col("p.column_name").alias("names")))


def _verdicts(asked: DataFrame) -> DataFrame:
    responses = asked.select("table_name", "batch", F.expr(RESPONSE).alias("response"))
    return sensitivity.parse_responses(responses, asked.select("table_name", "batch", F.explode("names").alias("column_name")))


def sn_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(_asked(spark, sf_dir))


def sn_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of all types, spread over the rows of the orders table."""
    codes = F.array(*[F.lit(code) for code in sorted(sensitivity.TYPES)])
    typed = load(spark, sf_dir, "orders").select(F.get(codes, (F.col("o_orderkey") % 46).cast("int")).alias("sensitivity_type"))
    level = sensitivity.level_of(F.col("sensitivity_type"))
    return typed.groupBy("sensitivity_type", level.alias("level")).agg(F.count("*").alias("n"))


def sn_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts applied to every column; those of one batch are missing, as after a failed call."""
    asked = _asked(spark, sf_dir)
    answered = _verdicts(asked).where("batch <> 1")
    columns = asked.select("table_name", F.explode("names").alias("column_name"))
    return sensitivity.apply_verdicts(columns, answered)


def sn_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitivity.rollup(_verdicts(_asked(spark, sf_dir)), "table_name", "batch")


EVIDENCE_TABLES = {
    "documents": ("text", "lang", "source"), "conversations": ("role", "text"), "pages": ("url", "html"),
    "customer": ("c_name", "c_mktsegment"), "events": ("event_type", "props"), "part": ("p_name", "p_brand", "p_type"),
    "supplier": ("s_name",), "nation": ("n_name",), "region": ("r_name",), "orders": ("o_orderstatus", "o_orderpriority"),
    "lineitem": ("l_returnflag", "l_linestatus"), "benchmark": ("text",),
}


def sn_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict and evidence of the text columns, from their names and from every value."""
    tables = {t: load(spark, sf_dir, t).select(*columns) for t, columns in EVIDENCE_TABLES.items()}
    # Names that the name rules know, over the same values.
    tables["conversations"] = tables["conversations"].withColumnRenamed("text", "user_name")
    evidence = sensitivity.value_evidence(tables)
    verdicts = sensitivity.classify(evidence.select("table_name", "column_name"), evidence)
    shares = [F.round(f"{kind}_share", 6).alias(f"{kind}_share") for kind in sensitivity.EVIDENCE]
    return verdicts.join(evidence, ["table_name", "column_name"]).select(
        "table_name", "column_name", "is_sensitive", "sensitivity_type", *shares
    )


# ── Text context ──────────────────────────────────────────────────────────────


def aug_column_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_columns(spark, sf_dir).select("table_name", "column_name", prompts.column_line().alias("line"))


def aug_table_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.table_prompts(wide_tables(spark, sf_dir), wide_columns(spark, sf_dir))


def aug_column_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.column_prompts(wide_tables(spark, sf_dir), wide_columns(spark, sf_dir))


def aug_glossary_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.glossary_prompts(wide_tables(spark, sf_dir), wide_columns(spark, sf_dir))


def aug_kpi_cluster_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.domain_prompts(wide_tables(spark, sf_dir), 5, "part")


def _domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of up to 100 tables, by number range and segment, in order of the customer number."""
    return wide_tables(spark, sf_dir).selectExpr(
        "concat(cast(part as string), '_', c_mktsegment) as domain", "c_custkey as place", "table_name"
    )


def aug_kpi_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.kpi_prompts(_domains(spark, sf_dir), wide_tables(spark, sf_dir), wide_columns(spark, sf_dir), 5)


def aug_filter_judge_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = candidates(spark, sf_dir, top=True)
    roles = measured(spark, sf_dir).select("table_name").distinct().withColumn("table_role", F.lit("unknown"))
    return prompts.judge_prompts(filters.judge_payloads(scored), roles)


# ── Answers ───────────────────────────────────────────────────────────────────


def aug_extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn: plain, or wrapped in a fence with text around it."""
    answer = F.expr(
        "case turn % 3 when 0 then concat('  ', text, chr(10)) when 1 then concat('Here:', chr(10), '```json', chr(10), text, chr(10), '```', role)"
        " else concat('```', chr(10), '  ', text, '  ', chr(10), '```') end"
    )
    turns = load(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", text.extract_json(answer).alias("content"))


_TERMS = """concat('{"terms":[', array_join(transform(sequence(1, cast(1 + c_custkey % 7 as int)), i -> concat('{"business_term":"', c_mktsegment, ' ', cast(i as string),
    '","description":', if(c_custkey % 10 = 3, 'null', '"d"'), if(i = 1, '', ',"synonyms":["x","y"]'), '}')), ','), ']', if(c_custkey % 11 = 5, '', '}'))"""


def aug_parse_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = answers.glossaries(wide_tables(spark, sf_dir).selectExpr("table_name", f"{_TERMS} as response"))
    names = F.array_join(F.transform("terms", lambda t: F.concat_ws("/", t["business_term"], F.size(t["synonyms"]).cast("string"))), ",")
    return parsed.select("table_name", names.alias("terms"))


_JUDGED = """concat('{"columns":[{"column_name":"a"', if(o_custkey % 2 = 0, concat(',"llm_confidence":', cast(o_custkey % 10 / 10.0D as string)), ''),
    if(o_custkey % 3 = 0, ',"filter_name":"A","agrees_with_heuristic":false', ''), '},{"column_name":"b","llm_filter_type":"range","llm_confidence":',
    if(o_custkey % 5 = 0, '"high"', '1'), ',"reasoning":null}]}')"""


def aug_parse_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_JUDGED} as response")
    return answers.judgments(orders)


def _domain_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per 100 tables, listing their segments, with an unknown table and an unusable entry."""
    per_segment = wide_tables(spark, sf_dir).groupBy("part", "c_mktsegment").agg(
        ordered_join("c_custkey", """concat('"', table_name, '"')""").alias("tables")
    )
    entry = """concat('{"domain":" ', c_mktsegment, '","tables":[', tables, ',"ghost.t"]}')"""
    parts = per_segment.groupBy("part").agg(ordered_join("c_mktsegment", entry).alias("entries"))
    return parts.selectExpr("part", """concat('{"domains":[{"domain":"","tables":["x"]},', entries, ',{"domain":"empty","tables":[]}]}') as response""")


def aug_parse_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.domains(_domain_answers(spark, sf_dir))


def _kpi_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One KPI per table of a domain, linked to existing, invented and repeated columns."""
    kpi = """concat('{"name":"k', cast(place as string), '","description":"d","calculation":"count(*)","linked_columns":["', t, '.c1","', t, '.c99","ghost.c1","', t, '.c2","', t, '.c1"]}')"""
    named = _domains(spark, sf_dir).withColumn("t", F.substring_index("table_name", ".", -1))
    found = named.groupBy("domain").agg(ordered_join("place", kpi).alias("kpis"))
    return found.selectExpr("domain", """concat('```json', chr(10), '{"kpis":[', kpis, ']}', chr(10), '```') as response""")


def aug_kpi_map_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains from the answers, resolved against the known tables, then their KPIs in domain order."""
    resolved = answers.known_domains(answers.domains(_domain_answers(spark, sf_dir)), wide_tables(spark, sf_dir))
    order = resolved.select(F.concat_ws("_", "part", "domain").alias("domain"), "domain_place").distinct()
    found = answers.kpis(_kpi_answers(spark, sf_dir), 15)
    return found.join(order, "domain").select("domain", "domain_place", "place", "name", F.size("linked_columns").alias("links"))


def aug_valid_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = answers.valid_columns(_domains(spark, sf_dir), wide_columns(spark, sf_dir))
    kept = answers.keep_valid_links(answers.kpis(_kpi_answers(spark, sf_dir), 20), valid)
    return kept.select("domain", "place", "name", F.array_join("linked_columns", ",").alias("linked_columns"))


def aug_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers for two thirds of the tables, some of them empty."""
    tables = wide_tables(spark, sf_dir)
    said = tables.where("c_custkey % 3 <> 0").selectExpr("table_name", "if(c_custkey % 3 = 1, '', concat('about ', table_name)) as response")
    renamed = tables.withColumnRenamed("table_description", "description")
    return answers.apply_descriptions(renamed, said, ["table_name"]).select("table_name", "description")


def aug_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call log of every line item, summed per order."""
    calls = load(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_partkey as input_tokens", "l_suppkey as output_tokens", "l_discount as input_cost", "l_tax as output_cost",
        "l_discount + l_tax as total_cost", "l_linenumber as estimated_text_tokens", "3 as estimated_overhead_tokens",
        "l_linenumber + 3 as estimated_total_tokens", "2 as estimated_message_count", "l_quantity as latency_ms",
    )
    return answers.usage(calls, "l_orderkey")


# ── Run history ───────────────────────────────────────────────────────────────

RUNS = """select o_orderkey as id, case o_orderpriority when '1-URGENT' then 'connecting' when '2-HIGH' then 'profiling' when '3-MEDIUM' then 'completed'
    when '4-NOT SPECIFIED' then 'failed' else case o_orderstatus when 'F' then 'pending' when 'O' then 'cancelled' else 'detecting_filters' end end as status,
    o_orderdate as created_at, case when o_orderkey % 3 <> 0 then o_orderdate + interval '1' hour end as started_at,
    case when o_orderkey % 2 = 0 then o_orderdate + interval '90' minute end as completed_at,
    cast(null as varchar(20)) as error_code, cast(null as varchar(20)) as error_message from {orders}"""
NOW = "timestamp '1998-01-01 00:00:00'"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RUNS, orders=load(spark, sf_dir, "orders")).withColumns(
        {"error_code": F.lit(None).cast("string"), "error_message": F.lit(None).cast("string")}
    )


def _now() -> F.Column:
    return F.expr("timestamp_ntz '1998-01-01 00:00:00'")


def _texts(frame: DataFrame) -> DataFrame:
    return frame.withColumns({c: F.col(c).cast("string") for c in ("created_at", "started_at", "completed_at")})


def rh_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters_ = [F.col("status") == "completed", F.col("created_at") < _now()]
    order = [F.desc("created_at"), F.asc("id")]
    return _texts(history.page(runs(spark, sf_dir), filters_, order, skip=20, limit=50)).select("id", "status", "created_at")


def rh_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.count(runs(spark, sf_dir), [F.col("status") == "failed", F.col("started_at").isNotNull()], "id")


def rh_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = load(spark, sf_dir, "lineitem").selectExpr("l_partkey * 20 as id").distinct()
    return history.existing(wanted, runs(spark, sf_dir), "id")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").selectExpr(
        "c_custkey * 3 as id", "if(c_nationkey < 10, 'cancelled', null) as status", "if(c_acctbal > 0, c_mktsegment, null) as error_code"
    )


def rh_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New runs added, then given fields of existing runs replaced."""
    added = load(spark, sf_dir, "customer").selectExpr("-1 - c_custkey as id", "'pending' as status")
    grown = history.insert(runs(spark, sf_dir).select("id", "status", "error_code"), added)
    return history.update(grown, _changes(spark, sf_dir), "id")


def rh_update_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.updated_count(runs(spark, sf_dir), _changes(spark, sf_dir), "id")


def rh_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = load(spark, sf_dir, "lineitem").where("l_quantity > 25").selectExpr("l_orderkey as id")
    return history.delete(runs(spark, sf_dir), ids, "id").select("id", "status")


def rh_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.running_count(runs(spark, sf_dir))


def rh_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.retained(runs(spark, sf_dir), 720, _now()).select("id", "status")


def rh_mark_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(history.mark_interrupted(runs(spark, sf_dir), _now()))


def rh_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = history.duration(F.col("started_at"), F.col("completed_at"), _now())
    return runs(spark, sf_dir).select("id", seconds.alias("duration"))


def rh_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history as a stored table after three changes, and how many buckets a fourth one, of a single run, has rewritten."""
    store = RunStore.create(spark, shared_folder(spark), runs(spark, sf_dir).select("id", "status", "created_at", "error_code"), buckets=16)
    added = load(spark, sf_dir, "customer").selectExpr("-1 - c_custkey as id", "'pending' as status", "cast(null as string) as error_code")
    store.upsert(_changes(spark, sf_dir).where("id > 0").unionByName(added))
    store.delete(load(spark, sf_dir, "lineitem").where("l_quantity > 25").selectExpr("l_orderkey as id"))
    store.retain(720, _now())
    before, version = store.files(), store.version()
    store.upsert(spark.sql("select -2L as id, 'cancelled' as status"))
    after = store.files()
    rewritten = sum(before.get(b) != after.get(b) for b in before.keys() | after.keys())
    known = store.read().select("id", "status", F.col("created_at").cast("string").alias("created_at"), "error_code")
    return known.withColumns({"version": F.lit(version), "rewritten": F.lit(rewritten)})


# ── The whole text stage ──────────────────────────────────────────────────────


def model(questions: pd.Series) -> pd.Series:
    """A deterministic stand-in for a model: answers that follow from the text of the question."""

    def answer(prompt: str) -> str:
        table = re.search(r"^Table: (.*)$", prompt, re.M)
        if prompt.startswith("Write one to three"):
            return f"all about {table[1]}"
        if prompt.startswith("Write one or two"):
            return f"one of {table[1]}: " + re.search(r"^Column:\n  - (\S+)", prompt, re.M)[1]
        if prompt.startswith("Name up to"):
            return json.dumps({"terms": [{"business_term": f"term of {table[1]}", "description": "d", "synonyms": ["s"]}]})
        if prompt.startswith("Sort these"):
            return json.dumps({"domains": [{"domain": "everything", "tables": re.findall(r"^  - (.*)$", prompt, re.M)}]})
        if prompt.startswith("Propose"):
            named = prompt.partition("may only name these columns:\n")[2]
            first = re.search(r"^  - (.*)$", named, re.M)[1]
            return json.dumps({"kpis": [{"name": "first", "description": "d", "calculation": "count", "linked_columns": [first, "no.column"]}]})
        if prompt.startswith("Judge"):
            judged = re.findall(r'"column_name":"([^"]*)"', prompt)
            return json.dumps({"columns": [{"column_name": c, "filter_name": f"by {c}", "llm_confidence": 0.91237, "llm_filter_type": "range", "reasoning": "because"} for c in judged]})
        asked = re.findall(r'^\[?\{"name":"([^"]*)"', prompt, re.M)
        return json.dumps({"columns": [{"column_name": c, "is_sensitive": c.endswith("1"), "sensitivity_type": "email"} for c in asked]})

    return questions.map(answer)


def aug_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer of the text stage merged into its place, from tables to descriptions, glossary, sensitivity, KPIs and judgments."""
    tables = wide_tables(spark, sf_dir).withColumn("row_count", F.col("row_count").cast("bigint"))
    scored = columnar(candidates(spark, sf_dir, top=True))  # one row per column, read twice
    roles = scored.select("table_name").distinct().withColumn("table_role", F.lit("unknown"))
    ledger = AnswerLedger(spark, shared_folder(spark), model, 100_000)
    done = text_stage(ledger, tables, wide_columns(spark, sf_dir), scored, roles, domain_split="part")
    none = F.lit(None).cast("string")
    described = done.tables.select(F.lit("table").alias("kind"), "table_name", none.alias("name"), F.col("table_description").alias("value"))
    terms = done.tables.select(F.lit("glossary").alias("kind"), "table_name", none.alias("name"), F.col("glossary")[0]["business_term"].alias("value"))
    columns = done.columns.select(F.lit("column").alias("kind"), "table_name", F.col("column_name").alias("name"), F.concat_ws("|", "description", "sensitivity_type").alias("value"))
    kpis = done.kpis.select(F.lit("kpi").alias("kind"), F.col("domain").alias("table_name"), "name", F.array_join("linked_columns", ",").alias("value"))
    chosen = done.filters.select(F.lit("filter").alias("kind"), "table_name", F.col("filter_name").alias("name"), F.concat_ws("|", "confidence_source", F.col("confidence").cast("string")).alias("value"))
    return described.unionAll(terms).unionAll(columns).unionAll(kpis).unionAll(chosen)


QUERIES = {
    f.__name__: f
    for f in (
        sn_batches, sn_sample_text, sn_prompt, sn_parse, sn_level, sn_apply, sn_rollup, sn_classifier,
        aug_column_summary, aug_table_prompt, aug_column_prompt, aug_glossary_prompt, aug_kpi_cluster_prompt,
        aug_kpi_prompt, aug_filter_judge_prompt, aug_extract_json, aug_parse_glossary, aug_parse_judgments,
        aug_parse_domains, aug_kpi_map_reduce, aug_valid_columns, aug_apply, aug_usage, rh_page, rh_count, rh_exists,
        rh_upsert, rh_update_count, rh_delete, rh_running, rh_retention, rh_mark_stale, rh_duration, rh_store, aug_stage,
    )
}


# ── SQL ───────────────────────────────────────────────────────────────────────

_W = f"with w as ({COLUMNS.format(lineitem='lineitem', orders='orders')}), t as ({TABLES.format(customer='customer')})"
_LINE = """'  - ' || column_name || ' (' || data_type || ')' || case when is_primary_key then ' [PK]' else '' end || case when is_nullable then '' else ' [NOT NULL]' end
    || case when l_partkey % 3 = 2 then ' enum: [' || l_returnflag || ', ' || l_linestatus || ']' else '' end
    || ' samples: [' || l_returnflag || ', ' || l_partkey || ']' || case when description is not null then ' pg_desc: ' || description else '' end"""
_ABOUT = "case when coalesce(table_description, '') = '' then '(none)' else table_description end"



def _more(count: str, limit: int, note: str) -> str:
    return f"case when {count} > {limit} then chr(10) || '  (not shown: ' || ({count} - {limit}) || '{note})' else '' end"


def _block(limit: int, note: str) -> str:
    return f"(select string_agg({_LINE}, chr(10) order by ordinal) filter (ordinal <= {limit}) || {_more('count(*)', limit, note)} from w where w.table_name = t.table_name)"


_SENSITIVE = "l_returnflag in ('A', 'R') and o_custkey % 6 not in (2, 3) and not (o_custkey % 6 = 5 and column_name = 'c1')"
_VERDICTS = f"""select table_name, (ordinal - 1) // 20 as batch, column_name, {_SENSITIVE} as is_sensitive,
    case when {_SENSITIVE} then case l_partkey % 4 when 0 then 'email' when 3 then 'ssn' else 'other_unique_id' end end as sensitivity_type from w"""
_LEVEL_VALUES = ", ".join(f"('{code}', '{level}')" for level, codes in sensitivity.LEVELS.items() for code in codes)


def _evidence_sql() -> str:
    parts = []
    for table, columns in EVIDENCE_TABLES.items():
        for column in columns:
            name = "user_name" if (table, column) == ("conversations", "text") else column
            shares = {
                kind: f"avg(regexp_matches({column}, '{pattern}')::int)" for kind, pattern in sensitivity.EVIDENCE.items()
            }
            shown = " ".join(f"when {share} >= 0.5 then '{kind}'" for kind, share in shares.items())
            suggested = f"case when '{name}' = 'user_name' then 'name' {shown} end"
            fields = ", ".join(f"round({share}, 6) as {kind}_share" for kind, share in shares.items())
            parts.append(
                f"select '{table}' as table_name, '{name}' as column_name, {suggested} is not null as is_sensitive, {suggested} as sensitivity_type, {fields} from {table}"
            )
    return " union all ".join(parts)


_DOMAIN = "part || '_' || c_mktsegment"
_RUNS = f"with r as ({RUNS.format(orders='orders')})"

_PLACES = ", ".join(f"('{t}', '{c}', {i})" for t, columns in MEASURED.items() for i, c in enumerate(columns))

ORACLE = {
    "sn_prompt": _W
    + f""" select table_name, ((ordinal - 1) // 20)::int as batch, 'Decide for every column below whether it holds personal or health information.' || chr(10) || chr(10) || 'Table: ' || table_name
        || chr(10) || 'Description: ' || coalesce(nullif(any_value(table_description), ''), '(no description)') || chr(10) || 'Columns:' || chr(10) || '['
        || string_agg('{{"name":"' || column_name || '","data_type":"' || data_type || '"' || case when description is not null then ',"description":"' || description || '"' else '' end
            || ',"sample_values":["' || l_returnflag || '","null","' || l_partkey || '","' || l_linestatus || '"]}}', ',' || chr(10) order by ordinal)
        || ']' || chr(10) || chr(10) || 'Allowed values of sensitivity_type: {", ".join(sensitivity.TYPES)}.' || chr(10)
        || 'Record timestamps, keys of business objects, status flags and aggregates are not sensitive.' || chr(10)
        || 'Answer with JSON only: {{"columns": [{{"column_name": ..., "is_sensitive": true or false, "sensitivity_type": ... or null}}]}} with one entry for every column.' as prompt
        from w join t using (table_name) group by table_name, (ordinal - 1) // 20""",
    "aug_kpi_cluster_prompt": _W
    + """ select part, 'Sort these tables into 1 to 5 business domains, each table into exactly one.' || chr(10) || chr(10) || string_agg('  - ' || table_name, chr(10) order by table_name)
        || chr(10) || chr(10) || 'Answer with JSON only: {"domains": [{"domain": ..., "tables": [...]}]}' as prompt from t group by part""",
    "aug_filter_judge_prompt": f"""select table_name, 'Judge for each column whether analysts would filter by it. Be wary of audit columns, coded ids and mostly empty columns.' || chr(10) || chr(10)
        || 'Table: ' || table_name || chr(10) || 'Role: unknown' || chr(10) || 'Columns:' || chr(10) || '[' || string_agg(payload, ',' || chr(10) order by place)
        || ']' || chr(10) || chr(10) || 'Answer with JSON only: {{"columns": [{{"filter_name": ..., "column_name": ..., "llm_confidence": 0 to 1, '
        || '"llm_filter_type": "temporal", "boolean", "categorical" or "range", "agrees_with_heuristic": ..., "reasoning": ...}}]}}' as prompt
        from ({FILTERING["fd_judge_payload"]}) join (values {_PLACES}) v(table_name, column_name, place) using (table_name, column_name) group by table_name""",
    "sn_batches": _W + " select table_name, column_name, ((ordinal - 1) // 20)::int as batch from w",
    "sn_sample_text": "select doc_id, concat_ws('|', s, 'null', lang, source, s) as samples from (select *, case when len(text) > 50 then text[1:50] || '...' else text end as s from documents)",
    "sn_parse": _W + " " + _VERDICTS,
    "sn_level": f"""with l as (select code, level, (row_number() over (order by code) - 1) as i from (values {_LEVEL_VALUES}) v(code, level))
        select code as sensitivity_type, level, count(*) as n from orders left join l on l.i = o_orderkey % 46 group by code, level""",
    "sn_apply": _W
    + f""", v as ({_VERDICTS}), l as (select * from (values {_LEVEL_VALUES}) x(sensitivity_type, level))
        select table_name, column_name, batch <> 1 and is_sensitive as is_sensitive, case when batch <> 1 then sensitivity_type end as sensitivity_type,
        case when batch <> 1 then level end as sensitivity_level from v left join l using (sensitivity_type)""",
    "sn_rollup": _W
    + f", v as ({_VERDICTS}) select table_name, batch, count(*) as column_count, count(*) filter (is_sensitive) as sensitive_column_count from v group by all",
    "sn_classifier": _evidence_sql(),
    "aug_column_summary": _W + f" select table_name, column_name, {_LINE} as line from w",
    "aug_table_prompt": _W
    + f""" select table_name, 'Write one to three sentences on what this table means to the business. Plain text only.' || chr(10) || chr(10) || 'Table: ' || table_name
        || chr(10) || 'Description: ' || {_ABOUT} || chr(10) || 'Rows: ' || coalesce(row_count::varchar, 'unknown') || chr(10) || 'Columns:' || chr(10)
        || {_block(20, ' further columns')} || chr(10) as prompt from t where exists (select 1 from w where w.table_name = t.table_name)""",
    "aug_column_prompt": _W
    + f""", n as (select table_name, count(*) as width, list(struct_pack(o := ordinal, l := '  - ' || column_name || ' (' || data_type || ')') order by ordinal) as cols from w group by table_name)
        select w.table_name, column_name, 'Write one or two sentences on what this column holds. Plain text only.' || chr(10) || chr(10) || 'Table: ' || w.table_name
        || chr(10) || 'Description: ' || {_ABOUT} || chr(10) || 'Column:' || chr(10) || {_LINE} || chr(10) || 'Other columns:' || chr(10)
        || coalesce(array_to_string(list_transform(list_filter(cols, lambda e: e.o <> ordinal)[1:10], lambda e: e.l), chr(10)), '')
        || {_more('(width - 1)', 10, ' further columns')} as prompt from w join n using (table_name) join t using (table_name)""",
    "aug_glossary_prompt": _W
    + f""" select table_name, 'Name up to 5 business terms that this table supports.' || chr(10) || chr(10) || 'Table: ' || table_name
        || chr(10) || 'Description: ' || {_ABOUT} || chr(10) || 'Rows: ' || coalesce(row_count::varchar, 'unknown') || chr(10) || 'Columns:' || chr(10)
        || {_block(20, ' further columns')} || chr(10) || chr(10)
        || 'Answer with JSON only: {{"terms": [{{"business_term": ..., "description": ..., "synonyms": [...]}}]}}' as prompt
        from t where exists (select 1 from w where w.table_name = t.table_name)""",
    "aug_kpi_prompt": _W
    + f""", d as (select *, {_DOMAIN} as domain, row_number() over (partition by part, c_mktsegment order by c_custkey) as rank,
        count(*) over (partition by part, c_mktsegment) as size, {_block(10, ' further columns')} as block,
        (select string_agg('  - ' || split_part(w.table_name, '.', 2) || '.' || column_name, chr(10) order by ordinal) from w where w.table_name = t.table_name and ordinal <= 10) as names from t)
        select domain, 'Propose up to 5 indicators worth a dashboard for this business domain; none is a valid answer.' || chr(10) || chr(10) || 'Domain: ' || domain || chr(10) || chr(10)
        || string_agg('  Table: ' || table_name || ' (rows: ' || coalesce(row_count::varchar, 'unknown') || ', about: ' || {_ABOUT} || ')' || chr(10) || block, chr(10) || chr(10) order by rank)
        || {_more('any_value(size)', 15, ' further tables')} || chr(10) || chr(10) || 'linked_columns may only name these columns:' || chr(10) || string_agg(names, chr(10) order by rank)
        || chr(10) || chr(10) || 'Answer with JSON only: {{"kpis": [{{"name": ..., "description": ..., "calculation": ..., "linked_columns": [...]}}]}}' as prompt
        from d where rank <= 15 and block is not null group by domain""",
    "aug_extract_json": """select conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as content from conversations""",
    "aug_parse_glossary": _W
    + """ select table_name, case when c_custkey % 10 = 3 or c_custkey % 11 = 5 then '' else array_to_string(list_transform(range(1, 1 + least(5, 1 + c_custkey % 7)),
        lambda i: c_mktsegment || ' ' || i || '/' || case when i = 1 then 0 else 2 end), ',') end as terms from t""",
    "aug_parse_judgments": """select o_orderkey, 0 as place, case when o_custkey % 3 = 0 then 'A' else '' end as filter_name, 'a' as column_name,
        case when o_custkey % 2 = 0 then (o_custkey % 10) / 10.0::double else 0.5::double end as llm_confidence, 'categorical' as llm_filter_type, o_custkey % 3 <> 0 as agrees_with_heuristic, '' as reasoning
        from orders where o_custkey % 5 <> 0
        union all select o_orderkey, 1, '', 'b', 1.0, 'range', true, 'None' from orders where o_custkey % 5 <> 0""",
    "aug_parse_domains": _W
    + """, d as (select part, c_mktsegment as domain, dense_rank() over (partition by part order by c_mktsegment)::int as domain_place,
        (row_number() over (partition by part, c_mktsegment order by c_custkey) - 1)::int as place, table_name from t)
        select * from d union all select part, domain, any_value(domain_place), count(*)::int, 'ghost.t' from d group by part, domain""",
    "aug_kpi_map_reduce": _W
    + f""", d as (select *, dense_rank() over (partition by part order by c_mktsegment)::int as domain_place,
        (row_number() over (partition by part, c_mktsegment order by c_custkey) - 1)::int as place from t)
        select {_DOMAIN} as domain, domain_place, place, 'k' || c_custkey as name, 5 as links from d where place < 15""",
    "aug_valid_columns": _W
    + f""", d as (select *, (row_number() over (partition by part, c_mktsegment order by c_custkey) - 1)::int as place, split_part(table_name, '.', 2) as b,
        (select count(*) from w where w.table_name = t.table_name) as width from t)
        select {_DOMAIN} as domain, place, 'k' || c_custkey as name, case when place >= 15 or width = 0 then '' when width = 1 then b || '.c1,' || b || '.c1'
        else b || '.c1,' || b || '.c2,' || b || '.c1' end as linked_columns from d where place < 20""",
    "aug_apply": _W + " select table_name, case when c_custkey % 3 = 2 then 'about ' || table_name else table_description end as description from t",
    "aug_usage": """select l_orderkey, sum(l_partkey)::bigint as input_tokens, sum(l_suppkey)::bigint as output_tokens, round(sum(l_discount), 8) as input_cost, round(sum(l_tax), 8) as output_cost,
        round(sum(l_discount + l_tax), 8) as total_cost, sum(l_linenumber)::bigint as estimated_text_tokens, (3 * count(*))::bigint as estimated_overhead_tokens,
        sum(l_linenumber + 3)::bigint as estimated_total_tokens, (2 * count(*))::bigint as estimated_message_count, round(sum(l_quantity), 2) as total_latency_ms from lineitem group by l_orderkey""",
    "rh_page": _RUNS + f" select id, status, created_at::varchar as created_at from r where status = 'completed' and created_at < {NOW} order by created_at desc, id limit 50 offset 20",
    "rh_count": _RUNS + " select count(id) as count from r where status = 'failed' and started_at is not null",
    "rh_exists": "select distinct l_partkey * 20 as id, exists (select 1 from orders where o_orderkey = l_partkey * 20) as present from lineitem",
    "rh_upsert": _RUNS
    + """, u as (select id, status, null::varchar as error_code from r union all select -1 - c_custkey, 'pending', null from customer),
        c as (select c_custkey * 3 as id, case when c_nationkey < 10 then 'cancelled' end as status, case when c_acctbal > 0 then c_mktsegment end as error_code from customer)
        select id, coalesce(c.status, u.status) as status, coalesce(c.error_code, u.error_code) as error_code from u left join c using (id)""",
    "rh_update_count": "select count(*) as updated_count from orders where o_orderkey in (select c_custkey * 3 from customer)",
    "rh_delete": _RUNS + " select id, status from r where id not in (select l_orderkey from lineitem where l_quantity > 25)",
    "rh_running": _RUNS + " select count(*) filter (status in ('connecting', 'profiling', 'augmenting')) as running_count from r",
    "rh_retention": _RUNS + f" select id, status from r where not (status in ('completed', 'failed', 'cancelled') and created_at < {NOW} - interval 720 hour)",
    "rh_mark_stale": _RUNS
    + f""", s as (select *, status in ('pending', 'connecting', 'profiling', 'augmenting', 'cancelling') as stale from r)
        select id, case when stale then 'failed' else status end as status, created_at::varchar as created_at, started_at::varchar as started_at,
        case when stale then {NOW} else completed_at end::varchar as completed_at, case when stale then 'SERVER_RESTART' end as error_code,
        case when stale then 'Task was interrupted by server restart' end as error_message from s""",
    "rh_store": _RUNS
    + f""", c as (select c_custkey * 3 as id, case when c_nationkey < 10 then 'cancelled' end as status, case when c_acctbal > 0 then c_mktsegment end as error_code from customer),
        u as (select id, status, created_at, null::varchar as error_code from r
            union all select id, null, null, null from c where id not in (select id from r)
            union all select -1 - c_custkey, 'pending', null, null from customer),
        g as (select id, coalesce(c.status, u.status) as status, created_at, coalesce(c.error_code, u.error_code) as error_code from u left join c using (id)),
        k as (select * from g where id not in (select l_orderkey from lineitem where l_quantity > 25)
            and not coalesce(status in ('completed', 'failed', 'cancelled') and created_at < {NOW} - interval 720 hour, false))
        select id, case when id = -2 then 'cancelled' else status end as status, created_at::varchar as created_at, error_code, 3 as version, 1 as rewritten from k""",
    "aug_stage": SCORED.replace("case when ordinal % 2 = 1 then (distinct_count * 37 % 100) / 100.0::double end as judged", "0.91237::double as judged")
    + f""", w as ({COLUMNS.format(lineitem='lineitem', orders='orders')}), t as ({TABLES.format(customer='customer')}),
        h as (select t.*, exists (select 1 from w where w.table_name = t.table_name) as asked from t),
        f1 as (select *, triage = 'review' as by_judge from s where triage <> 'reject'),
        f2 as (select *, case when by_judge then decided else composite end as confidence from f1),
        dom as (select h.part, split_part(h.table_name, '.', 2) || '.' || column_name as ref, row_number() over (partition by h.part order by h.table_name, ordinal) as place
            from h join w using (table_name) where ordinal = 1),
        l as (select part, count(*) as tables from t group by part)
        select 'table' as kind, table_name, null as name, case when asked then 'all about ' || table_name else table_description end as value from h
        union all select 'glossary', table_name, null, case when asked then 'term of ' || table_name end from h
        union all select 'column', table_name, column_name, 'one of ' || table_name || ': ' || column_name || case when column_name like '%1' then '|email' else '' end from w
        union all select 'kpi', part || ' / everything', 'first', (select min(ref order by place) from dom where dom.part = l.part and place = 1) from l where part in (select part from dom)
        union all select 'filter', table_name, case when by_judge then 'by ' || column_name else column_name end,
            case when by_judge then source else 'heuristic_only' end || '|' || confidence from f2 where triage = 'accept' or confidence >= 0.50""",
    "rh_duration": _RUNS + f" select id, round(epoch_us(coalesce(completed_at, {NOW}) - started_at) / 1e6, 3) as duration from r",
}
