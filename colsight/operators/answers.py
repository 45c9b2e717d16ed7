"""Reading model answers, and merging them into descriptions, glossaries, filters and KPIs.

An answer that cannot be read never fails a job: it gives an empty result for its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsight.functions import text
from colsight.operators.prompts import DOMAIN_COLUMNS, GLOSSARY_TERMS, bare_table, domain_tables, leading


def _items(response: str, name: str) -> Column:
    return text.items(F.try_parse_json(text.extract_json(F.col(response))), f"$.{name}")


def _strings(item: Column, name: str) -> Column:
    """A list of strings; empty where the field is missing, NULL where it is something else."""
    missing = text.field(item, name).isNull()
    return F.when(missing, F.array().cast("array<string>")).otherwise(F.try_variant_get(item, f"$.{name}", "array<string>"))


def glossaries(answers: DataFrame, response: str = "response") -> DataFrame:
    """Adds ``terms``: the first terms of the answer; empty if one of them has no name or description or wrong synonyms."""

    def term(item: Column) -> Column:
        return F.struct(
            text.strict_string(item, "business_term").alias("business_term"),
            text.strict_string(item, "description").alias("description"),
            _strings(item, "synonyms").alias("synonyms"),
        )

    read = F.transform(F.slice(_items(response, "terms"), 1, GLOSSARY_TERMS), term)
    broken = F.exists("_terms", lambda t: t["business_term"].isNull() | t["description"].isNull() | t["synonyms"].isNull())
    nothing = F.slice(F.array(F.struct(F.lit("").alias("business_term"), F.lit("").alias("description"), F.array(F.lit("")).alias("synonyms"))), 1, 0)
    usable = F.col("_terms").isNotNull() & ~broken
    return (
        answers.withColumn("_terms", read)
        .withColumn("terms", F.when(usable, F.col("_terms")).otherwise(nothing))
        .drop("_terms")
    )


def _printed(item: Column, name: str, default: str) -> Column:
    """A field as text: the default where it is missing, ``None`` where it is null."""
    value = text.field(item, name)
    return (
        F.when(value.isNull(), default)
        .when(F.is_variant_null(value), "None")
        .otherwise(F.coalesce(text.string_field(item, name), F.to_json(value)))
    )


def judgments(answers: DataFrame, response: str = "response") -> DataFrame:
    """One row per judged column of each answer; ``place`` is its position in the answer.

    Missing fields take defaults. A confidence that is not a number spoils the whole answer.
    """
    read = answers.withColumn("_items", _items(response, "columns"))

    def confidence(item: Column) -> Column:
        given = F.try_variant_get(item, "$.llm_confidence", "double")
        return F.when(text.field(item, "llm_confidence").isNull(), 0.5).otherwise(given)

    def spoiled(item: Column) -> Column:
        is_object = text.kind_of(item).startswith("OBJECT")
        return ~is_object | confidence(item).isNull()

    usable = read.where(~F.exists("_items", spoiled))
    kept = [name for name in answers.columns if name != response]
    exploded = usable.select(*kept, F.posexplode("_items").alias("place", "item"))
    item = F.col("item")
    agrees = text.field(item, "agrees_with_heuristic")
    falsy = F.coalesce(F.is_variant_null(agrees), F.lit(False)) | text.string_field(item, "agrees_with_heuristic").isin(
        "false", "0", ""
    )
    return exploded.select(
        *kept,
        "place",
        _printed(item, "filter_name", "").alias("filter_name"),
        _printed(item, "column_name", "").alias("column_name"),
        confidence(item).alias("llm_confidence"),
        _printed(item, "llm_filter_type", "categorical").alias("llm_filter_type"),
        F.when(agrees.isNull(), True).otherwise(~F.coalesce(falsy, F.lit(False))).alias("agrees_with_heuristic"),
        _printed(item, "reasoning", "").alias("reasoning"),
    )


def last_judgments(judged: DataFrame) -> DataFrame:
    """One judgment per column: the last of an answer counts."""
    fields = ["filter_name", "llm_confidence", "llm_filter_type", "agrees_with_heuristic", "reasoning"]
    last = judged.groupBy("table_name", "column_name").agg(F.max_by(F.struct(*fields), "place").alias("j"))
    return last.select("table_name", "column_name", "j.*")


def domains(answers: DataFrame, response: str = "response") -> DataFrame:
    """``(…, domain, domain_place, place, table_name)``: the tables of every named, non-empty domain.

    A domain named twice keeps its first position and its last list. An entry that is no object spoils its answer.
    """
    kept = [name for name in answers.columns if name != response]
    read = answers.select(*kept, _items(response, "domains").alias("_items"))
    usable = read.where(~F.exists("_items", lambda item: ~text.kind_of(item).startswith("OBJECT")))
    exploded = usable.select(*kept, F.posexplode("_items").alias("at", "item"))
    item = F.col("item")
    named = exploded.select(
        *kept, "at", text.stripped(_printed(item, "domain", "")).alias("domain"), _strings(item, "tables").alias("tables")
    ).where((F.col("domain") != "") & (F.size("tables") > 0))
    merged = named.groupBy(*kept, "domain").agg(F.min("at").alias("domain_place"), F.max_by("tables", "at").alias("tables"))
    return merged.select(*kept, "domain", "domain_place", F.posexplode("tables").alias("place", "table_name"))


def known_domains(named: DataFrame, tables: DataFrame) -> DataFrame:
    """Domain tables that exist; domains without one disappear."""
    return named.join(tables.select("table_name").distinct(), "table_name")


def kpis(answers: DataFrame, max_kpis: int, response: str = "response") -> DataFrame:
    """``(…, place, name, description, calculation, linked_columns)`` of every domain's answer.

    A KPI without name or description, or with wrong links, spoils its whole answer.
    """

    def kpi(item: Column) -> Column:
        return F.struct(
            text.strict_string(item, "name").alias("name"),
            text.strict_string(item, "description").alias("description"),
            text.strict_string(item, "calculation").alias("calculation"),
            _strings(item, "linked_columns").alias("linked_columns"),
        )

    kept = [name for name in answers.columns if name != response]
    read = answers.select(*kept, F.transform(F.slice(_items(response, "kpis"), 1, max_kpis), kpi).alias("_kpis"))
    whole = read.where(~F.exists("_kpis", lambda k: k["name"].isNull() | k["description"].isNull() | k["linked_columns"].isNull()))
    return whole.select(*kept, F.posexplode("_kpis").alias("place", "kpi")).select(*kept, "place", "kpi.*")


def valid_columns(domains: DataFrame, columns: DataFrame) -> DataFrame:
    """``(domain, ref)``: the ``table.column`` names that the KPIs of a domain may refer to."""
    named = leading(columns, DOMAIN_COLUMNS).select("table_name", F.concat(bare_table(), F.lit("."), "column_name").alias("ref"))
    return domain_tables(domains).join(named, "table_name").select("domain", "ref").distinct()


def keep_valid_links(found: DataFrame, valid: DataFrame) -> DataFrame:
    """KPIs whose links all exist: others are removed, order and repetitions of the rest are kept."""
    links = found.select("domain", "place", F.posexplode("linked_columns").alias("at", "ref"))
    good = links.join(valid, ["domain", "ref"], "left_semi")
    entries = F.array_sort(F.collect_list(F.struct("at", "ref")))
    lists = good.groupBy("domain", "place").agg(F.transform(entries, lambda e: e["ref"]).alias("kept"))
    none = F.array().cast("array<string>")
    return found.join(lists, ["domain", "place"], "left").withColumn("linked_columns", F.coalesce("kept", none)).drop("kept")


def apply_descriptions(rows: DataFrame, answers: DataFrame, key: list[str], field: str = "description") -> DataFrame:
    """A non-empty answer replaces ``field``; otherwise the old text stays. Of several answers the largest text wins."""
    new = answers.groupBy(*key).agg(F.max(F.expr("nullif(response, '')")).alias("_new"))
    return rows.join(new, key, "left").withColumn(field, F.coalesce("_new", field)).drop("_new")


def apply_glossaries(tables: DataFrame, parsed: DataFrame) -> DataFrame:
    """Tables with ``glossary``: NULL where the answer gave no term."""
    terms = parsed.where(F.size("terms") > 0).select("table_name", F.col("terms").alias("glossary"))
    return tables.join(terms, "table_name", "left")


COUNTED = ("input_tokens", "output_tokens")
COSTS = ("input_cost", "output_cost", "total_cost")
ESTIMATED = (
    "estimated_text_tokens", "estimated_overhead_tokens", "estimated_total_tokens", "estimated_message_count",
)


def usage(calls: DataFrame, *by: str) -> DataFrame:
    """Totals of a call log per group; groups without cost, estimate or latency are left out."""
    sums = [F.sum(name).cast("bigint").alias(name) for name in COUNTED + ESTIMATED]
    sums += [F.round(F.sum(name), 8).alias(name) for name in COSTS]
    sums.append(F.round(F.sum("latency_ms"), 2).alias("total_latency_ms"))
    totals = calls.groupBy(*by).agg(*sums)
    return totals.where("total_cost > 0 or estimated_total_tokens > 0 or total_latency_ms > 0")
