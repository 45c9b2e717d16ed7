"""Sensitive columns: batches for a classifier, its answers, risk levels, and evidence in the data."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsight.functions import text
from colsight.functions import types as kinds
from colsight.functions.rows import table_key
from colsight.functions.values import quoted
from colsight.operators.cells import Dataset, column_frame, empty, union_all

# The sensitivity types and the risk level each one carries.
LEVELS = {
    "critical": (
        "ssn", "medical_record_number", "biometric", "credit_card", "passport", "national_id", "login_credential",
        "genetic_data", "mental_health", "substance_abuse", "sexual_orientation",
    ),
    "high": (
        "address", "date", "phone_number", "email", "health_plan_id", "account_number", "license_number", "ip_address",
        "age_over_89", "bank_routing", "tax_id", "drivers_license", "diagnosis_code", "procedure_code", "medication",
        "lab_result", "financial_data", "geolocation", "ethnicity", "religion", "political_affiliation",
        "criminal_record",
    ),
    "medium": (
        "name", "vehicle_id", "device_id", "web_url", "photo", "other_unique_id", "insurance_policy", "vital_sign",
        "gender", "internal_metrics",
    ),
    "low": ("employee_id", "customer_id"),
}
TYPES = tuple(code for codes in LEVELS.values() for code in codes)
UNKNOWN_TYPE = "other_unique_id"
LONGEST_SAMPLE, MOST_SAMPLES = 50, 5

_KEY = ["table_name", "column_name"]


def level_of(sensitivity_type: Column) -> Column:
    level = F.lit(None).cast("string")
    for name, codes in LEVELS.items():
        level = F.when(sensitivity_type.isin(*codes), name).otherwise(level)
    return level


def batches(columns: DataFrame, size: int) -> DataFrame:
    """Adds ``batch``: consecutive groups of ``size`` columns per table, counted from 0."""
    place = F.row_number().over(Window.partitionBy("table_name").orderBy("ordinal"))
    return columns.withColumn("batch", F.floor((place - 1) / size).cast("int"))


def sample_texts(values: Column) -> Column:
    """The first samples as short text: NULL as ``null``, long text cut and marked."""

    def shorten(v: Column) -> Column:
        cut = F.concat(F.substring(v, 1, LONGEST_SAMPLE), F.lit("..."))
        return F.when(v.isNull(), "null").when(F.length(v) > LONGEST_SAMPLE, cut).otherwise(v)

    return F.transform(F.slice(values, 1, MOST_SAMPLES), shorten)


def prompts(columns: DataFrame) -> DataFrame:
    """``(table_name, batch, prompt)``: one question per batch of columns.

    Needs ``table_description, ordinal, data_type, description, sample_values`` beside the keys.
    """
    described = F.when(F.col("description") != "", F.col("description"))
    sampled = F.when(F.size("sample_values") > 0, sample_texts(F.col("sample_values")))
    entry = F.struct(
        F.col("column_name").alias("name"), "data_type", described.alias("description"), sampled.alias("sample_values")
    )
    # At most one batch of columns per group.
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", F.to_json(entry).alias("entry"))))
    listed = F.array_join(F.transform(ordered, lambda e: e["entry"]), ",\n")
    grouped = columns.groupBy("table_name", "batch").agg(
        listed.alias("listed"), F.first("table_description", ignorenulls=True).alias("table_description")
    )
    description = F.coalesce(F.expr("nullif(table_description, '')"), F.lit("(no description)"))
    prompt = F.concat(
        F.lit("Decide for every column below whether it holds personal or health information.\n\nTable: "),
        F.col("table_name"), F.lit("\nDescription: "), description, F.lit("\nColumns:\n["), F.col("listed"),
        F.lit("]\n\nAllowed values of sensitivity_type: "), F.lit(", ".join(TYPES)),
        F.lit(
            ".\nRecord timestamps, keys of business objects, status flags and aggregates are not sensitive.\n"
            'Answer with JSON only: {"columns": [{"column_name": ..., "is_sensitive": true or false, '
            '"sensitivity_type": ... or null}]} with one entry for every column.'
        ),
    )
    return grouped.select("table_name", "batch", prompt.alias("prompt"))


def ask(questions: DataFrame, answer: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Adds ``response`` by calling ``answer`` on batches of prompts; a failing call gives NULL."""
    out = questions.select("*", F.lit(None).cast("string").alias("response")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            try:
                responses = answer(frame["prompt"])
            except Exception:  # a failed batch keeps its defaults
                responses = None
            yield frame.assign(response=responses)

    return questions.mapInPandas(run, out)


def parse_responses(responses: DataFrame, columns: DataFrame) -> DataFrame:
    """Verdict of every column of the asked batches: ``is_sensitive, sensitivity_type``.

    Columns an answer does not name, and answers that cannot be read, are not sensitive. Names that
    were not asked for are ignored; of several entries for a column the last counts.
    """
    # Outer: else every answer is read once more, by a filter for those with entries.
    entries = responses.select(
        "table_name", "batch", F.posexplode_outer(text.items(text.parse_answer(F.col("response")), "$.columns")).alias("place", "item")
    )
    item = F.col("item")
    yes = F.lower(text.string_field(item, "is_sensitive")) == "true"
    code = text.string_field(item, "sensitivity_type")
    read = entries.select(
        "table_name", "batch", "place", text.string_field(item, "column_name").alias("column_name"),
        F.coalesce(yes, F.lit(False)).alias("yes"),
        F.when(code.isin(*TYPES), code).otherwise(UNKNOWN_TYPE).alias("code"),
    )
    last = read.groupBy("table_name", "batch", "column_name").agg(F.max_by(F.struct("yes", "code"), "place").alias("said"))
    yes = F.coalesce("said.yes", F.lit(False))
    # The estimated size of entries read from JSON is far too small: without the hint all of them would be broadcast.
    return columns.join(last.hint("merge"), ["table_name", "batch", "column_name"], "left").select(
        *columns.columns, yes.alias("is_sensitive"), F.when(yes, F.col("said.code")).alias("sensitivity_type")
    )


def apply_verdicts(columns: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Columns with verdict and risk level; those without a verdict are not sensitive."""
    key = table_key(columns, verdicts, column=True)
    joined = columns.join(verdicts.select(*key, "is_sensitive", "sensitivity_type"), key, "left")
    kind = F.col("sensitivity_type")
    return joined.withColumns({"is_sensitive": F.coalesce("is_sensitive", F.lit(False)), "sensitivity_level": level_of(kind)})


def rollup(verdicts: DataFrame, *by: str) -> DataFrame:
    """Number of columns and of sensitive ones per group."""
    return verdicts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("column_count"), F.count_if("is_sensitive").alias("sensitive_column_count")
    )


# ── Built-in classifier ───────────────────────────────────────────────────────


def type_from_name(name: Column) -> Column:
    """Sensitivity type suggested by a column name, NULL for none."""
    lower = F.lower(name)
    return (
        F.when(lower.contains("email"), "email")
        .when(lower.contains("ssn") | lower.contains("social_security"), "ssn")
        .when(lower.contains("phone"), "phone_number")
        .when(lower.contains("address"), "address")
        .when(lower.contains("name") & lower.contains("user"), "name")
    )


# Shapes of personal data inside values. An addition of this library: it lets the classifier look
# at the data where no answer from outside is available. The part of an address before the @ is bounded, as
# addresses are, so that a long run of letters is not searched again from each of its places.
EVIDENCE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "credit_card": r"\b[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}\b",
    "ip_address": r"\b[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}\b",
    "phone_number": r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}\b",
}
EVIDENCE_SHARE = 0.5


def value_evidence(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table_name, column_name, <type>_share…)`` of every text column, in one scan per table.

    A share is the part of the non-null values in which the shape occurs; NULL without any value.
    """
    data = Dataset.of(tables)
    scans = []
    for table, df in data.tables.items():
        refs = [r for r in data.of_category(kinds.STRING) if r.table == table]
        if not refs:
            continue
        shares, rows = [], []
        for r in refs:
            for kind, pattern in EVIDENCE.items():
                literal = pattern.replace("\\", "\\\\")
                shares.append(f"avg(cast({quoted(r.name)} rlike '{literal}' as int)) as s{r.cid}_{kind}")
            fields = ", ".join(f"'{kind}_share', s{r.cid}_{kind}" for kind in EVIDENCE)
            rows.append(f"named_struct('cid', {r.cid}, {fields})")
        scans.append(df.selectExpr(*shares).selectExpr(f"inline(array({', '.join(rows)}))"))
    shares_schema = "cid int, " + ", ".join(f"{kind}_share double" for kind in EVIDENCE)
    found = union_all(scans) if scans else empty(data.spark, shares_schema)
    return column_frame(data).join(F.broadcast(found), "cid").select(*_KEY, *[f"{kind}_share" for kind in EVIDENCE])


def classify(columns: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Verdicts from column names, and from values where at least half of them show one shape."""
    suggested = type_from_name(F.col("column_name"))
    if evidence is not None:
        columns = columns.join(evidence, table_key(columns, evidence, column=True), "left")
        shown = F.coalesce(*[F.when(F.col(f"{kind}_share") >= EVIDENCE_SHARE, kind) for kind in EVIDENCE])
        suggested = F.coalesce(suggested, shown)
    key = table_key(columns, column=True)
    return columns.select(*key, suggested.isNotNull().alias("is_sensitive"), suggested.alias("sensitivity_type"))
