"""Reading JSON out of free-form answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def extract_json(text: Column) -> Column:
    """The content of the first code fence that opens on its own line, else the whole text; stripped."""
    fenced = r"(?s)```(?:json)?\s*\n(.*?)```"
    return stripped(F.when(text.rlike(fenced), F.regexp_extract(text, fenced, 1)).otherwise(text))


def parse_answer(text: Column) -> Column:
    """The answer as VARIANT: the text itself if it is JSON, else a fenced object; NULL for anything else."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(fenced))


def items(answer: Column, path: str) -> Column:
    """The array at ``path`` of a VARIANT as an array of VARIANT; NULL if there is none."""
    return F.try_variant_get(answer, path, "array<variant>")


def kind_of(value: Column) -> Column:
    """Type name of a VARIANT; NULL where the path does not exist."""
    return F.schema_of_variant(value)


def field(item: Column, name: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", "variant")


def string_field(item: Column, name: str) -> Column:
    """A field as text, whatever scalar it is."""
    return F.try_variant_get(item, f"$.{name}", "string")


def strict_string(item: Column, name: str) -> Column:
    """A field that must be a JSON string; NULL otherwise."""
    return F.when(kind_of(field(item, name)) == "STRING", string_field(item, name))
