"""Values as text: normalisation to JSON-safe primitives and grouping keys for any type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A text longer than this is grouped by its SHA-256 instead of by itself, so that a shuffle of
# document-sized values moves 64 characters per distinct value.
LONGEST_TEXT_KEY = 64


def column(name: str) -> Column:
    """Column by its literal name, whatever characters it holds."""
    return F.col(quoted(name))


def _is_nested(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def json_safe(col: Column, data_type: T.DataType) -> Column:
    """Decimal as double, date and time as ISO text, binary as lower-case hex, nested as JSON."""
    if isinstance(data_type, T.DecimalType):
        return col.cast("double")
    if isinstance(data_type, T.DateType):
        return col.cast("string")
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        # The fraction is printed with six digits, or left out when it is zero.
        fraction = F.date_format(col, "SSSSSS")
        seconds = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
        return F.when(fraction == "000000", seconds).otherwise(F.concat(seconds, F.lit("."), fraction))
    if isinstance(data_type, T.BinaryType):
        return F.lower(F.hex(col))
    if _is_nested(data_type):
        return F.to_json(col)
    if isinstance(data_type, (T.StringType, T.IntegralType, T.FractionalType, T.BooleanType)):
        return col
    return col.cast("string")


def json_safe_text(col: Column, data_type: T.DataType) -> Column:
    """The JSON-safe value printed as text."""
    return json_safe(col, data_type).cast("string")


def quoted(name: str) -> str:
    """A column name as SQL text, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def digest(text: str) -> str:
    """SQL text of a grouping key for ``text``: itself when short, else its SHA-256.

    The digest form is longer than any short text, so the two cannot meet.
    """
    return f"if(length({text}) <= {LONGEST_TEXT_KEY}, {text}, concat('sha256:', sha2({text}, 256)))"


def grouping_key(name: str, data_type: T.DataType) -> str:
    """SQL text of a comparable stand-in for a column that keeps distinct values distinct."""
    col = quoted(name)
    if isinstance(data_type, T.IntegralType):
        return f"cast({col} as bigint)"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return digest(col)
    if isinstance(data_type, T.BinaryType):
        return digest(f"hex({col})")
    if _is_nested(data_type):
        return digest(f"to_json({col})")
    return col
