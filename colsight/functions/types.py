"""Column categories, from Spark types and from the type names a catalog prints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC, STRING, BOOLEAN, TEMPORAL, OTHER = "numeric", "string", "boolean", "temporal", "other"

# Type names of each category, as the supported engines spell them.
NUMERIC_NAMES = (
    "smallint", "integer", "bigint", "int", "int2", "int4", "int8", "decimal", "numeric", "real",
    "double precision", "float", "float4", "float8", "money", "smallserial", "serial", "bigserial",
    "tinyint", "mediumint", "double", "number", "int64", "float64", "bignumeric", "long", "short",
    "byte", "hugeint", "uhugeint", "ubigint", "uinteger", "usmallint", "utinyint",
)
STRING_NAMES = (
    "character varying", "varchar", "character", "char", "text", "name", "citext", "bpchar",
    "tinytext", "mediumtext", "longtext", "string",
)
BOOLEAN_NAMES = ("boolean", "bool")
TEMPORAL_NAMES = (
    "date", "time", "time with time zone", "time without time zone", "timestamp",
    "timestamp with time zone", "timestamp without time zone", "datetime", "year", "interval",
    "timestamp_ntz", "timestamp_ltz", "timestamp_tz", "timestamptz", "timetz",
)


def category_of_name(type_name: Column) -> Column:
    """Category of a catalog type name; precision such as ``(10,2)`` is ignored."""
    base = F.trim(F.substring_index(F.trim(F.lower(type_name)), "(", 1))
    return (
        F.when(base.isin(*NUMERIC_NAMES), NUMERIC)
        .when(base.isin(*STRING_NAMES), STRING)
        .when(base.isin(*BOOLEAN_NAMES), BOOLEAN)
        .when(base.isin(*TEMPORAL_NAMES), TEMPORAL)
        .otherwise(OTHER)
    )


def category_of(data_type: T.DataType) -> str:
    """Category of a Spark type; unlike the name rule, an array of decimals is OTHER."""
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    temporal = (T.DatetimeType, T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType)
    return TEMPORAL if isinstance(data_type, temporal) else OTHER
