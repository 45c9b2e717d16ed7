"""Filter detection over all columns of a profile in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsight.functions.rows import table_key
from colsight.operators import filters


def candidates(
    profile: DataFrame,
    keys: DataFrame,
    relationships: DataFrame,
    indexes: DataFrame,
    row_counts: DataFrame,
    checks: DataFrame | None = None,
    estimates: DataFrame | None = None,
) -> DataFrame:
    """All signals and scores of every profiled column.

    ``profile`` is a column profile, or its ``table_name, ordinal, column_name, data_type,
    distinct_count, null_percentage`` and ``top_values``. ``keys`` lists ``table_name, column_name,
    is_primary_key, enum_values`` of columns that are known to the catalog; ``checks`` lists the
    columns with check constraints; ``row_counts`` holds ``schema_name, table_name, row_count``. Where ``profile`` and another
    frame both carry ``schema_name`` they are matched by it, so tables of one name in two schemas stay apart.
    """

    def key(frame: DataFrame, column: bool = True) -> list[str]:
        return table_key(profile, frame, column=column)

    known = profile.join(keys, key(keys), "left").withColumn("is_primary_key", F.coalesce("is_primary_key", F.lit(False)))
    known = filters.schema_signals(known, relationships, indexes)
    known = filters.with_referenced_rows(known, row_counts, estimates)
    if checks is None:
        known = known.withColumn("has_check_constraint", F.lit(False))
    else:
        marked = checks.select(*key(checks)).distinct().withColumn("has_check_constraint", F.lit(True))
        known = known.join(marked, key(checks), "left").withColumn(
            "has_check_constraint", F.coalesce("has_check_constraint", F.lit(False))
        )
    counted = key(row_counts, column=False)
    known = known.join(row_counts.select(*counted, "row_count"), counted, "left")
    values = F.col("top_values.value") if "top_values" in profile.columns else F.lit(None).cast("array<string>")
    known = known.withColumns({"schema_score": filters.schema_score(), "values": values})
    return filters.with_composite(filters.with_statistical_signals(known))
