"""The column profile of some tables with the parts that a configuration asks for."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsight.config import ProfileConfig
from colsight.functions.rows import constant_rows
from colsight.operators import sampling
from colsight.operators.cells import union_all
from colsight.plans.column_profile import column_profile


def table_profile(tables: Mapping[str, DataFrame], config: ProfileConfig | None = None) -> DataFrame:
    """Column profile with the parts the configuration asks for: statistics and sample values.

    Parts that are switched off are NULL.
    """
    config = config or ProfileConfig()
    if config.include_column_stats:
        profile = column_profile(tables, config)
    else:
        columns = [
            (table, i, f.name, f.dataType.simpleString())
            for table, df in tables.items()
            for i, f in enumerate(df.schema.fields, start=1)
        ]
        spark = next(iter(tables.values())).sparkSession
        schema = "table_name string, ordinal int, column_name string, data_type string"
        profile = constant_rows(spark, columns, schema)
    if not config.include_sample_data:
        return profile.withColumn("sample_values", F.lit(None).cast("array<string>"))
    samples = union_all(
        sampling.column_values(df, config.sample_size, config.sample_seed).withColumn("table_name", F.lit(table))
        for table, df in tables.items()
    )
    keys = ["table_name", "ordinal", "column_name"]
    return profile.join(samples.select(*keys, "sample_values"), keys, "left")
