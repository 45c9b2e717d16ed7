"""Options for reading catalogs and tables of a database through Spark's JDBC source."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# Driver class and URL prefix of each engine.
DRIVERS = {
    "postgres": ("org.postgresql.Driver", "jdbc:postgresql"),
    "redshift": ("com.amazon.redshift.jdbc42.Driver", "jdbc:redshift"),
    "mysql": ("com.mysql.cj.jdbc.Driver", "jdbc:mysql"),
    "snowflake": ("net.snowflake.client.jdbc.SnowflakeDriver", "jdbc:snowflake"),
    "databricks": ("com.databricks.client.jdbc.Driver", "jdbc:databricks"),
    "bigquery": ("com.simba.googlebigquery.jdbc.Driver", "jdbc:bigquery"),
}


def options(
    engine: str,
    location: str,
    *,
    table: str | None = None,
    query: str | None = None,
    split_by: tuple[str, int, int, int] | None = None,
    properties: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Reader options for one table or one query.

    ``split_by`` is (numeric column, lowest, highest, partitions): without it a table is read by a
    single task.
    """
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    driver, prefix = DRIVERS[engine]
    result = {"url": f"{prefix}:{location}", "driver": driver, "fetchsize": "10000"}
    result |= {"dbtable": table} if table else {"query": query}
    if split_by:
        if query:
            raise ValueError("only a table can be read in partitions")
        name, low, high, partitions = split_by
        result |= {
            "partitionColumn": name, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(partitions),
        }
    return result | dict(properties or {})


def read(spark: SparkSession, engine: str, location: str, **how: object) -> DataFrame:
    return spark.read.format("jdbc").options(**options(engine, location, **how)).load()
