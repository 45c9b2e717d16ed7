"""Profiles of many tables, in which a broken table loses only itself."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from colsight.config import ProfileConfig
from colsight.plans.column_profile import column_profile
from colsight.plans.files import file_profile
from colsight.plans.run import profile_run
from colsight.plans.tables import table_profile

__all__ = ["file_profile", "isolated_profile", "table_profile", "write_each"]
logger = logging.getLogger(__name__)


def isolated_profile(readers: Mapping[str, Callable[[], DataFrame]], config: ProfileConfig | None = None) -> DataFrame:
    """Profile of every table, written once; what fails loses only its own statistics.

    Tables of a job that fails run again, each as its own; one that fails again keeps its columns, with NULL
    statistics and ``failed`` set. A table that cannot be planned has no known columns and is one such row.
    """
    config = replace(config or ProfileConfig(), include_sample_data=False, include_schemas=None, exclude_schemas=())
    run = profile_run(SparkSession.active(), {("", name): read for name, read in readers.items()}, config)
    if run.where("column_name is not null").isEmpty():
        raise RuntimeError("none of the tables could be read")
    return run.drop("schema_name", "sample_values", "reason")


def write_each(
    readers: Mapping[str, Callable[[], DataFrame]], path: str, config: ProfileConfig | None = None
) -> dict[str, str]:
    """One job per table, ``max_concurrent_tables`` at a time; returns the error of each failed one.

    For sources where a table may fail while it is read: the others are still written.
    """
    config = config or ProfileConfig()

    def run(item: tuple[str, Callable[[], DataFrame]]) -> tuple[str, str | None]:
        name, reader = item
        try:
            column_profile({name: reader()}, config).write.mode("overwrite").parquet(f"{path}/{name}")
        except Exception as error:
            logger.warning("profile of %s failed: %s", name, str(error).splitlines()[0])
            return name, str(error)
        return name, None

    with ThreadPoolExecutor(config.max_concurrent_tables) as pool:
        return {name: error for name, error in pool.map(run, readers.items()) if error}
