"""Values outside the interquartile fences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_outlier_counts(frequency: DataFrame, percentiles: DataFrame) -> DataFrame:
    """The percentile rows (``cid``, ``p25``, ``p75``, …) with ``outlier_count`` added.

    The fences lie 1.5 interquartile ranges outside the quartiles; values on a fence are not outliers.
    """
    spread = F.col("p75") - F.col("p25")
    low, high = F.col("p25") - 1.5 * spread, F.col("p75") + 1.5 * spread
    outside = (F.col("d") < low) | (F.col("d") > high)
    kept = [name for name in percentiles.columns if name != "cid"]
    # The percentiles are one row per numeric column; carrying them through the aggregate keeps
    # their computation in the plan once.
    return (
        frequency.join(F.broadcast(percentiles), "cid")
        .groupBy("cid")
        .agg(
            *[F.max(name).alias(name) for name in kept],
            F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("outlier_count"),
        )
    )
