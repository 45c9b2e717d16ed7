"""Connected components of links, by stars that shrink in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsight.llm.shared import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node are tied to its smallest one (itself included)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
    tied = both.join(least, "a").where(F.col("b") > F.col("a"))
    return tied.select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest one; links point downwards."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    tied = links.join(least, "a").where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return tied.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``a, b`` (longs) becomes ``node, root``: each linked node and the smallest node it can reach.

    A round takes minima, which combine before the shuffle, and equi-joins; it writes its links to
    the shared folder, so plans stay short. Rounds end when the links no longer change.
    """
    down = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = stored(down.distinct())
    state = None
    while True:
        summary = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if summary == state or not summary[0]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = summary
        current = stored(_small_star(_large_star(current)))
