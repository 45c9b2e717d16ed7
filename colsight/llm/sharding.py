"""Sharding by a Feistel permutation of global row numbers.

The permutation of 0 ... N-1 is a function of N and a seed, so the shard and slot of a row, and the row of a
shard and slot, are computed and never looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colsight.llm.shared import boxed, let, quoted, row_numbers, stored, unboxed

ROUNDS, SEED = 4, 42


def _sides(rows: int) -> int:
    """The least side of a square of positions that holds all rows."""
    side = max(1, int(rows**0.5))
    while side * side < rows:
        side += 1
    while side > 1 and (side - 1) * (side - 1) >= rows:
        side -= 1
    return side


def _round_value(half: Column, key: int, seed: int, side: int) -> Column:
    return F.pmod(F.xxhash64(half, F.lit(key), F.lit(seed)), F.lit(side))


def feistel(position: Column, rows: int, seed: int = SEED, back: bool = False) -> Column:
    """One pass over the square that holds ``rows`` positions: a permutation of the square, or its inverse."""
    side = _sides(rows)
    halves = F.struct(F.floor(position / side).cast("long").alias("l"), F.pmod(position, F.lit(side)).cast("long").alias("r"))
    for key in reversed(range(ROUNDS)) if back else range(ROUNDS):

        def mixed(h: Column, key: int = key) -> Column:
            if back:
                return F.struct(F.pmod(h["r"] - _round_value(h["l"], key, seed, side), F.lit(side)).alias("l"), h["l"].alias("r"))
            return F.struct(h["r"].alias("l"), F.pmod(h["l"] + _round_value(h["r"], key, seed, side), F.lit(side)).alias("r"))

        halves = let(halves, mixed)
    return let(halves, lambda h: h["l"] * side + h["r"])


def walk_length(spark: SparkSession, rows: int, seed: int = SEED) -> int:
    """The most passes that any position needs, in either direction, to come back below ``rows``.

    Only walks through the positions of the square beyond the last row take more than one pass. There are
    at most ``2 * sqrt(rows)`` of those, whatever the table. Each is followed until it is back below ``rows``, or at
    its own start: such a circle is entered by no row.
    """
    side = _sides(rows)
    away = spark.range(rows, side * side, 1, 1).select(F.col("id").alias("start"), feistel(F.col("id"), rows, seed).alias("at"))
    passes = 1
    while True:
        away = stored(away.where((F.col("at") >= rows) & (F.col("at") != F.col("start"))))
        passes += 1
        if away.isEmpty():
            return passes
        away = away.select("start", feistel(F.col("at"), rows, seed).alias("at"))


def permuted(position: Column, rows: int, passes: int, seed: int = SEED, back: bool = False) -> Column:
    """Cycle walking: passes are repeated until the position is below ``rows``, ``passes`` times at most."""
    step = lambda at, _: F.when(at < rows, at).otherwise(feistel(at, rows, seed, back))
    first = feistel(position.cast("long"), rows, seed, back)
    return F.reduce(F.sequence(F.lit(2), F.lit(max(2, passes))), first, step)


def shuffle_shards(docs: DataFrame, shards: int, order: list[str], seed: int = SEED) -> DataFrame:
    """Adds ``number`` (in the given order), ``shard`` and ``slot``, which replace columns of these names; all other columns stay.

    The row at place p of the shuffle is slot ``p // shards`` of shard ``p % shards``: shards differ by one row at
    most, and slots have no gaps. The result depends on the rows and the seed alone: rows that agree in
    ``order`` share their places in any way. Nulls come first. Pass the columns that a shard plan needs; texts
    need not be moved for it.
    """
    keys = {f"key{at}": F.col(quoted(c)) for at, c in enumerate(order)}
    numbered = stored(row_numbers(boxed(docs, **keys), *keys).drop(*keys))
    rows = numbered.count()
    passes = walk_length(docs.sparkSession, rows, seed) if rows else 0
    placed = numbered.withColumn("at", permuted(F.col("number"), rows, passes, seed) if rows else F.col("number"))
    shard, slot = F.pmod("at", F.lit(shards)).cast("int"), F.floor(F.col("at") / shards).cast("long")
    return unboxed(placed, docs.columns, number=F.col("number"), shard=shard, slot=slot)


def row_at(shard: Column, slot: Column, shards: int, rows: int, passes: int, seed: int = SEED) -> Column:
    """The number of the row that stands in a slot: the permutation run backwards."""
    return permuted(slot * shards + shard, rows, passes, seed, back=True)
