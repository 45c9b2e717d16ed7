"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. Sorting the blocks of all documents gives equal
blocks one integer name; then adjacent pairs of names are named in the same way, level by level,
until each document has one name. Names come from comparing whole blocks and whole pairs, never
from a digest, so two documents share an identity exactly if their texts are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from colsight.llm.shared import ascii_lower, boxed, broadcast_if_small, let, quoted, stored

BLOCK_BYTES = 512
_ADDED = (("chunk", IntegerType()), ("local", LongType()), ("first", BinaryType()), ("last", BinaryType()))


def _blocks(text: Column, size: int) -> Column:
    """The bytes of a text in blocks of ``size``; an empty text has one empty block."""

    def cut(whole: Column) -> Column:
        count = F.greatest(F.lit(1), F.ceil(F.octet_length(whole) / size)).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(whole, i * size + 1, F.lit(size)))

    return let(F.encode(text, "UTF-8"), cut)


def _number_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the runs of equal keys of a sorted range; one more row has its first and last key."""
    first = last = kinds = None
    runs, chunk = -1, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").cast(pa.large_binary())
        steps = [pa.array([int(last is None or key[0].as_py() != last)], pa.int64())]
        if batch.num_rows > 1:
            steps.append(pc.not_equal(key[1:], key[:-1]).cast(pa.int64()))
        local = pc.add(pc.cumulative_sum(pa.concat_arrays(steps)), runs)
        runs, last, chunk = local[-1].as_py(), key[-1].as_py(), batch.column("chunk")[0].as_py()
        first = key[0].as_py() if first is None else first
        none = pa.nulls(batch.num_rows, pa.binary())
        rest = batch.drop_columns(["key", "chunk"])
        kinds = pa.schema([*rest.schema, ("chunk", pa.int32()), ("local", pa.int64()), ("first", pa.binary()), ("last", pa.binary())])
        yield pa.RecordBatch.from_arrays([*rest.columns, batch.column("chunk"), local, none, none], schema=kinds)
    if kinds is not None:
        ends = {"chunk": chunk, "local": runs, "first": first, "last": last}
        yield pa.RecordBatch.from_arrays([pa.array([ends.get(f.name)], f.type) for f in kinds], schema=kinds)


def _named(keys: DataFrame) -> DataFrame:
    """Replaces ``key`` by ``name``: equal keys get the same integer, different keys different ones.

    The sort range includes document and place, so a key that fills many rows is spread over tasks.
    A key that goes on from one range to the next keeps its name there; only the ends of the ranges,
    two keys for each task, are compared for that.
    """
    ranged = keys.repartitionByRange("key", "doc", "place").sortWithinPartitions("key", "doc", "place")
    kept = [field for field in keys.schema if field.name != "key"]
    schema = StructType([StructField(f.name, f.dataType) for f in kept] + [StructField(name, kind) for name, kind in _ADDED])
    runs = stored(ranged.withColumn("chunk", F.spark_partition_id()).mapInArrow(_number_runs, schema))
    in_order = Window.orderBy("chunk")
    goes_on = F.coalesce((F.lag("last").over(in_order) == F.col("first")).cast("long"), F.lit(0))
    ends = runs.where(F.col("doc").isNull()).select("chunk", "local", goes_on.alias("goes_on"))
    new = F.col("local") + 1 - F.col("goes_on")
    earlier = F.coalesce(F.sum(new).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ends.select("chunk", (earlier - F.col("goes_on")).alias("offset"))
    named = runs.where(F.col("doc").isNotNull()).join(F.broadcast(offsets), "chunk")  # a row for each task of the sort
    return named.select(*[f.name for f in kept], (F.col("local") + F.col("offset")).alias("name"))


def identities(texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc, text, box`` becomes ``doc, level, name, box``: equal ``(level, name)`` exactly for equal texts.

    ``doc`` is unique and not null; ``box`` is anything to carry along (on one row of a document).
    A document is finished at the level where one name is left of it, which equal texts reach
    together. Each level halves the rows of the documents that go on.
    """
    cut = texts.select("doc", "box", _blocks(F.col("text"), block_bytes).alias("blocks"))
    exploded = cut.select("doc", "box", F.size("blocks").alias("n"), F.posexplode("blocks").alias("place", "key"))
    box = F.when(F.col("place") == 0, F.col("box")).alias("box")
    names = _named(exploded.select("doc", F.col("place").cast("long").alias("place"), "n", box, "key"))
    blocks = names.agg(F.max("n")).first()[0] or 1
    finished: list[DataFrame] = []
    while True:
        done = names.where(F.col("n") == 1)
        finished.append(done.select("doc", F.lit(len(finished)).alias("level"), "name", "box"))
        if blocks == 1:
            break
        blocks = (blocks + 1) // 2
        going = names.where(F.col("n") > 1)
        side = lambda odd: F.coalesce(F.max(F.when(F.col("place") % 2 == odd, F.col("name"))), F.lit(-1))
        pairs = going.groupBy("doc", F.floor(F.col("place") / 2).alias("place")).agg(
            F.ceil(F.max("n") / 2).cast("int").alias("n"), F.max("box").alias("box"), side(0).alias("left"), side(1).alias("right")
        )
        sixteen = [F.unhex(F.lpad(F.hex(name), 16, "0")) for name in ("left", "right")]
        names = _named(pairs.select("doc", "place", "n", "box", F.concat(*sixteen).alias("key")))
    union = finished[0]
    for more in finished[1:]:
        union = union.unionByName(more)
    return union


def _groups(docs: DataFrame, number: Column, id_column: str, text: str, block_bytes: int) -> DataFrame:
    """``doc, id, sha, keep, group_size`` for each row of ``docs``; ``keep`` is the row that stays."""
    normal = ascii_lower(F.coalesce(F.col(quoted(text)), F.lit("")))
    texts = docs.select(number.alias("doc"), F.col(quoted(id_column)).alias("id"), normal.alias("text"))
    box = F.struct("id", F.unhex(F.sha2("text", 256)).alias("sha")).alias("box")
    named = stored(identities(texts.select("doc", "text", box), block_bytes).select("doc", "level", "name", "box.id", "box.sha"))
    groups = named.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("id", "doc")).alias("keep"))
    # Stored, the groups of two or more stand apart from their sums, so a join can split a large group's rows.
    several = broadcast_if_small(stored(groups.where("group_size > 1")), 48)
    joined = named.join(several, ["level", "name"], "left")
    alone = {"group_size": F.coalesce("group_size", F.lit(1).cast("long")), "keep": F.coalesce("keep", F.struct("id", "doc"))}
    return joined.withColumns(alone)


def find_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal if identical after lower-casing A-Z; null counts as empty. The row with the largest
    id stays, a null id being the smallest; of rows with the same id and text one stays. Every row
    of ``docs`` has a row in the result. ``docs`` should be a stored table, as its rows are numbered.
    """
    rows = _groups(docs, F.monotonically_increasing_id(), id_column, text, block_bytes)
    return rows.select(
        F.col("id").alias(id_column),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("keep.doc") == F.col("doc")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that ``find_copies`` keeps, with all their columns.

    The numbered rows are stored first, so that a number means the same row in each later read.
    """
    numbered = stored(boxed(docs, doc=F.monotonically_increasing_id()))
    plain = numbered.select("doc", F.col(f"row.{quoted(id_column)}").alias("id"), F.col(f"row.{quoted(text)}").alias("text"))
    groups = _groups(plain, F.col("doc"), "id", "text", block_bytes)
    gone = stored(groups.where(F.col("keep.doc") != F.col("doc")).select("doc"))
    return numbered.join(broadcast_if_small(gone, 16), "doc", "left_anti").select("row.*")
