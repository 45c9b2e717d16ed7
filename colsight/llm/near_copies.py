"""One document of each group of near copies: SimHash shards whose links are checked on whole shingle sets.

Two texts are near copies if the cosine of their shingle sets, the similarity that SimHash estimates, is high enough. At 0.8
fingerprints differ in some 13 of 64 bits, too many for shards cut from the fingerprint itself. Documents meet here in shards named
by MinHash bands instead; a BK-tree of a shard's fingerprints gives the pairs within a wide radius, and the sets decide. A
fingerprint is that of the set, each shingle once, so a passage that one copy repeats moves neither.

Equal sets are one node. A shard of more than ``SHARD_ROWS`` nodes is searched in blocks, each together with the shard's first
node, which connects the blocks of one group; only nodes that are then not connected with it meet the other blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsight.llm.components import components
from colsight.llm.shared import boxed, broadcast_if_small, quoted, stored, unboxed
from colsight.llm.simhash_dedup import _shards, fingerprint, shard_links, shingle_hashes, signed

WIDTH, SIMILARITY, RADIUS = 5, 0.8, 26
BANDS, ROWS = 20, 3  # two texts of similarity 0.8 share a band with a probability of 0.998 (unlike sizes) to 0.999 (equal sizes)
SHARD_ROWS = 4096
_KEYS = np.random.default_rng(5).integers(0, 2**63, (BANDS * ROWS, 2), np.uint64) | np.uint64(1)


def bands(hashes: np.ndarray) -> list[int]:
    """One key for each band of MinHash values; none for a document without words."""
    if not len(hashes):
        return []
    least = np.array([((hashes ^ flip) * factor).min() for flip, factor in _KEYS], np.uint64)
    return [signed(xxhash.xxh64_intdigest(row.tobytes())) for row in least.reshape(BANDS, ROWS)]


def _signatures(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, keys, sets = [], [], []
            for text in batch.column("text"):
                slices = list(shingle_hashes(text.as_py(), width))
                hashes = np.unique(np.concatenate(slices)) if slices else np.zeros(0, np.uint64)
                prints.append(signed(fingerprint(iter([hashes]))))
                keys.append(bands(hashes))
                sets.append(np.unique((hashes >> np.uint64(32)).astype(np.uint32)).tobytes())
            made = [pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("item"), *made], names=["item", "fp", "bands", "grams"])

    return run


def _checked_links(radius: int, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            items, prints = shard["item"].to_pylist(), shard["fp"].to_pylist()
            sets = [np.frombuffer(g, np.uint32) for g in shard["grams"].to_pylist()]

            def alike(i: int, j: int, sets: list[np.ndarray] = sets) -> bool:
                a, b = len(sets[i]), len(sets[j])
                if min(a, b) < similarity**2 * max(a, b):
                    return False
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                return both * both >= similarity**2 * a * b

            links = shard_links([v & (2**64 - 1) for v in prints], radius, alike)
            if links:
                ends = [pa.array([items[pair[side]] for pair in links], pa.int64()) for side in (0, 1)]
                yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    return run


def _searched(signatures: DataFrame, joined: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Links inside the shards that ``joined`` (``item, kind, shard``) deals items to."""
    dealt = joined.groupBy("item").agg(F.collect_set(F.struct("kind", "shard")).alias("shards"))  # a few for each band
    meeting = signatures.drop("bands").join(broadcast_if_small(stored(dealt), 24 * BANDS), "item")
    shards = meeting.select("item", "fp", "grams", F.inline("shards")).repartition("kind", "shard")
    return shards.sortWithinPartitions("kind", "shard", "item").mapInArrow(_checked_links(radius, similarity), "a long, b long")


def near_links(signatures: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``item, fp, bands, grams`` (stored) becomes ``a, b``: links that connect each group of near copies.

    Only documents that share a shard with another one are moved. A shard of more than ``shard_rows`` is cut into blocks, and its
    first item joins each of them. Items that this leaves unconnected with the first one then meet all items of the shard, block by
    block; pairs of connected items need no link. No task holds more than two blocks, and no pair that could connect two groups is left out.
    """
    places = signatures.select("item", F.posexplode("bands").alias("kind", "shard"))
    members = F.bit_xor(F.xxhash64("item")).alias("members")
    found = places.groupBy("kind", "shard").agg(F.count("*").alias("n"), F.min("item").alias("first"), members).where("n > 1")
    # Near copies share many bands: of the shards with the same members one is searched.
    once = found.groupBy("n", "first", "members").agg(F.min(F.struct("kind", "shard")).alias("shard"))
    sizes = stored(once.select("shard.kind", "shard.shard", "n", "first"))
    shared = places.join(sizes, ["kind", "shard"])
    blocks = F.ceil(F.col("n") / shard_rows).cast("int")

    def block(count: Column) -> Column:
        return F.pmod(F.xxhash64("item"), count).cast("int")

    def every(count: Column) -> Column:
        return F.sequence(F.lit(0), count - 1)

    own = F.when(F.col("item") == F.col("first"), every(blocks)).otherwise(F.array(block(blocks)))
    first = shared.select("item", "kind", F.explode(F.transform(own, lambda at: F.xxhash64("shard", at))).alias("shard"))
    links = _searched(signatures, first, radius, similarity)
    large = sizes.where(F.col("n") > shard_rows)
    if large.isEmpty():
        return links
    links = stored(links)
    roots = components(links).distinct()
    held = places.join(large, ["kind", "shard"])
    for item, name in (("item", "root"), ("first", "first_root")):
        known = roots.select(F.col("node").alias(item), F.col("root").alias(name))
        held = held.join(known, item, "left").withColumn(name, F.coalesce(name, item))
    held = stored(held.withColumn("apart", F.col("root") != F.col("first_root")).drop("root", "first_root"))
    apart = held.where("apart").groupBy("kind", "shard").agg(F.count("*").alias("u"))
    cells = held.join(apart, ["kind", "shard"])
    rows = F.ceil(F.col("u") / shard_rows).cast("int")
    against = F.transform(every(rows), lambda row: F.struct(row.alias("row"), block(blocks).alias("at")))
    asking = F.when(F.col("apart"), F.transform(every(blocks), lambda at: F.struct(block(rows).alias("row"), at.alias("at")))).otherwise(F.array().cast("array<struct<row:int,at:int>>"))
    cell = F.explode(F.transform(F.concat(against, asking), lambda c: F.xxhash64("shard", F.lit("apart"), c["row"], c["at"]))).alias("shard")
    return links.unionByName(_searched(signatures, cells.select("item", "kind", cell), radius, similarity))


def drop_near_copies(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS
) -> DataFrame:
    """The rows of ``docs``, with all columns, that are the first of their group of near copies.

    Two texts are near copies if the cosine of their sets of ``width``-word shingles (A-Z lower-cased; a shorter text is
    one shingle), the common shingles over the root of both sizes' product, is at least ``similarity``; groups are connected by such
    pairs. The smallest id stays, null ids last, and one row of repeated ones. Texts without words
    are near copies of nothing. The numbered rows are stored first, so numbers keep their meaning.
    """
    numbered = stored(boxed(docs, item=F.monotonically_increasing_id()))
    texts = numbered.select("item", F.col(f"row.{quoted(text)}").cast("string").alias("text"))
    signatures = stored(texts.mapInArrow(_signatures(width), "item long, fp long, bands array<long>, grams binary"))
    equal = signatures.where(F.size("bands") > 0).select("item", "fp", F.xxhash64("grams").alias("key"), "grams")
    nodes = equal.groupBy("fp", "key").agg(F.min("item").alias("node"), F.count("*").alias("n"))
    copies = stored(equal.drop("grams").join(nodes.where("n > 1"), ["fp", "key"]).where("item <> node").select(F.col("item").alias("a"), F.col("node").alias("b")))
    distinct = signatures.join(broadcast_if_small(copies.select(F.col("a").alias("item")), 16), "item", "left_anti")
    groups = stored(components(near_links(distinct, radius, similarity).unionByName(copies)))
    ids = numbered.select("item", F.col(f"row.{quoted(id_column)}").alias("id"))
    members = groups.select(F.col("node").alias("item"), "root").unionByName(groups.select(F.col("root").alias("item"), "root").distinct())
    known = members.join(ids, "item")
    first = known.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "item")).alias("first"))
    gone = stored(known.join(first, "root").where(F.col("first.item") != F.col("item")).select("item"))
    return unboxed(numbered.join(broadcast_if_small(gone, 16), "item", "left_anti"), docs.columns)
