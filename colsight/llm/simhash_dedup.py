"""SimHash near-duplicates: BK-trees over shards of fingerprints.

Fingerprints are cut into eight bytes. Two that differ in at most two bits agree in at least six of
them, so every link lies inside one of the 28 shards ``(which six, their values)`` that a fingerprint
belongs to. The other 16 bits bound a shard: it holds at most 65,536 fingerprints, however many
documents there are. A shard's BK-tree is built where the shard is, children keyed by the Hamming
distance to their parent, and a search follows only the edges within the radius. Trees are dealt by
a shuffle instead of one broadcast, because all of them together grow with the documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsight.llm.components import components
from colsight.llm.shared import quoted, stored

RADIUS, BYTES = 2, 8
_SLICE = 1 << 16


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of all shingles of a text, in slices. Words are lower-cased in A-Z and joined by a space."""
    found = (text or "").encode().lower().split()
    if not found:
        return
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(found))
    ends, starts = ends[width - 1 :].tolist(), starts[: len(found) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _SLICE):
        pairs = zip(starts[at : at + _SLICE], ends[at : at + _SLICE], strict=True)
        yield np.array([digest(line[s:e], seed) for s, e in pairs], np.uint64)


def fingerprint(slices: Iterator[np.ndarray]) -> int:
    """A bit is set if it is set in over half of the hashes; zero without hashes."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in slices:
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


class BKTree:
    """Children of a node are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int, item: int) -> None:
        if self.root is None:
            self.root = [value, [item], {}]
            return
        node = self.root
        while distance := (node[0] ^ value).bit_count():
            child = node[2].get(distance)
            if child is None:
                node[2][distance] = [value, [item], {}]
                return
            node = child
        node[1].append(item)

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Items whose value differs from ``value`` in at most ``radius`` bits."""
        waiting = [self.root] if self.root else []
        while waiting:
            held, items, children = waiting.pop()
            distance = (held ^ value).bit_count()
            if distance <= radius:
                yield from items
            if children:
                low, high = distance - radius, distance + radius
                waiting += [child for edge, child in children.items() if low <= edge <= high]


class Forest:
    """Which items of a shard are already linked with each other."""

    def __init__(self, size: int) -> None:
        self.parent = list(range(size))

    def root(self, item: int) -> int:
        while self.parent[item] != item:
            self.parent[item] = item = self.parent[self.parent[item]]
        return item

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def shard_links(values: list[int], radius: int, alike: Callable[[int, int], bool] = lambda a, b: True) -> list[tuple[int, int]]:
    """Links that connect what is within the radius (and ``alike``), as few as connect it."""
    tree, forest, links = BKTree(), Forest(len(values)), []
    for item, value in enumerate(values):
        for other in tree.within(value, radius):
            if forest.root(other) != forest.root(item) and alike(item, other):
                forest.join(other, item)
                links.append((item, other))
        tree.add(value, item)
    return links


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The shards with two or more members of batches sorted by ``kind, shard``, also across batches."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = (table if rest is None else pa.concat_tables([rest, table])).combine_chunks()
        if table.num_rows:
            starts = _starts(table)
            rest = table.slice(int(starts[-1]))
            yield from _several(table, starts)
    if rest is not None:
        yield from _several(rest, np.array([0, rest.num_rows]))


def _starts(table: pa.Table) -> np.ndarray:
    kind, shard = table["kind"].to_numpy(), table["shard"].to_numpy()
    return np.concatenate(([0], np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1))


def _several(table: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
    for at in np.flatnonzero(np.diff(starts) > 1):
        yield table.slice(int(starts[at]), int(starts[at + 1] - starts[at]))


def _fingerprints(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [signed(fingerprint(shingle_hashes(t.as_py(), width))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(values, pa.int64())], names=["id", "fp"])

    return run


def _fingerprint_links(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            held = shard["fp"].to_pylist()
            links = shard_links([v & (2**64 - 1) for v in held], radius)
            if links:
                ends = [pa.array([held[pair[side]] for pair in links], pa.int64()) for side in (0, 1)]
                yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    return run


def shard_masks(radius: int) -> list[int]:
    """Masks of the bytes on which two fingerprints within the radius may agree; one such mask fits each pair."""
    if not 0 <= radius < BYTES:
        raise ValueError(f"radius must be between 0 and {BYTES - 1}")
    return [signed(sum(0xFF << 8 * b for b in chosen)) for chosen in combinations(range(BYTES), BYTES - radius)]


def fingerprint_links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct ``fp`` becomes ``a, b``: links within the radius, as few of each shard as connect it."""
    masks = [F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(F.lit(m)).alias("shard")) for k, m in enumerate(shard_masks(radius))]
    shards = fingerprints.select("fp", F.inline(F.array(*masks))).repartition("kind", "shard")
    return shards.sortWithinPartitions("kind", "shard", "fp").mapInArrow(_fingerprint_links(radius), "a long, b long")


def near_components(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row per document: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Documents are linked if their fingerprints differ in at most ``radius`` bits; the component is the
    smallest id that can be reached. A null text counts as empty; without words the fingerprint is
    zero, linked like any other. Documents of one fingerprint are one node, so copies cost nothing;
    a component whose ids are all null has a null id. Repeated rows stay as they are.
    """
    columns = docs.select(F.col(quoted(id_column)).alias("id"), F.col(quoted(text)).cast("string").alias("text"))
    kind = columns.schema["id"].dataType.simpleString()
    prints = stored(columns.mapInArrow(_fingerprints(width), f"id {kind}, fp long"))
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("id")))
    linked = components(fingerprint_links(nodes.select("fp"), radius))
    rooted = nodes.join(linked, nodes.fp == linked.node, "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(named, "fp").select(F.col("id").alias(id_column), digits, "component_id")
