"""Ranked lexical search by a pair of trees, one over the items and one over documents.

A document is a vector of impacts, one for each term, and an item a vector of term weights; a score is their product. A
node of either tree holds the maximum of each coordinate below it, so the product of two nodes is a bound on
all scores between them. A pair of nodes is given up where the bound is below the weakest of the kth scores that
the node's items have found so far: a whole batch of documents for a whole batch of items. Bounds and scores are
integers, so what is given up could not have been among the best.

Items are searched in blocks of bounded size, each against all documents. A task searches its own documents
and sends the best of each item; those are merged in two steps.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colsight.llm.shared import LOWER, UPPER, boxed, quoted, running_totals, stored

BEST, FAN = 20, 8
BLOCK_BYTES = 1 << 20
_CELLS = 1 << 22
_LETTERS = {*b"0123456789", *LOWER.encode(), *range(128, 256)}
_TABLE = bytes(LOWER.encode()[UPPER.encode().index(c)] if c in UPPER.encode() else c if c in _LETTERS else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased; none for a null text."""
    return (text or "").encode().translate(_TABLE).split()


def weight(documents: int, frequency: int) -> int:
    return floor(1000 * log((2 * documents + 2) / (2 * frequency + 1)))


def length_factor(n: int, documents: int, total: int) -> int:
    return 75 + 25 * n * documents // total


class ItemTree:
    """``levels[0]`` holds the items and each level above the maxima of ``FAN`` neighbours: ``(first item, end, terms, weights)``."""

    def __init__(self, items: list[tuple[int, dict[int, int]]]) -> None:
        held = sorted((item for item in items if item[1]), key=lambda item: (max((w, t) for t, w in item[1].items()), item[0]))
        self.numbers = [number for number, _ in held]
        level = [(at, at + 1, weights) for at, (_, weights) in enumerate(held)]
        self.levels = []
        while level:
            self.levels.append([(a, z, np.fromiter(w, np.int64, len(w)), np.fromiter(w.values(), np.int64, len(w))) for a, z, w in level])
            level = [self._parent(level[at : at + FAN]) for at in range(0, len(level), FAN)] if len(level) > 1 else []

    @staticmethod
    def _parent(children: list[tuple[int, int, dict[int, int]]]) -> tuple[int, int, dict[int, int]]:
        maxima: dict[int, int] = {}
        for _, _, weights in children:
            for term, value in weights.items():
                maxima[term] = max(value, maxima.get(term, 0))
        return children[0][0], children[-1][1], maxima


class Best:
    """The best documents of each item so far; ``limits`` holds the score of the kth, or 1."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.found, self.limits = k, [[] for _ in range(items)], np.ones(items, np.int64)

    def offer(self, item: int, scores: list[int], ids: list) -> None:
        ranked = sorted(self.found[item] + list(zip(scores, ids, strict=True)), key=lambda hit: (-hit[0], hit[1] is None, hit[1]))
        self.found[item] = ranked[: self.k]
        if len(ranked) >= self.k:
            self.limits[item] = ranked[self.k - 1][0]


def document_levels(impacts: np.ndarray) -> list[np.ndarray]:
    """The documents, and above them the maxima of ``FAN`` neighbours each, up to one root."""
    levels = [impacts]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN), axis=0))
    return levels


def search(tree: ItemTree, impacts: np.ndarray, ids: list, best: Best) -> None:
    """Offers all documents to all items, except pairs of nodes whose bound is below the kth scores of the items."""
    levels = document_levels(impacts)

    def visit(height: int, node: int, depth: int, nodes: np.ndarray) -> None:
        first, end, columns, weights = tree.levels[height][node]
        bounds = levels[depth][np.ix_(nodes, columns)] @ weights
        live = bounds >= best.limits[first:end].min()
        if not live.any():
            return
        if height == depth == 0:
            best.offer(first, bounds[live].tolist(), [ids[at] for at in nodes[live]])
            return
        below = nodes[live]
        if depth:
            below = (below[:, None] * FAN + np.arange(FAN)).ravel()
            below = below[below < len(levels[depth - 1])]
        inner = range(node * FAN, min(node * FAN + FAN, len(tree.levels[height - 1]))) if height else [node]
        for child in inner:
            visit(max(0, height - 1), child, max(0, depth - 1), below)

    if tree.levels and len(impacts):
        visit(len(tree.levels) - 1, 0, len(levels) - 1, np.zeros(1, np.int64))


def _counted(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """The length of each document and how often it holds terms of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {term: at for at, term in enumerate(shared.value)}
        for batch in batches:
            lengths, held = [], []
            for text in batch.column("text"):
                found = terms(text.as_py())
                counts = Counter(map(place.get, found))
                counts.pop(None, None)
                lengths.append(len(found))
                held.append(counts)
            lists = [pa.array([list(c) for c in held], pa.list_(pa.int32())), pa.array([list(c.values()) for c in held], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lengths, pa.int64()), *lists], names=["id", "n", "terms", "counts"])

    return run


def _searched(shared, documents: int, total: int, width: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """The best of a task's documents for each item, in chunks of bounded size."""
    rows = max(FAN, _CELLS // max(1, width))

    def impacts(batch: pa.RecordBatch, strength: np.ndarray) -> tuple[np.ndarray, list]:
        at = np.repeat(np.arange(batch.num_rows), batch.column("terms").value_lengths().to_numpy())
        term, tf = (batch.column(name).flatten().to_numpy().astype(np.int64) for name in ("terms", "counts"))
        factor = np.array([length_factor(n, documents, total) for n in batch.column("n").to_pylist()], np.int64)
        made = np.zeros((batch.num_rows, width), np.int32)
        made[at, term] = 1_000_000_000 * tf // (1000 * tf + 12 * factor[at])
        order = np.argsort((made * strength).argmax(axis=1), kind="stable")  # neighbours share their strongest term
        ids = batch.column("id").to_pylist()
        return made[order], [ids[i] for i in order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tree, strength = shared.value
        best = Best(len(tree.numbers), k)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                search(tree, *impacts(batch.slice(at, rows), strength), best)
        hits = [(tree.numbers[item], score, number) for item, found in enumerate(best.found) for score, number in found]
        if hits:
            numbers, scores, ids = map(list, zip(*hits, strict=True))
            task = pa.array([TaskContext.get().partitionId()] * len(hits), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), task, pa.array(scores, pa.int64()), pa.array(ids)], names=["number", "task", "score", "id"])

    return run


def _block_hits(docs: DataFrame, block: list[tuple[int, str | None]], k: int) -> DataFrame:
    """``number, task, score, id``: the best documents of each task for the items ``(number, text)`` of a block."""
    counts = [(number, Counter(terms(text))) for number, text in block]
    vocabulary = sorted(set().union(*[c for _, c in counts]))
    spark = docs.sparkSession.sparkContext
    kind = docs.schema["id"].dataType.simpleString()
    counted = stored(docs.mapInArrow(_counted(spark.broadcast(vocabulary)), f"id {kind}, n long, terms array<int>, counts array<int>").where("n > 0"))
    documents, total = counted.agg(F.count("*"), F.sum("n")).first()
    frequency = dict(counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # terms of one block
    place = {term: at for at, term in enumerate(vocabulary)}
    weights = [weight(documents, frequency.get(at, 0)) for at in range(len(vocabulary))]
    found = [(number, {place[t]: n * weights[place[t]] for t, n in c.items() if place[t] in frequency and weights[place[t]]}) for number, c in counts]
    shared = spark.broadcast((ItemTree(found), np.array(weights, np.int64)))
    run = _searched(shared, documents, total or 1, len(vocabulary), k)
    return counted.where(F.size("terms") > 0).mapInArrow(run, f"number long, task int, score long, id {kind}")


def best_documents(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", item_column: str = "item_id", text: str = "text", k: int = BEST, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``item_column, rank, id_column, score``: for each item its ``k`` documents with the highest scores above 0.

    Equal scores rank by ascending id, null ids last. Each row of ``items`` is an item and each row of ``docs`` a document, repeated ones too;
    other columns are not read. A null text has no terms; items without terms, or whose terms no document holds, have no
    rows, and empty tables give none. Items are collected in blocks of ``block_bytes`` of text (a longer item is a block
    of its own), and each block reads all documents once.
    """
    columns = boxed(items, id=F.col(quoted(item_column)), text=F.col(quoted(text)).cast("string")).drop("row")
    sized = columns.select("id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), F.lit("").alias("all"))
    placed = running_totals(sized, "all", ["id", "text"], number=F.lit(1).cast("long"), before=F.col("bytes"))
    known = stored(placed.select("id", "text", "number", F.floor(F.col("before") / block_bytes).alias("block")))
    sources = docs.select(F.col(quoted(id_column)).alias("id"), F.col(quoted(text)).cast("string").alias("text"))
    hits = None
    for (block,) in known.select("block").distinct().orderBy("block").collect():
        found = _block_hits(sources, [(r.number, r.text) for r in known.where(F.col("block") == block).select("number", "text").collect()], k)
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        kinds = [f"number long, task int, score long, id {sources.schema['id'].dataType.simpleString()}"]
        hits = docs.sparkSession.createDataFrame([], kinds[0])
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    some = Window.partitionBy("number", F.floor(F.col("task") / 1024)).orderBy(*order)
    ranked = hits.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k).drop("rank")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).where(F.col("rank") <= k)
    named = known.select(F.col("id").alias(item_column), "number")
    return ranked.join(named, "number").select(item_column, "rank", F.col("id").alias(id_column), "score")
