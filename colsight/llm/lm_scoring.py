"""Cross-entropy difference of two matched n-gram models.

Both models are interpolated trigrams over one vocabulary of 128 symbols: the bytes of a text, with A-Z
lower-cased and bytes beyond ASCII folded into the codes this leaves free. A document's score is the mean, over
its symbols and its end, of the target model's loss less the background model's; low means near the target.
Counts cover every symbol of every document; the bounded vocabulary bounds the models, not what is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsight.llm.shared import boxed, broadcast_if_small, quoted, stored

SYMBOLS, PRIOR = 128, 32.0
_BATCH_SYMBOLS = 1 << 22


def _symbol_table() -> bytes:
    """Bytes to symbols. Symbol 0 stands for what is before and after a text."""
    free = [*range(1, 9), *range(14, 32), *range(65, 91), 127]
    table = bytearray(range(256))
    table[65:91] = range(97, 123)
    table[0] = 127
    for byte in range(128, 256):
        table[byte] = free[byte % len(free)]
    return bytes(table)


_TABLE = _symbol_table()


def trigrams(text: str | None) -> np.ndarray:
    """A code for each symbol of a text and its end, with the two symbols before it."""
    line = b"\0\0" + (text or "").encode().translate(_TABLE) + b"\0"
    held = np.frombuffer(line, np.uint8).astype(np.int32)
    return (held[:-2] * SYMBOLS + held[1:-1]) * SYMBOLS + held[2:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task: for each trigram those in all its documents and in the target's."""
    totals = np.zeros((2, SYMBOLS**3), np.int64)
    waiting: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])

    def empty(side: int) -> None:
        if waiting[side]:
            codes, counts = np.unique(np.concatenate(waiting[side]), return_counts=True)
            totals[side, codes] += counts
            waiting[side].clear()

    held = 0
    for batch in batches:
        for text, target in zip(batch.column("text"), batch.column("target").to_pylist(), strict=True):
            codes = trigrams(text.as_py())
            waiting[0].append(codes)
            if target:
                waiting[1].append(codes)
            held += len(codes)
            if held > _BATCH_SYMBOLS:
                empty(0), empty(1)
                held = 0
    empty(0), empty(1)
    found = np.flatnonzero(totals[0])
    if len(found):
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.astype(np.int32)), pa.array(totals[0, found]), pa.array(totals[1, found])], names=["code", "background", "target"]
        )


def losses(counts: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Bits for each trigram code. Each order is interpolated with the one below, which weighs as ``prior`` counts."""
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + prior * p1) / (two.sum(1, keepdims=True) + prior)
    p3 = (three + prior * p2[None]) / (three.sum(2, keepdims=True) + prior)
    return -np.log2(p3).ravel().astype(np.float32)


def models(docs: DataFrame, is_target: Column, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Losses of the target and the background model. At most ``SYMBOLS ** 3`` rows of counts come to the driver."""
    columns = docs.select(F.col(quoted(text)).cast("string").alias("text"), F.coalesce(is_target, F.lit(False)).alias("target"))
    parts = columns.mapInArrow(_counted, "code int, background long, target long")
    summed = parts.groupBy("code").agg(F.sum("background").alias("background"), F.sum("target").alias("target")).toPandas()
    counts = np.zeros((2, SYMBOLS**3), np.int64)
    counts[:, summed["code"].to_numpy(np.int64)] = summed["target"], summed["background"]
    return losses(counts[0]), losses(counts[1])


def score_documents(docs: DataFrame, is_target: Column, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``n_tokens``, ``target_loss``, ``background_loss`` (bits per token) and ``score``.

    The background is all of ``docs``, the target the rows where ``is_target`` is true. A null text counts as empty,
    and an empty text has one token, its end. Without target rows its model knows nothing and is the same for all.
    """
    target, background = models(docs, is_target, text)
    shared = docs.sparkSession.sparkContext.broadcast((target, background))  # two tables of SYMBOLS ** 3 floats

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, far = shared.value
        for batch in batches:
            sums = np.zeros((batch.num_rows, 3))
            for at, text_value in enumerate(batch.column("text")):
                codes = trigrams(text_value.as_py())
                sums[at] = len(codes), near[codes].sum(dtype=np.float64), far[codes].sum(dtype=np.float64)
            n, a, b = sums.T
            made = [pa.array(n.astype(np.int64)), pa.array(a / n), pa.array(b / n), pa.array((a - b) / n)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made], names=["id", "n_tokens", "target_loss", "background_loss", "score"])

    columns = docs.select(F.col(quoted(id_column)).alias("id"), F.col(quoted(text)).cast("string").alias("text"))
    kind = columns.schema["id"].dataType.simpleString()
    done = columns.mapInArrow(scored, f"id {kind}, n_tokens long, target_loss double, background_loss double, score double")
    return done.withColumnRenamed("id", id_column)


def with_target_labels(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", label: str = "quality") -> DataFrame:
    """Adds ``row`` and ``in_target``: whether any label of a document is 1. The columns of ``docs`` stay in ``row``."""
    good = stored(labels.where(F.col(quoted(label)) == 1).select(F.col(quoted(id_column)).alias("id")).distinct())
    rows = boxed(docs, id=F.col(quoted(id_column)))
    marked = broadcast_if_small(good.withColumn("in_target", F.lit(True)), 16)
    return rows.join(marked, "id", "left").select("row", F.coalesce("in_target", F.lit(False)).alias("in_target"))
