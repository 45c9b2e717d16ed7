"""Cross-entropy difference of two matched word models.

Both models are interpolated bigrams over one vocabulary, the words of all documents. Words are whole UTF-8 byte strings with A-Z
lower-cased; words and pairs of words are named by 64-bit hashes, and all of them are counted.

Documents are dealt to chunks. A chunk counts its own names and sends them, sorted and packed, one row for each bucket of names; a
bucket adds up what the chunks hold and answers each with the counts of the whole corpus, in the order of the question. A name is
one number for each chunk that holds it, so no word or pair makes a hot key, however frequent it is, and no table of counts is
written or broadcast. The losses are computed where the texts are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsight.llm.lm_scoring import PRIOR
from colsight.llm.shared import quoted

CHUNK_BYTES = 8 << 20
_GROWTH = 64
_BEFORE, _AFTER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ONE = np.uint64(1)
_HALF = np.uint64(32)


def word_ids(text: str | None) -> np.ndarray:
    """The words of a text and a zero for its end, each an even number."""
    digest = xxhash.xxh64_intdigest
    return np.array([*[digest(w) for w in (text or "").encode().lower().split()], 0], np.uint64) & ~_ONE


@dataclass
class Chunk:
    """The tokens of some documents: ``names`` sorted, and for each token the places of its pair, its word and the word before it."""

    starts: np.ndarray
    pair: np.ndarray
    word: np.ndarray
    before: np.ndarray
    names: np.ndarray
    background: np.ndarray
    target: np.ndarray

    @classmethod
    def of(cls, docs: pa.Table) -> Chunk:
        ids = [word_ids(text.as_py()) for text in docs.column("text")]
        lengths = np.array([len(found) for found in ids])
        starts = np.cumsum(lengths) - lengths
        words = np.concatenate(ids)
        before = np.roll(words, 1)
        before[starts] = 0
        names, place = np.unique(np.concatenate([words, before * _BEFORE + words * _AFTER | _ONE]), return_inverse=True)
        word, pair = place[: len(words)], place[len(words) :]
        earlier = np.roll(word, 1)
        earlier[starts] = 0  # zero is the least of all names, and every text ends in it
        chosen = np.tile(np.repeat(docs.column("target").to_numpy(), lengths).astype(bool), 2)
        counts = [np.bincount(held, minlength=len(names)).astype(np.uint64) for held in (place, place[chosen])]
        return cls(starts, pair, word, earlier, names, *counts)


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers byte by byte, all lowest bytes first, so that small ones end in zeros which compress to nothing."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _questions(buckets: int) -> Callable[[pa.Table], pa.Table]:
    """The names and counts of a chunk, one row for each bucket."""

    def run(docs: pa.Table) -> pa.Table:
        chunk = Chunk.of(docs)
        ends = np.searchsorted((chunk.names >> _HALF) * np.uint64(buckets) >> _HALF, np.arange(buckets + 1, dtype=np.uint64))
        rows = []
        for bucket, (at, to) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            steps = np.diff(chunk.names[at:to], prepend=np.uint64(0))
            rows.append((docs.column("chunk")[0].as_py(), bucket, packed(steps), packed(chunk.background[at:to]), packed(chunk.target[at:to])))
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 3]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["chunk", "bucket", "names", "background", "target"])

    return run


def _answers(asked: pa.Table) -> pa.Table:
    """The counts of a bucket's names in all chunks, for each chunk in its own order, and the bucket's words in all."""
    names = [np.cumsum(unpacked(data), dtype=np.uint64) for data in asked.column("names").to_pylist()]
    ends = np.cumsum([len(n) for n in names])[:-1]
    known, place = np.unique(np.concatenate(names), return_inverse=True)
    is_word = known & _ONE == 0
    columns = {"chunk": asked.column("chunk"), "bucket": asked.column("bucket")}
    for model in ("background", "target"):
        held = np.concatenate([unpacked(data) for data in asked.column(model).to_pylist()])
        total = np.bincount(place, weights=held, minlength=len(known))  # whole numbers below 2^53
        columns[model] = pa.array([packed(part) for part in np.split(total[place].astype(np.uint64), ends)], pa.binary())
        columns[f"all_{model}"] = pa.array([int(total[is_word].sum())] * asked.num_rows, pa.int64())
    columns["words"] = pa.array([int(is_word.sum())] * asked.num_rows, pa.int64())
    return pa.table(columns)


def _losses(prior: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The mean losses of a chunk's documents.

    A pair is interpolated with its word, which weighs as ``prior`` counts, and a word with all words alike.
    """

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        chunk, answers = Chunk.of(docs), answers.sort_by("bucket")
        words = sum(answers.column("words").to_pylist())
        n = np.diff([*chunk.starts, len(chunk.word)])
        means = []
        for model in ("target", "background"):
            counts = np.concatenate([unpacked(data) for data in answers.column(model).to_pylist()]).astype(np.float64)
            alone = (counts[chunk.word] + 1) / (sum(answers.column(f"all_{model}").to_pylist()) + words)
            loss = -np.log2((counts[chunk.pair] + prior * alone) / (counts[chunk.before] + prior))
            means.append(np.add.reduceat(loss, chunk.starts) / n)
        columns = [docs.column("id"), pa.array(n, pa.int64()), *map(pa.array, means), pa.array(means[0] - means[1])]
        return pa.table(columns, names=["id", "n_tokens", "target_loss", "background_loss", "score"])

    return run


def score_by_words(
    docs: DataFrame, is_target: Column, id_column: str = "doc_id", text: str = "text", prior: float = PRIOR, chunk_bytes: int | None = None
) -> DataFrame:
    """One row per document: id, ``n_tokens``, ``target_loss``, ``background_loss`` (bits per token) and ``score``.

    Tokens are the words of a text and its end. The background is all of ``docs``, the target the rows where ``is_target``
    is true. A null text counts as empty; repeated rows are documents of their own; other columns are not read; an empty table gives no
    rows. Without target rows its model knows nothing and is the same for all.

    ``chunk_bytes`` of text are counted in one task, 8 MB by default and beyond 16 GB of text in proportion to the root of all of it, so that
    a row between a chunk and a bucket keeps its size. A chunk is named by a hash of id and text.
    """
    columns = docs.select(
        F.col(quoted(id_column)).alias("id"), F.col(quoted(text)).cast("string").alias("text"), F.coalesce(is_target, F.lit(False)).alias("target")
    )
    size = columns.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8)).first()[0] or 1
    chunks = ceil(size / (chunk_bytes or max(CHUNK_BYTES, _GROWTH * sqrt(size))))
    dealt = columns.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)))
    kind = columns.schema["id"].dataType.simpleString()
    asked = dealt.groupBy("chunk").applyInArrow(_questions(chunks), "chunk long, bucket long, names binary, background binary, target binary")
    answers = asked.groupBy("bucket").applyInArrow(
        _answers, "chunk long, bucket long, background binary, all_background long, target binary, all_target long, words long"
    )
    scored = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    losses = scored.applyInArrow(_losses(prior), f"id {kind}, n_tokens long, target_loss double, background_loss double, score double")
    return losses.withColumnRenamed("id", id_column)
