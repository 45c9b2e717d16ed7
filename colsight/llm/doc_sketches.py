"""Document fingerprints: of all word shingles those whose hash lies below a fixed part of the range.

Whether a hash is kept does not depend on the other shingles of its text, so sketches of any two texts are samples of
the same shingles: what share of one text is contained in another can be estimated however unequal they are, and the sketch of
a whole collection is the union of its sketches. A text that has shingles but none below the bound keeps its least hash.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsight.llm.shared import quoted, row_numbers, stored
from colsight.llm.simhash_dedup import shingle_hashes

WIDTH, PART = 5, 4  # five words; every fourth hash is below the bound
RANGE_BYTES, RANGES = 4 << 20, 1 << 16
_BYTES, _DIGITS = 6, 8  # of a hash its upper 48 bits are kept, eight characters of base64


def sketch(text: str | None, width: int = WIDTH, part: int = PART) -> np.ndarray:
    """The distinct hashes (48 bits) of a text's shingles below 1/``part`` of the range, ascending; the least one if there is none."""
    slices = [np.unique(hashes >> np.uint64(16)) for hashes in shingle_hashes(text, width)]
    hashes = np.unique(np.concatenate(slices)) if slices else np.zeros(0, np.uint64)
    return hashes[: max(np.searchsorted(hashes, np.uint64((1 << 48) // part)), min(1, len(hashes)))]


def packed(hashes: np.ndarray) -> str:
    """A sketch as text: eight characters of base64 for each hash, in ascending order."""
    return base64.b64encode(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - _BYTES :].tobytes()).decode()


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of the smaller shingle set that the larger one holds; two empty ones are alike, one is not."""
    least = min(len(a), len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / least if least else float(len(a) == len(b))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of all shingles of both that both have; two empty sketches are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH, part: int = PART) -> DataFrame:
    """One row per document: its id and ``fingerprint``. A null text is empty, and an empty text's fingerprint too.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer words than ``width`` is one shingle. Repeated rows
    stay, equal texts have equal fingerprints, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [packed(sketch(value.as_py(), width, part)) for value in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.string())], names=["id", "fingerprint"])

    columns = docs.select(F.col(quoted(id_column)).alias("id"), F.col(quoted(text)).cast("string").alias("text"))
    kind = columns.schema["id"].dataType.simpleString()
    return columns.mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_column)


def hashes(fingerprint: Column) -> Column:
    """A fingerprint as an array, one short text for each hash; arrays compare and join without Python."""
    places = F.sequence(F.lit(0), F.floor(F.length(fingerprint) / _DIGITS).cast("int") - 1)
    return F.when(F.length(fingerprint) > 0, F.transform(places, lambda at: F.substring(fingerprint, at * _DIGITS + 1, F.lit(_DIGITS)))).otherwise(F.array().cast("array<string>"))


def contained_in(prints: DataFrame, collection: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``id_column, n_hashes, contained``: the estimated share of each document that is found anywhere in a collection.

    Both frames hold fingerprints of the same settings, ``prints`` one row per id. The collection's sketch is the union of its
    fingerprints, kept as distinct rows, so it may be of any size. Documents without words have a null share; an empty collection holds nothing.
    """
    merged = collection.select(F.explode(hashes(F.col("fingerprint"))).alias("hash")).distinct().withColumn("held", F.lit(1))
    asked = prints.select(F.col(quoted(id_column)).alias("id"), F.explode_outer(hashes(F.col("fingerprint"))).alias("hash"))
    counted = asked.join(merged, "hash", "left").groupBy("id").agg(F.count("hash").alias("n_hashes"), F.count("held").alias("found"))
    share = F.when(F.col("n_hashes") > 0, F.col("found") / F.col("n_hashes"))
    return counted.select(F.col("id").alias(id_column), "n_hashes", share.alias("contained"))


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by the beginning of the one that follows."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _judged(text: str, found: np.ndarray, following: str, found_next: np.ndarray, width: int, part: int) -> tuple:
    changed = edited(text, following)
    found_edited = sketch(changed, width, part)
    digest = hashlib.sha256(changed.encode()).hexdigest()
    pairs = (found, found_edited), (found, found_next)
    return len(text), digest, packed(found), packed(found_edited), *[likeness(*p) for p in pairs], *[containment(*p) for p in pairs]


_JUDGED = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, in_edited double, in_next double"
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
_NAMES = [column.split()[0] for column in _JUDGED.split(", ")]


def _dealt(bounds: list[tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with the range they belong to; the first row of a range goes to the end of the range before it as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts, after = [], [], []
            keys = zip(batch.column("id").to_pylist(), batch.column("hash").to_pylist(), strict=True)
            for row, (number, digest) in enumerate(keys):
                key = _key(number, digest)
                part = bisect_left(bounds, key)
                firsts = [False, True] if bounds[part] == key else [False]
                for is_next in firsts:
                    rows.append(row)
                    parts.append((part + 1) % len(bounds) if is_next else part)
                    after.append(is_next)
            columns = [*batch.take(pa.array(rows, pa.int64())).columns, pa.array(parts, pa.int64()), pa.array(after)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "is_next"])

    return run


def _key(number: object, digest: int) -> tuple:
    return (False, digest) if number is None else (True, number, digest)


def _compared(width: int, part: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row beside the one that follows it in its range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("part", "is_next", "id"))
            for place, is_next, number, value in zip(*columns, batch.column("text"), strict=True):
                if is_next and held is None:
                    continue  # a copy of the row that has closed the range
                text = value.as_py()
                found = sketch(text, width, part)
                if held:
                    rows.append((held[0], *_judged(*held[1:], text, found, width, part)))
                held = None if is_next else (number, text, found)
            if rows:
                kinds = [batch.schema.field("id").type, *_KINDS]
                made = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(made, names=["id", *_NAMES])

    return run


def compare_with_edits(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH, part: int = PART, range_bytes: int | None = None
) -> DataFrame:
    """How near fingerprints find a document to an edited copy of itself, and to the next document.

    Documents stand by descending id, null ids last, ties by a hash of the text; the first one follows the last. The edited text has its last
    third replaced by the beginning of the next one. One row per document: id, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next`` (estimated Jaccard similarity), ``in_edited`` and ``in_next`` (estimated share of the
    smaller text held by the larger). Null texts are empty; a single document follows itself; repeated rows stay; an empty table gives no rows.

    Ids and hashes are numbered first and give the bounds of ranges of about ``range_bytes`` of text (4 MB, or 1/65,536 of all text if that is
    more); only the bounds come to the driver. Whole texts then move once, each to its range, and the first text of a range also to the one before it.
    """
    columns = docs.select(F.col(quoted(id_column)).alias("id"), F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("text"))
    keyed = columns.withColumn("hash", F.xxhash64("text"))
    order = [F.col("id").desc_nulls_last(), F.col("hash").desc()]
    numbered = stored(row_numbers(keyed.select("id", "hash", F.octet_length("text").cast("long").alias("size")), *order))
    rows, size = numbered.agg(F.count("*"), F.sum("size")).first()
    length = range_bytes or max(RANGE_BYTES, (size or 0) // RANGES)
    step = max(1, rows * length // max(size or 0, length))
    firsts = numbered.where(F.col("number") % step == 0).select("id", "hash").distinct().collect()  # one row for each range
    bounds = sorted(_key(*first) for first in firsts)
    kind = columns.schema["id"].dataType.simpleString()
    moved = keyed.mapInArrow(_dealt(bounds), f"id {kind}, text string, hash long, part long, is_next boolean").repartition("part")
    compared = moved.sortWithinPartitions("part", "is_next", *order).mapInArrow(_compared(width, part), f"id {kind}, {_JUDGED}")
    return compared.withColumnRenamed("id", id_column)
