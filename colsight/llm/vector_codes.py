"""Vector codes: each part of a vector becomes the index of its nearest entry in a small codebook.

Vectors turn into integers, and codebooks are fitted by rounds of integer k-means. The nearest entry is searched
after an integer Walsh-Hadamard transform of parts and entries, both padded with zeros to a power of two: it
multiplies squared distances by the padded length, and its first coordinates, in sequency order, hold most of
the difference of smooth parts. Squared differences are summed in that order, and an entry whose partial sum
exceeds the whole distance of a leading one is given up. All of it is integer arithmetic, so sums do not depend
on the order of rows; where 64 bits might not hold a sum, Python's integers do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsight.llm.shared import BROADCAST_BYTES, boxed, quoted, stored, unboxed

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
_ROWS = 4096  # vectors compared at once
_LIMB = 40
_HOT = 1024
_MOST = 2**63 - 1


@lru_cache
def _sequency(size: int) -> np.ndarray:
    """Columns of the transform by the number of their sign changes."""
    signs = _butterfly(np.eye(size, dtype=np.int64))
    return np.argsort((signs[1:] != signs[:-1]).sum(axis=0), kind="stable")


def _butterfly(rows: np.ndarray) -> np.ndarray:
    size, step = rows.shape[1], 1
    while step < size:
        pairs = rows.reshape(len(rows), -1, 2, step)
        rows = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(rows), size)
        step *= 2
    return rows


def walsh(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of integer rows, padded with zeros to a power of two, in sequency order."""
    size = 1 << max(0, rows.shape[1] - 1).bit_length()
    padded = np.concatenate([rows, np.zeros((len(rows), size - rows.shape[1]), rows.dtype)], axis=1)
    return _butterfly(padded)[:, _sequency(size)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``parts`` the index of the nearest entry, ties to the lower one, and its squared distance."""
    rows, book = walsh(parts), walsh(entries)
    size, n = rows.shape[1], len(rows)
    if 2 * size * (int(np.abs(parts).max(initial=0)) + int(np.abs(entries).max(initial=0))) >= 1 << 31:
        rows, book = rows.astype(object), book.astype(object)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, rows.dtype)
    first = (rows[:, :1] - book[:, 0]) ** 2  # the first coordinate of every pair; later ones only of those that are left
    lead = first.argmin(axis=1)
    gaps = rows - book[lead]
    row, entry = np.nonzero(first <= (gaps * gaps).sum(axis=1)[:, None])
    sums = first[row, entry]
    done = 1
    while done < size:
        until = 2 * done
        gaps = rows[row, done:until] - book[entry, done:until]
        sums = sums + (gaps * gaps).sum(axis=1)
        lead = _least(row, sums, n)
        if until < size:
            gaps = rows - book[entry[lead]]
            stay = sums <= (gaps * gaps).sum(axis=1)[row]
            row, entry, sums = row[stay], entry[stay], sums[stay]
        done = until
    found = _least(row, sums, n)
    return entry[found], sums[found] // size


def _least(row: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` rows the first place among its ``sums`` that holds the least; ``row`` ascends."""
    least = np.minimum.reduceat(sums, np.searchsorted(row, np.arange(n)))
    hits = np.flatnonzero(sums == least[row])
    return hits[np.searchsorted(row[hits], np.arange(n))]


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _integers(vectors: pa.ListArray, width: int) -> np.ndarray:
    """``floor(256 * x)`` of each component; shorter vectors end in zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if np.abs(flat).max(initial=0) < 2.0**40:
        whole = np.floor(flat * SCALE).astype(np.int64)
    else:
        whole = np.array([floor(Fraction(x) * SCALE) for x in flat.tolist()], object)
    lengths = np.diff(vectors.offsets.to_numpy())
    rows = np.zeros((len(vectors), width), whole.dtype)
    rows[np.arange(width) < lengths[:, None]] = whole
    return rows


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """Pieces of an integer which longs can sum up: ``value`` is the sum of ``piece << (40 * place)``."""
    sign, rest, place = (-1 if value < 0 else 1), abs(value), 0
    while rest:
        if piece := rest & (1 << _LIMB) - 1:
            yield place, sign * piece
        rest, place = rest >> _LIMB, place + 1


def _sums(books: list[np.ndarray], width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a task: how many parts each entry is nearest to (``position`` -1), and the sums of their components."""
    length = width // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(books), len(books[0]), length + 1), object)
        for batch in _pieces(batches):
            rows = _integers(batch.column("vector"), width)
            for p, book in enumerate(books):
                part = rows[:, p * length : (p + 1) * length]
                found = np.zeros(totals.shape[1:], rows.dtype)
                np.add.at(found, nearest(part, book)[0], np.concatenate([part, np.ones((len(part), 1), rows.dtype)], axis=1))
                totals[p] += found
        cells = [(*at, *limb) for at, total in np.ndenumerate(totals) if total for limb in _limbs(int(total))]
        if cells:
            columns = [pa.array(c, t) for c, t in zip(zip(*cells, strict=True), [pa.int32()] * 4 + [pa.int64()], strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "position", "place", "total"])

    return run


def fit_codebooks(df: DataFrame, id_column: str, vector: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """One integer codebook for each part position, or none without usable vectors.

    Codebooks start as the parts of the vectors with the smallest ids (null ids last, ties by the vector). Each round
    assigns every part to its nearest entry and replaces an entry by the rounded-down mean of its parts. A task sends the
    sums of its parts, ``parts * entries`` short rows whatever it read; what comes to the driver is one model. Vectors
    of unlike lengths are taken as ending in zeros, and so is a length that ``parts`` does not divide.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be between 1 and 256, as a code has two hex digits a part")
    kept = df.select(F.col(quoted(id_column)).alias("id"), F.col(quoted(vector)).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).toArrow()
    if not first.num_rows:
        return []
    length = max(1, -(-kept.agg(F.max(F.size("vector"))).first()[0] // parts))
    starts = _integers(first.column("vector").combine_chunks(), parts * length)
    books = [starts[:, p * length : (p + 1) * length] for p in range(parts)]
    for _ in range(rounds):
        sums = kept.select("vector").mapInArrow(_sums(books, parts * length), "part int, entry int, position int, place int, total long")
        totals = np.zeros((parts, len(books[0]), length + 1), object)
        for part, entry, position, place, total in sums.groupBy("part", "entry", "position", "place").agg(F.sum("total")).collect():
            totals[part, entry, position] += total << (_LIMB * place)
        books = [_means(book, total) for book, total in zip(books, totals, strict=True)]
    return books


def _means(book: np.ndarray, totals: np.ndarray) -> np.ndarray:
    used = totals[:, -1] > 0
    means = book.astype(object)
    means[used] = totals[used, :-1] // totals[used, -1:]
    return means.astype(np.int64) if np.abs(means).max(initial=0) < 1 << 48 else means


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def _coded(books: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    length = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            rows = _integers(batch.column("vector"), len(books) * length)
            found = [nearest(rows[:, p * length : (p + 1) * length], book) for p, book in enumerate(books)]
            codes = np.stack([code for code, _ in found], axis=1).astype(np.uint8)
            errors = sum(error.astype(object) for _, error in found)
            made = [pa.array([c.tobytes().hex() for c in codes]), pa.array([e if e <= _MOST else None for e in errors], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *made], names=["row", "code", "error"])

    return run


def compress(df: DataFrame, books: list[np.ndarray], vector: str) -> DataFrame:
    """The rows with a usable vector, with all columns and two more, which replace columns of the same name.

    ``code``: indexes of the nearest entries in part order, two hex digits each. ``error``: the squared distances summed over
    the parts, null beyond a long. Repeated rows stay. ``books`` must come from these vectors or longer ones; without
    books there are no rows.
    """
    rows = boxed(df, vector=F.col(quoted(vector)).cast("array<double>")).where(usable(F.col("vector")) & F.lit(bool(books)))
    kind = rows.schema["row"].dataType.simpleString()
    coded = rows.mapInArrow(_coded(books or [np.zeros((1, 1), np.int64)]), f"row {kind}, code string, error long")
    return unboxed(coded, df.columns, code=F.col("code"), error=F.col("error"))


def with_group_errors(coded: DataFrame, group: str, small: int = BROADCAST_BYTES) -> DataFrame:
    """Adds ``label_error``: ``error`` of a stored frame summed over equal values of ``group``, nulls together.

    Sums are combined before the shuffle. They are broadcast within ``small`` bytes; beyond, only those of values that hold
    over 1/1024 of the rows, 1,024 at most, are, so that no value's rows meet in one task.
    """
    named = boxed(coded, group=F.col(quoted(group)), error=F.col("error"))
    sums = F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")
    totals = stored(named.groupBy("group").agg(sums, F.count("*").alias("n")).withColumnRenamed("group", "of"))
    same = F.col("group").eqNullSafe(F.col("of"))
    if totals.count() * 32 <= small:
        joined = named.join(F.broadcast(totals), same)
    else:
        hot = F.broadcast(totals.where(F.col("n") * _HOT > coded.count()))
        joined = named.join(hot, same).unionByName(named.join(hot, same, "left_anti").join(totals, same))
    return unboxed(joined, coded.columns, label_error=F.col("label_error"))
