"""Best-fit packing of tokenized documents into sequences of a fixed length.

Bounded-space online best-fit: a fixed number of bins is open, found by a bitset keyed by free space. A
piece goes into the bin it fills most; when a new bin is needed and all are open, the fullest closes.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from colsight.llm.shared import quoted, stored

LENGTH, OPEN_BINS, CHUNK_PIECES, BATCH_PIECES, END_ID = 2048, 8192, 1 << 17, 8192, 0
SPECIAL_TOKENS = {"<|endoftext|>": 50256}


class BestFit:
    """Open bins by free space: bit ``f`` of ``free`` is set while a bin with ``f`` free places is open."""

    def __init__(self, length: int, open_bins: int) -> None:
        self.length, self.limit = length, open_bins
        self.free, self.open, self.bins, self.made = 0, 0, [[] for _ in range(length + 1)], 0

    def place(self, size: int) -> tuple[int, int]:
        """The bin that takes the piece, and the place of the piece in it."""
        fitting = self.free >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(space)
        else:
            if self.open == self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
            space, bin_id = self.length, self.made
            self.made += 1
        if space > size:
            self.bins[space - size].append(bin_id)
            self.free |= 1 << (space - size)
            self.open += 1
        return bin_id, self.length - space

    def _take(self, space: int) -> int:
        bin_id = self.bins[space].pop()
        if not self.bins[space]:
            self.free &= ~(1 << space)
        self.open -= 1
        return bin_id


def piece_lengths(total: int, length: int) -> list[int]:
    """A document that fits stays whole; of a longer one only the first piece may be shorter."""
    head = total % length
    return [head] * bool(head) + [length] * (total // length)


def encoder(ranks: str, fallback: str, special_tokens: dict[str, int] | None = None) -> Callable[[str], list[int]]:
    """Ids of a text to which no special tokens are added. What reads like one of ``special_tokens`` is that token's id.

    ``ranks`` and ``fallback`` are files of the same byte-level vocabulary. The first is read by the faster
    library; the second, by the reference library, takes over where the first one fails on a text.
    """
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=merges, special_tokens=special_tokens or {})
    slow: list[Tokenizer] = []

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except BaseException as error:  # its regular expressions give up on very long runs of white space
            if type(error).__name__ != "PanicException" and not str(error).startswith("Regex error"):
                raise
            if not slow:
                slow.append(Tokenizer.from_file(fallback))
                slow[0].encode_special_tokens = not special_tokens
            return slow[0].encode(text, add_special_tokens=False).ids

    return encode


def public_encoder(special_tokens: dict[str, int] | None = None) -> Callable[[str], list[int]]:
    from public_tokenizers import path

    return encoder(path("byte_bpe_50k.tiktoken"), path("byte_bpe_50k.json"), special_tokens)


def file_encoder() -> Callable[[str], list[int]]:
    """Ids as the reference library gives them with the vocabulary file as it is, its special tokens included."""
    return public_encoder(SPECIAL_TOKENS)


def _pieces(make_encoder: Callable[[], Callable[[str], list[int]]], length: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for batch in batches:
            rows, ids = [], []
            for at, text in enumerate(batch.column("text")):
                tokens = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                start = 0
                for number, size in enumerate(piece_lengths(len(tokens), length)):
                    held = tokens[start : start + size]
                    rows.append((at, number, start, size, zlib.crc32(held.tobytes())))
                    ids.append(held.astype(np.int32) if with_ids else None)
                    start += size
            at, number, start, size, crc = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
            columns = [batch.column("row").take(pa.array(at)), pa.array(number, pa.int32()), pa.array(start), pa.array(size), pa.array(crc)]
            names = ["row", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def tokenize(
    docs: DataFrame,
    carry: list[str],
    text: str = "text",
    length: int = LENGTH,
    make_encoder: Callable[[], Callable[[str], list[int]]] = file_encoder,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: the columns ``carry`` of its document in a struct ``row``, ``piece``, ``start``, ``length`` and
    ``ids_crc32`` (of the ids as little-endian unsigned 32-bit numbers), and the ``ids`` themselves if wanted.

    A document is its ids and one end id, so a null or empty text is one piece of one id.
    """
    columns = docs.select(F.struct(*[F.col(quoted(c)) for c in carry]).alias("row"), F.col(quoted(text)).cast("string").alias("text"))
    fields = [StructField("row", columns.schema["row"].dataType), StructField("piece", IntegerType())]
    fields += [StructField(name, LongType()) for name in ("start", "length", "ids_crc32")]
    fields += [StructField("ids", ArrayType(IntegerType()))] * with_ids
    return columns.mapInArrow(_pieces(make_encoder, length, with_ids), StructType(fields))


def _best_fit(length: int, open_bins: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, packer = None, BestFit(length, open_bins)
        for batch in batches:
            placed = []
            for number, size in zip(batch.column("chunk").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if number != chunk:
                    chunk, packer = number, BestFit(length, open_bins)
                bin_id, offset = packer.place(size)
                placed.append((chunk << 40 | bin_id, offset))
            made = [pa.array([p[side] for p in placed], pa.int64()) for side in (0, 1)]
            rest = batch.drop_columns(["chunk"])
            yield pa.RecordBatch.from_arrays([*rest.columns, *made], names=[*rest.schema.names, "sequence_id", "offset"])

    return run


def pack(
    pieces: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, chunk_pieces: int = CHUNK_PIECES, batch_pieces: int = BATCH_PIECES
) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored ``pieces`` with a column ``length`` of at most ``length``.

    Chunks of about ``chunk_pieces`` pieces, dealt by a hash of the whole piece, are packed apart; each leaves at
    most ``open_bins`` sequences that could have taken more. In a chunk pieces come in batches, by another hash, and
    by length in a batch: its short pieces fill what its long ones leave. Sorting the whole chunk by length would
    need a bin for each long piece at once. Equal rows may change places, which changes nothing.
    """
    known = [c for c in pieces.columns if c != "ids"]
    total = pieces.count()
    chunks = max(1, -(-total // chunk_pieces))
    batches = max(1, -(-total // (chunks * batch_pieces)))
    dealt = pieces.withColumn("chunk", F.pmod(F.xxhash64(*known), F.lit(chunks)))
    order = ["chunk", F.pmod(F.xxhash64(F.lit("batch"), *known), F.lit(batches)), F.desc("length"), *known]
    schema = StructType([StructField(f.name, f.dataType) for f in pieces.schema] + [StructField(n, LongType()) for n in ("sequence_id", "offset")])
    ranged = dealt.repartition(chunks, "chunk").sortWithinPartitions(*order)
    return ranged.mapInArrow(_best_fit(length, open_bins), schema)


def pack_documents(docs: DataFrame, carry: list[str], text: str = "text", length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Tokenizes and packs: one row per piece with ``row``, its span in the document and its place in a sequence."""
    return pack(stored(tokenize(docs, carry, text, length, with_ids=with_ids)), length)
