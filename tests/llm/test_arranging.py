"""Mixing, packing, sharding and chat formatting: totals, round trips and brute force."""

import hashlib
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colsight.llm import chat_format, mixing, packing, sharding
from colsight.llm.shared import row_numbers, running_totals


def shares(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by resharing what is above until nothing is."""
    left, open_sources, out = share * sum(sizes.values()), dict(enumerate(sizes)), {}
    weight = {s: weights[i % len(weights)] for i, s in open_sources.items()}
    names = list(sizes)
    while names:
        level = left / sum(weight[s] for s in names)
        full = [s for s in names if level * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: level * weight[s] for s in names}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            names.remove(s)
    return out


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets(spark, sizes):
    named = {f"0s{i}": n for i, n in enumerate(sizes)}
    got = mixing.targets(spark.createDataFrame(list(named.items()), "origin string, source_size long"))
    want = shares(named)
    assert all(abs(r.target - want[r.origin]) < 1e-3 for r in got.collect())


def test_mix(docs, no_docs, rows):
    size = mixing.word_count(F.col("text"))
    mixed = mixing.mix(docs, size).select("doc_id", "source", "size", "source_size", "target", "epochs", "copies").collect()
    assert len(mixed) == len(rows)
    order = sorted({s for _, _, s in rows if s is not None}) + [None]
    sizes = {s: sum(len((t or "").encode().split()) for _, t, x in rows if x == s) for s in order}
    want = shares(sizes)
    for r in mixed:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-3 and r.epochs <= r.copies <= 2
    again = mixing.mix(docs.repartition(7), size).select("doc_id", "source", "size", "source_size", "target", "epochs", "copies").collect()
    assert sorted(map(str, mixed)) == sorted(map(str, again))
    taken = mixing.mixed_documents(docs, size)
    assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in mixed)
    assert mixing.mix(no_docs, size).collect() == [] == mixing.mixed_documents(no_docs, size).collect()


def test_mix_reaches_targets(spark):
    frame = spark.range(3000).selectExpr("id AS doc_id", "concat('s', id % 7) AS source", "1 + id * 7919 % 400 AS n", "1 + id % 5 AS quality")
    mixed = mixing.mix(frame, F.col("n"), F.col("quality")).toPandas()
    mixed["taken"] = mixed["size"] * mixed.copies
    for _, part in mixed.groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 0.01 * part.source_size.iloc[0]
    some = mixed[(mixed.target < mixed.source_size)]
    chosen, left = some[some.copies > 0].quality.mean(), some[some.copies == 0].quality.mean()
    assert chosen > left  # heavier documents are taken more often


def test_running_totals(spark):
    rows = [("hot" if i % 3 else f"g{i % 5}", i % 50, i) for i in range(2000)]
    frame = spark.createDataFrame(rows, "g string, o int, n int")
    got = running_totals(frame, "g", ["o", "n"], total=F.col("n").cast("long")).collect()
    seen = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.g, r.o, r.n)):
        assert r.total == seen[r.g]
        seen[r.g] += r.n
    assert [r.number for r in sorted(row_numbers(frame, "o", "n").collect(), key=lambda r: (r.o, r.n))] == list(range(2000))


@settings(deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 9))
def test_best_fit(sizes, open_bins):
    """Bins never overflow, and a piece takes the fullest open bin it fits into."""
    packer, open_now, used = packing.BestFit(64, open_bins), {}, defaultdict(int)
    for size in sizes:
        fitting = [free for free in open_now.values() if free >= size]
        number, offset = packer.place(size)
        if fitting:
            assert open_now[number] == min(fitting)
        elif len(open_now) == open_bins:
            fullest = min(open_now.values())
            closed = [b for b in open_now if b not in {x for held in packer.bins for x in held} and b != number]
            assert len(closed) == 1 and open_now.pop(closed[0]) == fullest
        assert offset == used[number]
        used[number] += size
        open_now[number] = 64 - used[number]
        if not open_now[number]:
            del open_now[number]
        assert len(open_now) == packer.open <= open_bins
    assert all(n <= 64 for n in used.values())


@cache
def reference():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer


public_encoder = cache(packing.public_encoder)


def reference_ids(texts):
    return [e.ids for e in reference().encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_the_reference_library(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += ["", " ", "<|endoftext|>", "a b　c", "'S 're x's", "١٢٣ ⅷ ½", "é‍👩‍💻", "\r\n \r\n\t\x85\x1c", "x" * 5000, " " * 3000 + "y"]
    encode = public_encoder()
    assert [encode(t) for t in texts] == reference_ids(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=10))
def test_encoder_on_any_text(texts):
    encode = public_encoder()
    assert [encode(t) for t in texts] == reference_ids(texts)


def test_encoder_on_long_white_space():
    assert public_encoder()(" " * 1_000_000) == reference_ids([" " * 1_000_000])[0]


def test_packed_ids_equal_the_unmodified_reference_library(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}", f"  {end}  x", f"<|{end}|>", end[:-1], end.upper(), f"é{end}漢 字", "plain text", f"{' ' * 1_000_000}{end} x"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = defaultdict(list)
    for r in packing.pack_documents(frame, ["doc_id"], with_ids=True).collect():
        got[r.row.doc_id].append((r.start, list(r.ids)))
    plain = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = {n: [*plain.encode(t, add_special_tokens=False).ids, packing.END_ID] for n, t in enumerate(texts)}
    assert {n: [i for _, ids in sorted(pieces) for i in ids] for n, pieces in got.items()} == want


def test_packing_round_trip(docs, no_docs, rows):
    packed = packing.pack_documents(docs, ["doc_id", "text"], with_ids=True).toPandas()
    sequences = defaultdict(dict)
    for r in packed.itertuples():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        assert (r.sequence_id, r.offset) not in sequences
        sequences[r.sequence_id][r.offset] = r.length
    for held in sequences.values():
        assert list(np.cumsum([0, *[held[o] for o in sorted(held)]]))[:-1] == sorted(held) and sum(held.values()) <= 2048
    ids = {t: [*i, 0] for t, i in zip([t or "" for _, t, _ in rows], reference_ids([t or "" for _, t, _ in rows]), strict=True)}
    pieces = defaultdict(list)
    for r in packed.itertuples():
        pieces[r.row["text"] or ""].append((r.start, r.piece, list(r.ids)))
    for text, found in pieces.items():
        copies = sum((t or "") == text for _, t, _ in rows)
        assert [i for _, _, part in sorted(found) for i in part] == _repeated(ids[text], copies, found)
    assert packing.pack_documents(no_docs, ["doc_id"]).collect() == []


def _repeated(ids, copies, found):
    starts = sorted(s for s, _, _ in found)
    ends = [*starts[copies::copies], len(ids)]
    return [i for s, e in zip(starts[::copies], ends, strict=True) for _ in range(copies) for i in ids[s:e]]


@given(st.integers(1, 20_000))
def test_piece_lengths(total):
    pieces = packing.piece_lengths(total, 2048)
    assert sum(pieces) == total and set(pieces[1:]) <= {2048} and 0 < pieces[0] <= 2048


def test_packing_needs_few_sequences(spark):
    lengths = spark.range(20_000).selectExpr("id", "1 + id * 7919 % 2048 AS length")
    packed = packing.pack(lengths)
    total = lengths.agg(F.sum("length")).first()[0]
    assert packed.select("sequence_id").distinct().count() <= 1.01 * total / 2048


@pytest.mark.parametrize("rows", [1, 2, 3, 10, 97, 1000])
def test_permutation(spark, rows):
    passes = sharding.walk_length(spark, rows)
    at = sharding.permuted(F.col("id"), rows, passes)
    frame = spark.range(rows).select("id", at.alias("at")).withColumn("back", sharding.permuted(F.col("at"), rows, passes, back=True))
    got = frame.collect()
    assert sorted(r["at"] for r in got) == list(range(rows)) and all(r.back == r.id for r in got)


def test_shards(spark, docs):
    plain = docs.selectExpr("doc_id", "length(text) AS size")
    got = sharding.shuffle_shards(plain, 4, ["doc_id", "size"]).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == [0, 1, 2, 3] and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shuffle_shards(plain.repartition(5), 4, ["doc_id", "size"]).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    passes = sharding.walk_length(spark, len(got))
    back = spark.createDataFrame(got).select("number", sharding.row_at(F.col("shard").cast("long"), F.col("slot"), 4, len(got), passes).alias("back"))
    assert all(r.number == r.back for r in back.collect())
    assert sharding.shuffle_shards(plain.where("1 = 0"), 4, ["doc_id", "size"]).collect() == []


def test_shards_keep_columns(docs, no_docs):
    """Columns named like inner ones come back as they were; ``number``, ``shard`` and ``slot`` are replaced."""
    added = ("number", "shard", "slot")
    for frame in (docs, no_docs):
        got = sharding.shuffle_shards(frame, 4, ["doc_id", "key"])
        rest = [c for c in frame.columns if c not in added]
        assert got.columns == [*rest, *added]
        assert sorted(map(str, got.select(rest).collect())) == sorted(map(str, frame.select(rest).collect()))
        assert sorted(r.number for r in got.collect()) == list(range(frame.count()))


def formatted(turns):
    sides = defaultdict(lambda: {"chosen": [], "rejected": []})
    for pair, side, turn, role, text in turns:
        sides[pair][side].append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    out = []
    for pair, both in sides.items():
        chosen, rejected = ([(r if k else None, t if m else None) for _, _, k, r, m, t in sorted(both[s])] for s in ("chosen", "rejected"))
        n = 0
        while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
            n += 1
        for part, held, first in (("prompt", chosen[:n], 0), ("chosen", chosen[n:], n), ("rejected", rejected[n:], n)):
            start = 0
            for i, (role, text) in enumerate(held):
                head = f"<|{role or ''}|>\n"
                whole = f"{head}{text or ''}<|end|>\n"
                learnt = part != "prompt" and role == "assistant"
                out.append((pair, part, first + i, role, start, whole, len(head) if learnt else 0, len(whole) - len(head) if learnt else 0))
                start += len(whole)
    return out


def test_preferences(spark):
    turns = []
    for side, last in (("chosen", "good"), ("rejected", "bad")):
        turns += [(1, side, 0, "user", "hi"), (1, side, 1, "assistant", "yes?"), (1, side, 2, "user", "tell"), (1, side, 3, "assistant", last)]
        turns += [(2, side, 0, "user", "same"), (2, side, 1, "assistant", "same")]
        turns += [(None, side, None, "user", "null pair"), (None, side, 1, None, None), (None, side, 1, "assistant", last)]
        turns += [(4, side, 0, "user", "é" * 50_000), (4, side, 0, "user", "tie"), (4, side, 1, "assistant", "")]
    turns += [(1, "rejected", 4, "user", "more"), (3, "chosen", 0, "assistant", "alone"), (5, "rejected", 0, "assistant", "alone")]
    turns += [(6, "chosen", 0, "user", "twice"), (6, "chosen", 0, "user", "twice"), (6, "rejected", 0, "user", "twice")]
    frame = spark.createDataFrame(turns, "pair long, side string, turn int, role string, text string").withColumn("position", F.lit(5)).repartition(4)
    for large in (2, 4096):
        got = chat_format.format_preferences(frame, large)
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, formatted(turns)))
    assert chat_format.format_preferences(frame.where("1 = 0")).collect() == []


def branch_of(number, last):
    digest = int(hashlib.md5(("" if number is None else str(number)).encode()).hexdigest()[:8], 16)
    return digest // 8 % (last + 2) if digest % 8 else None


def test_branched_pairs(spark):
    """Sides that part early, late and not at all, and pairs without a rejected side, against brute force."""
    rows = [(n, t, "assistant" if t % 2 else "user", f"text {n if t > 2 else 0} {t}") for n in range(60) for t in range(1 + n % 7)]
    rows += [(None, 0, "user", "d"), (None, None, None, None), (100, 0, "user", "c"), (100, 0, "user", "c"), (101, 3, "user", "z")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(4)
    ids = sorted({r[0] for r in rows}, key=lambda n: (n is not None, n or 0))
    turn = lambda r: -1 if r[1] is None else r[1]
    pairs = [(n, "chosen", t, r, x) for n, t, r, x in rows]
    for number, following in zip(ids, [*ids[1:], ids[0]], strict=True):
        branch = branch_of(number, max(turn(r) for r in rows if r[0] == number))
        if branch is not None:
            pairs += [(number, "rejected", *r[1:]) for r in rows if r[0] == number and turn(r) < branch]
            pairs += [(number, "rejected", *r[1:]) for r in rows if r[0] == following and turn(r) >= branch]
    want = formatted(pairs)
    prefixes = {p: sum(r[0] == p and r[1] == "prompt" for r in want) for p in ids}
    assert len(set(prefixes.values())) > 4 and any(sum(r[0] == p and r[1] == "rejected" for r in want) == 0 for p in ids)
    texts = frame.select(chat_format.text_key(F.col("text")).alias("text_key"), "text")
    for large in (3, 4096):
        got = chat_format.format_keys(chat_format.stored(chat_format.branched_keys(frame)), texts, large)
        assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(r) for r in want)
    assert chat_format.branched_keys(frame.where("1 = 0")).collect() == []


def test_a_common_turn(spark):
    """A text that stands in a third of all turns is dealt over copies and found at every place."""
    turns = [(n, side, t, "user", "hello" if t == 0 else f"{n} {side if t == 2 else ''}") for n in range(300) for side in ("chosen", "rejected") for t in range(3)]
    got = chat_format.format_preferences(spark.createDataFrame(turns, "pair long, side string, turn int, role string, text string").repartition(5))
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(r) for r in formatted(turns))
