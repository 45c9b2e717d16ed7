"""Exact copies, fingerprints and near copies against brute force."""

import hashlib
import random
from collections import defaultdict
from itertools import combinations

import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colsight.llm import exact_dedup, near_copies, simhash_dedup
from colsight.llm.components import components

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def connected(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])


def bits(text, width=3):
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, width)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_exact_copies(docs, rows):
    groups = defaultdict(list)
    for number, text, _ in rows:
        groups[(text or "").translate(LOWER)].append(number)
    want = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        want += [(i, keep, len(ids), digest) for i in ids]
    for block_bytes in (64, 512):
        got = exact_dedup.find_copies(docs, block_bytes=block_bytes).collect()
        key = lambda r: tuple(str(x) for x in r)
        assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(want, key=key)
        assert sum(r.kept for r in got) == len(groups)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_copies_keep_all_columns(docs, no_docs, rows):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({(t or "").translate(LOWER) for _, t, _ in rows})
    assert exact_dedup.drop_copies(no_docs).collect() == [] == exact_dedup.find_copies(no_docs).collect()


def test_names_compare_whole_blocks(spark):
    """Blocks that differ in the last byte, or in how they are cut, never share an identity."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").selectExpr("doc", "text", "named_struct('n', doc) AS box")
    got = {r.doc: (r.level, r.name) for r in exact_dedup.identities(frame.repartition(5), 2).collect()}
    assert len(got) == len(texts)
    assert len(set(got.values())) == len(set(texts)) == len(set(zip(texts, [got[i] for i in range(len(texts))], strict=True)))


def test_fingerprints_and_components(docs, no_docs, rows):
    got = simhash_dedup.near_components(docs).collect()
    prints = [bits(text) for _, text, _ in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2]
    label = connected(range(len(rows)), links)
    least = defaultdict(list)
    for i, (number, _, _) in enumerate(rows):
        if number is not None:
            least[label[i]].append(number)
    want = [(number, f"{prints[i]:016x}", min(least[label[i]], default=None)) for i, (number, _, _) in enumerate(rows)]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)
    assert simhash_dedup.near_components(no_docs).collect() == []


def test_fingerprint_links_find_every_pair(spark):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(60)}
    for value in list(values):
        for _ in range(6):
            value ^= 1 << rng.randrange(64)
            values.add(value)
    frame = spark.createDataFrame([(simhash_dedup.signed(v),) for v in values], "fp long")
    for radius in (0, 1, 2, 3):
        links = [tuple(r) for r in simhash_dedup.fingerprint_links(frame, radius).collect()]
        signed = sorted(simhash_dedup.signed(v) for v in values)
        mask = 2**64 - 1
        want = [(a, b) for a, b in combinations(signed, 2) if ((a & mask) ^ (b & mask)).bit_count() <= radius]
        assert connected(signed, links) == connected(signed, want)
        assert all(((a & mask) ^ (b & mask)).bit_count() <= radius for a, b in links)


@given(st.lists(st.integers(0, 255), max_size=40), st.integers(0, 255), st.integers(0, 8))
def test_bk_tree(values, wanted, radius):
    tree = simhash_dedup.BKTree()
    for item, value in enumerate(values):
        tree.add(value, item)
    assert sorted(tree.within(wanted, radius)) == [i for i, v in enumerate(values) if (v ^ wanted).bit_count() <= radius]


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = connected({n for pair in links for n in pair}, links)
    assert all(got.get(n, n) == root for n, root in want.items())
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def near_rows():
    rng = random.Random(5)
    rows, number = [], 0
    for group in range(8):
        words = [f"w{rng.randrange(5000)}" for _ in range(240 + 40 * group)]
        for copy in range(5):
            changed = list(words)
            for _ in range(copy):
                changed[rng.randrange(len(words))] = f"v{rng.randrange(5000)}"
            rows.append((number, " ".join(changed)))
            number += 1
        rows.append((number, " ".join(words[:60] + [f"u{rng.randrange(5000)}" for _ in range(200)])))
        number += 1
    return rows + [(None, rows[0][1]), (900, None), (901, ""), (902, "one two"), (903, "One two"), (903, "One two")]


def near_want(rows):
    sets = [set(shingles(text, 5)) for _, text in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) ** 2 >= 64 * len(sets[i]) * len(sets[j])]
    label = connected(range(len(rows)), links)
    groups = defaultdict(list)
    for i, (number, _) in enumerate(rows):
        groups[label[i]].append(number)
    return sorted([min((n is None, n or 0) for n in ids) for ids in groups.values()])


def test_near_copies(spark):
    rows = near_rows()
    frame = spark.createDataFrame([(n, t, 1, 2) for n, t in rows], "doc_id long, text string, item int, root int").repartition(4)
    kept = near_copies.drop_near_copies(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == near_want(rows)
    assert near_copies.drop_near_copies(frame.where("1 = 0")).collect() == []


def test_near_copies_in_blocks(spark):
    """A shard dealt into blocks finds the same groups."""
    rows = near_rows()
    frame = spark.createDataFrame(list(enumerate(t for _, t in rows)), "item long, text string")
    signatures = near_copies.stored(frame.mapInArrow(near_copies._signatures(5), "item long, fp long, bands array<long>, grams binary"))
    found = [connected(range(len(rows)), [tuple(r) for r in near_copies.near_links(signatures, shard_rows=n).collect()]) for n in (2, 3, 4096)]
    assert found[0] == found[1] == found[2]


def test_blocks_of_a_chain(spark):
    """A shard whose first text is like few others: each text is like its neighbours only, so the rest meets in cells."""
    words = [f"w{i}" for i in range(1000)]
    rows = [(i, " ".join(words[12 * i : 12 * i + 200])) for i in range(40)] + [(40 + i, " ".join(f"x{i}y{k}" for k in range(60))) for i in range(30)]
    frame = spark.createDataFrame(rows, "item long, text string")
    signatures = near_copies.stored(frame.mapInArrow(near_copies._signatures(5), "item long, fp long, bands array<long>, grams binary").withColumn("bands", F.array(F.lit(7).cast("long"))))
    for shard_rows in (3, 16, 4096):
        label = connected(range(70), [tuple(r) for r in near_copies.near_links(signatures, shard_rows=shard_rows).collect()])
        assert [label[i] for i in range(70)] == [0] * 40 + list(range(40, 70))


def test_equal_sets_are_one_node(spark):
    """Texts of one shingle set, however many, and a near copy of them; texts without words stay apart."""
    words = [f"w{i}" for i in range(100)]
    rows = [(i, ("  " if i % 2 else " ").join(words) + " " * i) for i in range(50)] + [(50, " ".join(words[:97])), (51, ""), (52, None), (53, " ")]
    kept = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 51, 52, 53]


def test_near_copies_with_repeated_passages(spark):
    """A passage that one copy repeats changes its shingle set little, however often it stands there."""
    rng, rows = random.Random(8), []
    for group in range(30):
        words = [f"g{group}w{i}" for i in range(100 if group % 2 else 300)]
        at = rng.randrange(40, 60)
        rows += [(2 * group, " ".join(words)), (2 * group + 1, " ".join(words[:at] + words[at - 5 : at] * 39 + words[at:]))]
    assert near_want(rows) == [(False, 2 * group) for group in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((r.doc_id is None, r.doc_id) for r in near_copies.drop_near_copies(frame).collect()) == near_want(rows)
