"""Lexical search and document sketches against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from colsight.llm import doc_sketches, lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k):
    held = [(number, Counter(terms(text)), len(terms(text))) for number, text in docs]
    n, total = sum(1 for d in held if d[2]), sum(d[2] for d in held)
    df = Counter(t for _, c, _ in held for t in c)
    want = []
    for item, text in items:
        scores = []
        for number, c, length in held:
            m = 75 + 25 * length * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            scores.append((-score, number is None, number))
        best = [s for s in sorted(scores) if s[0] < 0][:k]
        want += [(item, rank + 1, s[2], -s[0]) for rank, s in enumerate(best)]
    return sorted(want, key=str)


ITEMS = [
    (1, "the end of One"),
    (2, None),
    (3, "--- ...\x00"),
    (4, "absent5 words6"),
    (None, "漢字 😀, the THE the"),
    (5, "two-one two"),
    (5, "two-one two"),
    (6, "x" * 1536),
]


@pytest.mark.parametrize("block_bytes", [1, 40, 1 << 20])
def test_best_documents(spark, docs, rows, block_bytes):
    items = spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in ITEMS], "item_id long, text string, row string, number int, block int, all string")
    got = lexical_search.best_documents(docs, items, k=3, block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == ranked([r[:2] for r in rows], ITEMS, 3)


def test_many_documents(spark):
    """Several chunks and levels of both trees, with groups of copies."""
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    docs = [(n, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for n in range(900)]
    docs += [(1000 + n, docs[n % 3][1]) for n in range(300)]
    items = [(n, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for n in range(90)]
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, lexical_search.best_documents(*frames).collect()), key=str) == ranked(docs, items, 20)


def test_search_of_empty_tables(spark, docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for left, right in ((no_docs, items), (docs, items.where("1 = 0")), (no_docs, items.where("1 = 0"))):
        assert lexical_search.best_documents(left, right).collect() == []


@given(st.text(max_size=60))
def test_terms(text):
    assert lexical_search.terms(text) == [t.encode() for t in terms(text)]


def test_fingerprints(docs, rows, no_docs):
    got = doc_sketches.fingerprints(docs).collect()
    want = Counter((n, doc_sketches.packed(doc_sketches.sketch(t))) for n, t, _ in rows)
    assert Counter(map(tuple, got)) == want
    assert doc_sketches.fingerprints(no_docs).collect() == []
    lengths = {n: len(f) // 8 for n, f in want}
    assert lengths[4] == lengths[5] == lengths[6] == 0 and lengths[7] == 1  # none without words, one at least with words
    assert 0.23 < lengths[10] / 59_996 < 0.27  # every fourth shingle


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_likeness_of_texts():
    rng = random.Random(5)
    for _ in range(20):
        a = [str(rng.random()) for _ in range(rng.randint(300, 2000))]
        b = a[rng.randint(0, 200) :] + [str(rng.random()) for _ in range(rng.randint(0, 5000))]
        sets = [shingles(" ".join(w)) for w in (a, b)]
        sketches = [doc_sketches.sketch(" ".join(w)) for w in (a, b)]
        both = len(sets[0] & sets[1])
        assert abs(doc_sketches.likeness(*sketches) - both / len(sets[0] | sets[1])) < 0.15
        assert abs(doc_sketches.containment(*sketches) - both / min(map(len, sets))) < 0.15


def test_contained_in_a_collection(spark):
    rng = random.Random(6)
    parts = [" ".join(str(rng.random()) for _ in range(400)) for _ in range(4)]
    docs = spark.createDataFrame([(1, parts[0]), (2, parts[3]), (3, parts[1] + " " + parts[3]), (4, ""), (5, None)], "doc_id long, text string")
    held = spark.createDataFrame([(1, " ".join(parts[:3])), (2, parts[0])], "doc_id long, text string")
    prints = doc_sketches.fingerprints(docs)
    got = {r.doc_id: r.contained for r in doc_sketches.contained_in(prints, doc_sketches.fingerprints(held)).collect()}
    assert got[1] == 1 and got[2] == 0 and 0.4 < got[3] < 0.6 and got[4] is None and got[5] is None
    assert all(not r.contained for r in doc_sketches.contained_in(prints, prints.where("1 = 0")).collect())


def edits(rows, order):
    """``rows`` in ``order``: id, number of code points, digest of the edited text and both likenesses."""
    made = []
    for at in range(len(order)):
        number, text = order[at][0], order[at][1] or ""
        following = order[(at + 1) % len(order)][1] or ""
        cut = len(text) // 3
        changed = text[: len(text) - cut] + following[:cut]
        own, other, after = (doc_sketches.sketch(t) for t in (text, changed, following))
        near = doc_sketches.likeness(own, other), doc_sketches.likeness(own, after)
        made.append((number, len(text), hashlib.sha256(changed.encode()).hexdigest(), doc_sketches.packed(own), doc_sketches.packed(other), *near))
    return Counter(made)


@pytest.mark.parametrize("range_bytes", [1, 3000, 1 << 25])
def test_edits(docs, rows, range_bytes):
    known = [r for r in rows if r[0] not in (None, 13)] + [next(r for r in rows if r[0] == 13)] * 3
    order = sorted(known, key=lambda r: -r[0])
    got = doc_sketches.compare_with_edits(docs.where("doc_id is not null"), range_bytes=range_bytes).drop("in_edited", "in_next").collect()
    assert Counter(map(tuple, got)) == edits(rows, order)
    everything = doc_sketches.compare_with_edits(docs, range_bytes=range_bytes).collect()
    assert len(everything) == len(rows) and sum(r.doc_id is None for r in everything) == 2


def test_edits_of_few_documents(spark, no_docs):
    assert doc_sketches.compare_with_edits(no_docs).collect() == []
    (row,) = doc_sketches.compare_with_edits(spark.createDataFrame([(1, "abc def ghi")], "doc_id long, text string")).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abc def abc").hexdigest() and row.near_next == 1
