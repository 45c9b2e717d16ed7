"""Vector codes against plain integer k-means."""

import hashlib
import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from colsight.llm import vector_codes

NAN, INF = float("nan"), float("inf")


def brute(rows, parts, entries, rounds):
    """``rows``: (id, label, vector); the codebooks and one result per kept row, in Python's integers."""
    kept = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    length = max(1, -(-max(len(r[2]) for r in kept) // parts))
    whole = [[math.floor(Fraction(x) * 256) for x in r[2]] + [0] * (parts * length - len(r[2])) for r in kept]
    cut = [[w[p * length : (p + 1) * length] for p in range(parts)] for w in whole]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][2]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def best(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        members = defaultdict(list)
        for c in cut:
            for p in range(parts):
                members[p, best(p, c[p])[1]].append(c[p])
        for (p, k), held in members.items():
            books[p][k] = [sum(x) // len(held) for x in zip(*held, strict=True)]
    found = [[best(p, c[p]) for p in range(parts)] for c in cut]
    return books, [(r[0], r[1], "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for r, f in zip(kept, found, strict=True)]


ROWS = [
    *[(i, i % 3 if i % 5 else None, [math.sin(i * j + j) for j in range(8)]) for i in range(40)],
    *[(100, 1, [0.5] * 8)] * 5,  # repeated rows
    (None, 2, [0.25] * 8),
    (None, 2, [0.125] * 8),
    (200, None, None),
    (201, 1, [0.0, None] * 4),
    (202, 1, [NAN] * 8),
    (203, 1, [INF] + [0.0] * 7),
    (204, 7, []),
    (205, 7, [1.0, -1.0, 0.001]),
    (206, 7, [-0.0, -1e-30] * 4),
]
KIND = "id long, label int, vector array<double>, row string, code int, error string, part int, total int"


def codes(spark, rows, parts=4, entries=8, rounds=2):
    df = spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], KIND).repartition(3)
    books = vector_codes.fit_codebooks(df, "id", "vector", parts, entries, rounds)
    return df, books, vector_codes.compress(df, books, "vector")


@pytest.mark.parametrize("rows", [ROWS, ROWS[:5], [(i, 0, [1e15 * i, -3e18, 1e-5, 7.0] * 3) for i in range(6)]])
def test_codes(spark, rows):
    df, books, coded = codes(spark, rows)
    want_books, want = brute(rows, 4, 8, 2)
    assert [b.tolist() for b in books] == want_books
    assert coded.columns == [c for c in df.columns if c not in ("code", "error")] + ["code", "error"]
    key = lambda r: tuple(map(str, r))
    got = [(r.id, r.label, r.code, r.error) for r in coded.collect()]
    assert sorted(got, key=key) == sorted([(*r[:3], r[3] if r[3] < 1 << 63 else None) for r in want], key=key)
    text = ",".join(str(x) for book in want_books for entry in book for x in entry)
    assert vector_codes.codebooks_digest(books) == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_errors_of_a_label(spark, small):
    coded = codes(spark, ROWS)[2]
    total = defaultdict(int)
    for r in coded.collect():
        total[r.label] += r.error
    summed = vector_codes.with_group_errors(coded, "label", small).collect()
    assert len(summed) == coded.count() and all(r.label_error == total[r.label] for r in summed)


def test_nothing_to_code(spark):
    for rows in ([], [(1, 1, None), (2, 1, [NAN])]):
        _, books, coded = codes(spark, rows)
        assert books == [] and coded.collect() == []
    with pytest.raises(ValueError, match="256"):
        codes(spark, ROWS, entries=257)


vectors = st.lists(st.lists(st.integers(-(1 << 40), 1 << 40) | st.integers(-3, 3), min_size=5, max_size=5), min_size=1, max_size=30)


@given(vectors, vectors)
def test_nearest(parts, entries):
    code, error = vector_codes.nearest(np.array(parts), np.array(entries))
    for row, k, e in zip(parts, code, error, strict=True):
        assert (int(e), int(k)) == min((sum((a - b) ** 2 for a, b in zip(row, entry, strict=True)), at) for at, entry in enumerate(entries))


def test_sequency_order():
    rows = vector_codes.walsh(np.eye(16, dtype=np.int64))
    assert [(np.diff(column) != 0).sum() for column in rows.T] == list(range(16))
    assert (rows @ rows.T == 16 * np.eye(16)).all()
