import random

import pytest

SCHEMA = (
    "doc_id long, text string, source string, row string, item int, doc int, key int, chunk int, place int, size int, "
    "kept int, box int, name int, shard int, slot int, number int, before int, position int, origin int, sha int, body int"
)
CLASHING = SCHEMA.count(",") - 2


def sentence(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


BASE = sentence(1, 200)
TEXTS = [
    (1, BASE, "a"),
    (2, BASE.upper(), "a"),
    (3, BASE, None),
    (4, None, "b"),
    (5, "", "b"),
    (6, " \n\t \x0b", "b"),
    (7, "one two", "c"),
    (8, "One  Two", "c"),
    (9, "the end\nthe end\n\nthe end", "c"),
    (None, BASE, "a"),
    (None, None, None),
    (10, sentence(2, 60_000), "a"),
    (11, "ÀÉ ß 漢字 😀 the" * 30, "d"),
    (12, BASE.replace(" ", "  ", 3) + " tail", "d"),
    (13, sentence(3, 120), "a"),
    (13, sentence(3, 120), "a"),
    (13, sentence(3, 120), "a"),
    (14, "x" * 512, "a"),
    (15, "x" * 511, "a"),
    (16, "x" * 1024, "a"),
    (17, "x" * 1536, "a"),
    (18, "X" * 1536, "a"),
]


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    return TEXTS


@pytest.fixture(scope="session")
def docs(spark):
    """The rows with columns that clash with names the operators use inside."""
    return spark.createDataFrame([(*row, *["x"], *[7] * (CLASHING - 1)) for row in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("1 = 0")
