"""Each stage on what the one before it kept, against brute force."""

from collections import Counter

import corpus_pipeline

from colsight.llm.packing import public_encoder

SF_DIR = "/root/testdata/sf0.001"


def likeness(a, b):
    """The cosine of the sets of five-word shingles."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.encode().lower().split() for t in (a, b))]
    return len(sets[0] & sets[1]) / (len(sets[0]) * len(sets[1])) ** 0.5


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, held = docs.columns, docs.collect()
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        before, docs = held, spark.read.parquet(str(tmp_path / name))
        held = docs.collect()
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and set(held) <= set(before)
        if name == "quality_rules":
            assert all(len(r.text.encode().split()) >= 50 for r in held) and len(held) > 0.7 * len(before)
        if name == "exact_dedup":
            low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
            assert sorted(r.doc_id for r in held) == sorted({low(r.text): r.doc_id for r in sorted(before, key=lambda r: r.doc_id)}.values())
        if name == "near_dedup":
            stays = {r.doc_id for r in held}
            assert all(likeness(a.text, b.text) < 0.8 for i, a in enumerate(held) for b in held[:i])
            assert all(any(likeness(r.text, k.text) >= 0.8 for k in before if k.doc_id != r.doc_id) for r in before if r.doc_id not in stays)
        if name == "mixing":
            assert max(Counter(r.doc_id for r in held).values()) <= 2
        if name == "packing":
            encode, copies = public_encoder(), Counter(r.doc_id for r in before)
            total = {r.doc_id: (len(encode(r.text)) + 1) * copies[r.doc_id] for r in before}
            got = Counter()
            for r in held:
                got[r.doc_id] += r.length
            assert got == total


def test_run(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).collect() == []


def test_nulls(spark):
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "word " * 60, None, None, 300), (None, "the end of it " * 3 + "x" * 100_000, "en", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).collect() is not None
