"""Quality rules, line dedup, classifier and LM scores against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colsight.llm import line_dedup, lm_scoring, quality_classifier, quality_rules, queries, word_scoring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, no_docs, rows):
    judged = quality_rules.judge(docs)
    assert set(docs.columns) <= set(judged.columns)
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = judged.select("text", "kept", "broken", *[f"measures.{f}" for f in fields]).collect()
    assert sorted(tuple(r)[3:] for r in got) == sorted(counts(text) for _, text, _ in rows)
    for r in got:
        n, chars, symbols, _, repeated = counts(r.text)
        assert ("n_words" in r.broken) == (n < 50) and ("repeated_words" in r.broken) == (2 * repeated > n)
        assert ("symbols_per_word" in r.broken) == (symbols > 0.1 * n) and r.kept == (not r.broken)
    assert quality_rules.judge(no_docs).collect() == []


def test_repeated_windows(spark):
    texts = ["a b c a b c", "a a a a", "a b c d a b c", "a b", "", "x a b c y a b c a b c z", "a b a b a b a"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select("text", quality_rules.measures(F.col("text")).alias("m"))
    assert {r.text: r.m.n_repeat_words for r in frame.collect()} == {t: counts(t)[4] for t in texts}


def test_size_alone_breaks_no_rule(spark):
    """Counts of clean texts of fifty words and of a billion."""
    counts_of = "n AS n_words, 5 * n AS word_chars, 0L AS n_repeat_words, n / 4 AS n_stop_words, n / 100 AS n_symbols, n / 10 AS n_lines, 0L AS n_dup_lines"
    frame = spark.range(1).selectExpr("explode(array(50L, 1000000L, 1000001L, 1000000000L)) AS n").selectExpr(f"struct({counts_of}) AS counts")
    failed = frame.select(*[quality_rules.broken(rule, F.col("counts")).alias(rule.name) for rule in quality_rules.RULES]).collect()
    assert len(failed) == 4 and not any(any(r) for r in failed)


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))


def test_line_dedup(spark, docs, no_docs):
    rows = [(i, f"  Shared LINE \nown {i}\n\nshared line\nrare{i // 3}", 1) for i in range(9)] + [(20, None, 1), (21, "", 1), (22, "Shared line", 1), (22, "Shared line", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    for least in (3, 10, 12):
        found = Counter(k for _, text, _ in rows for k in {key(x) for x in (text or "").split("\n")} if k)
        want = []
        for number, text, _ in rows:
            lines = (text or "").split("\n")
            kept = [x for x in lines if found[key(x)] < least]
            want.append((number, "\n".join(kept), len(lines), len(lines) - len(kept)))
        got = line_dedup.drop_common_lines(frame, least_documents=least)
        assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == sorted(want)
    assert line_dedup.drop_common_lines(docs).count() == docs.count()
    assert line_dedup.drop_common_lines(no_docs).collect() == []


def test_classifier(spark, docs, no_docs):
    """Held-out accuracy on the labelled table, defined results on odd rows."""
    sf = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier.classify(documents, labels)
    held = got.join(labels, "doc_id").where("held_out").toPandas()
    assert (held.predicted == held.quality).mean() > 0.9
    again = quality_classifier.classify(docs, labels).collect()
    assert len(again) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in again)
    assert len({r.score for r in again if r.doc_id == 13}) == 1
    assert quality_classifier.classify(no_docs, labels).collect() == []
    assert {r.score for r in quality_classifier.classify(docs, labels.where("1 = 0")).collect()} == {0.5}


def test_classifier_against_numpy(spark):
    """The same features, ridge system and calibration over collected rows, solved as least squares and by the min-max formula."""
    q = quality_classifier
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    x = {r.id: np.array(r.x) for r in q.measured(documents).collect()}
    rows = [(x[r.doc_id], float(r.quality), zlib.crc32(str(r.doc_id).encode()) % q.FOLDS) for r in labels.collect() if r.quality is not None]
    fitting = [(v, y) for v, y, f in rows if f not in (q.HELD_OUT, q.CALIBRATION)]
    a, y = np.array([v for v, _ in fitting]), np.array([y for _, y in fitting])
    mean, deviation = a.mean(axis=0), a.std(axis=0)
    scale = np.where(deviation > 1e-9, deviation, 1.0)
    rng = np.random.default_rng(q.SEED)
    waves, phases = rng.normal(0, 1 / q.WIDTH, (a.shape[1], q.FEATURES)), rng.uniform(0, 2 * np.pi, q.FEATURES)

    def features(v):
        turned = np.cos(np.clip((v - mean) / scale, -8, 8) @ waves + phases) * np.sqrt(2 / q.FEATURES)
        return np.concatenate([turned, np.ones((len(v), 1))], axis=1)

    z = features(a)
    weights = np.linalg.lstsq(np.vstack([z, np.sqrt(q.RIDGE) * np.eye(z.shape[1])]), np.concatenate([y, np.zeros(z.shape[1])]), rcond=None)[0]

    def raw(v):
        return np.clip(np.round(features(v) @ weights, 4), -1, 2)

    held = [(v, y) for v, y, f in rows if f == q.CALIBRATION]
    at, inverse = np.unique(raw(np.array([v for v, _ in held])), return_inverse=True)
    n, hits = np.bincount(inverse), np.bincount(inverse, weights=[y for _, y in held])
    total = lambda s, i, j: s[i : j + 1].sum()
    level = [max(min(total(hits, i, j) / total(n, i, j) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]
    blocks = [np.flatnonzero(np.isclose(level, value)) for value in np.unique(np.round(level, 12))]
    centres, heights = [(at[b] * n[b]).sum() / n[b].sum() for b in blocks], [level[b[0]] for b in blocks]
    got = {r.doc_id: r.score for r in q.classify(documents, labels).collect()}
    ids = sorted(got)
    want = np.interp(raw(np.array([x[i] for i in ids])), centres, heights)
    near = np.abs(want - [got[i] for i in ids]) < 1e-3  # a raw score on the edge of its fourth decimal may round the other way
    assert near.mean() > 0.99


def test_classifier_never_learns_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality_classifier.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [{r.doc_id: r.score for r in quality_classifier.classify(documents, part).collect()} for part in (labels, turned)]
    assert np.allclose([scores[0][k] for k in scores[0]], [scores[1][k] for k in scores[0]], atol=1e-6)


def test_isotonic():
    raw, probability = quality_classifier.pool_adjacent(np.array([0.0, 1, 2, 3]), np.array([1.0, 0, 1, 2]), np.array([2.0, 2, 2, 2]))
    assert list(probability) == [0.25, 0.5, 1.0] and list(raw) == [0.5, 2.0, 3.0]
    assert len(quality_classifier.pool_adjacent(np.zeros(0), np.zeros(0), np.zeros(0))[0]) == 0


def test_lm_scores(spark, docs, no_docs):
    counts_of = [Counter(), Counter()]
    texts = [(1, "the cat sat", True), (2, "The cat ran", True), (3, "zq zq zq", False), (4, None, False), (5, "", False), (5, "é", False)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, target boolean").repartition(3)
    n = lm_scoring.SYMBOLS
    for _, text, target in texts:
        for code in lm_scoring.trigrams(text):
            counts_of[0][int(code)] += target
            counts_of[1][int(code)] += 1

    def bits(c, code, prior=lm_scoring.PRIOR):
        a, b, s = code // n // n, code // n % n, code % n
        total = sum(c.values())
        one = lambda s: (sum(v for k, v in c.items() if k % n == s) + 1) / (total + n)
        two = lambda b, s: (sum(v for k, v in c.items() if k // 1 % (n * n) == b * n + s) + prior * one(s)) / (sum(v for k, v in c.items() if k // n % n == b) + prior)
        context = sum(v for k, v in c.items() if k // n == a * n + b)
        return -np.log2((c[code] + prior * two(b, s)) / (context + prior))

    got = {(r.doc_id, r.n_tokens): r for r in lm_scoring.score_documents(frame, F.col("target")).collect()}
    for number, text, _ in texts:
        codes = [int(c) for c in lm_scoring.trigrams(text)]
        near, far = (np.mean([bits(c, code) for code in codes]) for c in counts_of)
        r = got[number, len(codes)]
        assert np.allclose([r.target_loss, r.background_loss, r.score], [near, far, near - far], atol=1e-4)
    assert got[1, 12].score < got[3, 9].score
    odd = lm_scoring.score_documents(docs, F.col("source") == "a").collect()
    assert len(odd) == docs.count() and all(np.isfinite(r.score) for r in odd)
    assert lm_scoring.score_documents(no_docs, F.lit(True)).collect() == []


def test_word_scores(spark, docs, no_docs):
    """Against brute force, with one chunk, some, and many."""
    texts = [(1, "the cat sat on the mat", True), (2, "The cat ran", True), (3, "der über Öl", False), (4, None, False), (5, "", False), (5, "der ober Il", None), (None, "the " * 50, False)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, target boolean").repartition(3)
    split = lambda text: ["", *[w.lower() for w in (text or "").split()], ""]
    pairs = {text: list(zip(split(text), split(text)[1:])) for _, text, _ in texts}
    seen = [Counter(p for _, text, target in texts if target or every for p in pairs[text]) for every in (False, True)]
    vocabulary = len({after for _, after in seen[1]})

    def bits(c, before, after, prior=word_scoring.PRIOR):
        alone = (sum(v for p, v in c.items() if p[1] == after) + 1) / (sum(c.values()) + vocabulary)
        return -np.log2((c[before, after] + prior * alone) / (sum(v for p, v in c.items() if p[0] == before) + prior))

    want = sorted((str(n), len(pairs[t]), *(np.mean([bits(c, *p) for p in pairs[t]]) for c in seen)) for n, t, _ in texts)
    for chunk_bytes in (None, 100, 5):
        scored = word_scoring.score_by_words(frame, F.col("target"), chunk_bytes=chunk_bytes).collect()
        got = sorted((str(r.doc_id), r.n_tokens, r.target_loss, r.background_loss) for r in scored)
        assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2:] for r in got], [r[2:] for r in want])
    odd = word_scoring.score_by_words(docs, F.col("source") == "a").collect()
    assert len(odd) == docs.count() and all(np.isfinite(r.score) for r in odd)
    assert len({round(r.target_loss, 9) for r in word_scoring.score_by_words(frame, F.lit(False)).collect()}) == 1
    assert word_scoring.score_by_words(no_docs, F.lit(True)).collect() == []


@given(st.lists(st.integers(0, 2**64 - 1), max_size=20))
def test_packed_numbers(values):
    assert word_scoring.unpacked(word_scoring.packed(np.array(values, np.uint64))).tolist() == values


def test_lm_query_tells_words_and_letters_apart(spark, tmp_path):
    """Anagrams of the same letters, and letters beyond ASCII, are different words to the registered query."""
    texts = [(n, "größe über alles" if n % 2 else "gräße ober alles") for n in range(40)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, n % 2) for n in range(20)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    scores = {r.doc_id: (r.n_tokens, r.score) for r in queries.op3_lm(spark, str(tmp_path)).collect()}
    assert all(n == 4 for n, _ in scores.values())
    assert max(s for n, (_, s) in scores.items() if n % 2) < min(s for n, (_, s) in scores.items() if not n % 2)
