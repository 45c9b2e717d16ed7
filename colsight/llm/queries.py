"""The queries of this package over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colsight.llm import (
    chat_format,
    doc_sketches,
    exact_dedup,
    lexical_search,
    line_dedup,
    lm_scoring,
    mixing,
    packing,
    quality_classifier,
    quality_rules,
    sharding,
    simhash_dedup,
    vector_codes,
    word_scoring,
)
from colsight.llm.shared import LOWER, UPPER, stored

_LOWER_TEXT = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_components(table(spark, sf_dir, "documents"))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long")
    planned = table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), crc.alias("text_crc32"))
    sharded = sharding.shuffle_shards(planned, 24, ["doc_id", "size", "text_crc32"])
    no_shard = F.lit(None).cast("int").alias("grown_shard")
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", no_shard)


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = lm_scoring.with_target_labels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rows = marked.select("row.doc_id", "row.text", "in_target")
    return word_scoring.score_by_words(rows, F.col("in_target"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    keys = stored(chat_format.branched_keys(conversations))
    texts = conversations.select(chat_format.text_key(F.col("text")).alias("text_key"), "text")
    return chat_format.format_keys(keys, texts).withColumnRenamed("pair", "conv_id")


OP4_SQL = r"""
WITH c AS (SELECT conv_id, max(coalesce(turn, -1)) AS last, ('0x' || md5(conv_id::VARCHAR)[1:8])::BIGINT AS h FROM conversations GROUP BY conv_id),
n AS (
  SELECT conv_id, CASE WHEN h % 8 > 0 THEN (h // 8) % (last + 2) END AS branch,
    coalesce(lead(conv_id) OVER (ORDER BY conv_id), first_value(conv_id) OVER (ORDER BY conv_id)) AS next
  FROM c),
s AS (
  SELECT conv_id, 'chosen' AS side, turn, role, text FROM conversations UNION ALL
  SELECT conv_id, 'rejected', turn, role, text FROM conversations JOIN n USING (conv_id) WHERE coalesce(turn, -1) < branch UNION ALL
  SELECT n.conv_id, 'rejected', o.turn, o.role, o.text FROM n JOIN conversations o ON o.conv_id = n.next WHERE coalesce(o.turn, -1) >= branch),
p AS (
  SELECT *, row_number() OVER side - 1 AS position, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered
  FROM s WINDOW side AS (PARTITION BY conv_id, side ORDER BY turn, role, substr(text, 1, 32), sha256(text))),
b AS (
  SELECT coalesce(a.conv_id, o.conv_id) AS conv_id, coalesce(a.position, o.position) AS position,
    a.role IS NOT DISTINCT FROM o.role AND a.text IS NOT DISTINCT FROM o.text AND a.side IS NOT NULL AND o.side IS NOT NULL AS alike
  FROM (SELECT * FROM p WHERE side = 'chosen') a FULL JOIN (SELECT * FROM p WHERE side = 'rejected') o ON a.conv_id = o.conv_id AND a.position = o.position),
d AS (SELECT conv_id, coalesce(min(position) FILTER (NOT alike), max(position) + 1) AS prefix FROM b GROUP BY conv_id),
q AS (
  SELECT p.*, CASE WHEN position < prefix THEN 'prompt' ELSE side END AS part
  FROM p JOIN d USING (conv_id) WHERE side = 'chosen' OR position >= prefix)
SELECT conv_id, part, position, role, rendered,
  coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, part ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length('<|' || role || '|>') + 1 ELSE 0 END AS loss_start,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(rendered) - length('<|' || role || '|>') - 1 ELSE 0 END AS loss_length
FROM q
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = mixing.word_count(F.col("text"))
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", "text", size.alias("words"))
    narrow = sized.select("doc_id", "source", "words", mixing.symbol_quality(F.col("text"), F.col("words")).alias("quality"))
    mixed = mixing.mix(narrow, F.col("words"), F.col("quality"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS origin, len({_WORDS}) AS size,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS symbols
  FROM documents),
k AS (
  SELECT *, round(-ln((('0x' || md5('42:' || coalesce(doc_id::VARCHAR, ''))[1:13])::BIGINT + 0.5) / 4503599627370496.0)
    / (1.0 / (1.0 + 10.0 * symbols / greatest(size, 1))), 12) AS key FROM d),
s AS (SELECT origin, sum(size)::BIGINT AS source_size FROM d GROUP BY origin),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY origin) - 1) % 3 + 1] AS weight FROM s),
t AS (
  SELECT *, 2.0 * source_size AS stop,
    (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER early, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER early, 0)) AS level
  FROM w WINDOW early AS (ORDER BY 2.0 * source_size / weight, origin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT level FROM t WHERE level * weight <= stop ORDER BY stop / weight, origin LIMIT 1),
a AS (SELECT origin, source_size, round(coalesce(least((SELECT level FROM h) * weight, stop), stop), 6) AS target FROM t),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM a),
p AS (
  SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY origin ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e USING (origin)),
f AS (SELECT *, before + size <= rest AS fits FROM p),
l AS (SELECT origin, any_value(rest) - coalesce(sum(size) FILTER (fits), 0) AS remain FROM f GROUP BY origin),
c AS (
  SELECT origin, doc_id FROM f JOIN l USING (origin) WHERE NOT fits AND abs(size - remain) < remain
  QUALIFY row_number() OVER (PARTITION BY origin ORDER BY abs(size - remain), key, doc_id) = 1)
SELECT f.doc_id, size::BIGINT AS size, source_size, target,
  (size * (epochs + (fits OR c.doc_id IS NOT NULL)::INT))::BIGINT AS taken
FROM f LEFT JOIN c ON f.origin = c.origin AND f.doc_id = c.doc_id
"""


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), ["doc_id"])
    return packed.select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", sha256(F.col("text")).alias("kept_sha256"))


OP8_SQL = rf"""
WITH l AS (
  SELECT row, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM (SELECT row_number() OVER () AS row, * FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY row, doc_id
"""


def op9_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, sf_dir, "documents"))


OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_LOWER_TEXT} AS text FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(text) AS text_sha256
FROM d WINDOW same AS (PARTITION BY text)
"""


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    counts = [f"measures.{name}" for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    failed = F.arrays_overlap("broken", F.array(*map(F.lit, quality_rules.BASE)))
    return judged.select("doc_id", *counts, failed.alias("base_failed"), "kept")


def _rule_sql(rule: quality_rules.Rule) -> str:
    bottom = rule.denominator or "1"
    sides = [f"{rule.numerator} >= {rule.low}::DOUBLE * {bottom}"] * (rule.low is not None)
    sides += [f"{rule.numerator} <= {rule.high}::DOUBLE * {bottom}"] * (rule.high is not None)
    return " AND ".join(sides)


OP10_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
n AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN {quality_rules.STOP_WORDS})) AS n_stop_words
  FROM d LEFT JOIN n USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {" AND ".join(f"({_rule_sql(r)})" for r in quality_rules.RULES)} AS kept
FROM m
"""


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    books = vector_codes.fit_codebooks(vectors, "vec_id", "embedding")
    coded = stored(vector_codes.compress(vectors, books, "embedding").select("vec_id", "label", "code", "error"))
    summed = vector_codes.with_group_errors(coded, "label")
    return summed.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.codebooks_digest(books)).alias("codebooks_sha256"))


def _rounds_sql() -> str:
    """Assignments ``a0, a1 ...`` to the codebooks ``b0, b1 ...`` that each round makes of the one before."""
    rounds = []
    for r in range(vector_codes.ROUNDS + 1):
        rounds.append(f"""
a{r} AS MATERIALIZED (
  SELECT id, label, part, x, min(d * {vector_codes.ENTRIES} + entry) AS best FROM (
    SELECT p.*, entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))::BIGINT AS d
    FROM p JOIN b{r} b USING (part))
  GROUP BY id, label, part, x)""")
        rounds.append(f"""
s{r} AS (
  SELECT part, best % {vector_codes.ENTRIES} AS entry, i, sum(x[i])::BIGINT AS total, count(*) AS n
  FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS i) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN (
    SELECT part, entry, list((total - (total % n + n) % n) // n ORDER BY i) AS x FROM s{r} GROUP BY part, entry) m USING (part, entry))""")
    return ",".join(rounds[:-1])


OP11_SQL = f"""
WITH v AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS id, list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) AS z
  FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
p AS MATERIALIZED (
  SELECT id, label, part, z[part * w + 1 : part * w + w] AS x
  FROM v, (SELECT unnest(range({vector_codes.PARTS})) AS part), (SELECT max(len(z)) // {vector_codes.PARTS} AS w FROM v)),
b0 AS MATERIALIZED (SELECT part, id - 1 AS entry, x FROM p WHERE id <= {vector_codes.ENTRIES}),{_rounds_sql()},
c AS (
  SELECT id, string_agg(lower(printf('%02x', best % {vector_codes.ENTRIES})), '' ORDER BY part) AS code, sum(best // {vector_codes.ENTRIES})::BIGINT AS error
  FROM a{vector_codes.ROUNDS} GROUP BY id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b{vector_codes.ROUNDS}) AS codebooks_sha256
FROM v JOIN c USING (id)
"""


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
WITH q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
s AS (SELECT count(*)::BIGINT AS big_n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
t AS MATERIALIZED (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term, big_n),
m AS (SELECT row, doc_id, 75 + (25 * len(terms) * big_n) // l AS m FROM d, s),
i AS (SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * m)) AS part FROM t JOIN w USING (term) JOIN m USING (row)),
r AS (SELECT item_id, row, doc_id, sum(times * part)::BIGINT AS score FROM i JOIN q USING (term) GROUP BY ALL HAVING sum(times * part) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
FROM r QUALIFY rank <= {lexical_search.BEST}
"""


def op13_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_sketches.compare_with_edits(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_shards": op2_shards,
    "op3_lm": op3_lm,
    "op4_chat": op4_chat,
    "op5_quality": op5_quality,
    "op6_mix": op6_mix,
    "op7_pack": op7_pack,
    "op8_lines": op8_lines,
    "op9_copies": op9_copies,
    "op10_rules": op10_rules,
    "op11_codes": op11_codes,
    "op12_search": op12_search,
    "op13_sketches": op13_sketches,
}
ORACLE = {
    "op4_chat": OP4_SQL,
    "op6_mix": OP6_SQL,
    "op8_lines": OP8_SQL,
    "op9_copies": OP9_SQL,
    "op10_rules": OP10_SQL,
    "op11_codes": OP11_SQL,
    "op12_search": OP12_SQL,
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
