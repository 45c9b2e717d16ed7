"""Reading answers, sensitivity verdicts, text context and the run history."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from colsight.functions import text
from colsight.functions.rows import constant_rows
from colsight.operators import answers, history, prompts, sensitivity


def parsed(spark, response):
    responses = spark.createDataFrame([("t", 0, response)], "table_name string, batch int, response string")
    columns = constant_rows(spark, [("t", 0, "a"), ("t", 0, "b")], "table_name string, batch int, column_name string")
    return {r.column_name: (r.is_sensitive, r.sensitivity_type) for r in sensitivity.parse_responses(responses, columns).collect()}


NOTHING = {"a": (False, None), "b": (False, None)}


def test_sensitivity_answers(spark):
    entry = '{"column_name": "a", "is_sensitive": %s, "sensitivity_type": %s}'
    whole = '{"columns": [%s]}'
    assert parsed(spark, whole % (entry % ("true", '"email"'))) == NOTHING | {"a": (True, "email")}
    assert parsed(spark, whole % (entry % ('"TRUE"', '"who knows"'))) == NOTHING | {"a": (True, "other_unique_id")}
    assert parsed(spark, whole % (entry % ("true", "null"))) == NOTHING | {"a": (True, "other_unique_id")}
    assert parsed(spark, whole % (entry % ("1", '"email"'))) == NOTHING
    assert parsed(spark, "```json\n" + whole % (entry % ("true", '"ssn"')) + "\n```") == NOTHING | {"a": (True, "ssn")}
    assert parsed(spark, whole % ('"odd", 5, {"column_name": "ghost", "is_sensitive": true}, ' + entry % ("true", '"ssn"'))) == NOTHING | {"a": (True, "ssn")}
    for broken in ("", "no json", '{"columns": "x"}', "[1]", '{"other": 1}', None):
        assert parsed(spark, broken) == NOTHING


def test_levels_cover_all_types(spark):
    assert len(sensitivity.TYPES) == len(set(sensitivity.TYPES)) == 45
    assert [len(codes) for codes in sensitivity.LEVELS.values()] == [11, 22, 10, 2]
    df = constant_rows(spark, [("gender",), ("customer_id",), ("ssn",), ("nothing",), (None,)], "c string")
    assert [r.l for r in df.select(sensitivity.level_of(F.col("c")).alias("l")).collect()] == ["medium", "low", "critical", None, None]


def test_failing_model_calls_keep_the_defaults(spark):
    questions = constant_rows(spark, [("t", 0, "p")], "table_name string, batch int, prompt string")

    def fail(prompts: pd.Series) -> pd.Series:
        raise RuntimeError("no connection")

    assert sensitivity.ask(questions, fail).first().response is None
    assert sensitivity.ask(questions, lambda p: p.str.upper()).first().response == "P"


def test_names_suggest_types(spark):
    names = {"user_email": "email", "SSN": "ssn", "home_phone": "phone_number", "street_address": "address", "user_name": "name", "amount": None}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.t for r in df.select("n", sensitivity.type_from_name(F.col("n")).alias("t")).collect()} == names


def test_value_evidence_by_brute_force(spark):
    import re

    texts = ["write to a.b@example.com", "123-45-6789", "call 555-123-4567 now", "10.0.0.1", "nothing", None, "4111 1111 1111 1111"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    row = sensitivity.value_evidence({"t": df}).first()
    present = [t for t in texts if t is not None]
    for kind, pattern in sensitivity.EVIDENCE.items():
        assert row[f"{kind}_share"] == sum(bool(re.search(pattern, t)) for t in present) / len(present)


def test_extract_json(spark):
    cases = {"  {} \n": "{}", 'x\n```json\n{"a": 1}\n```\ny': '{"a": 1}', "```\n[]\n```": "[]", "```json {}```": "```json {}```"}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r.c: r.j for r in df.select("c", text.extract_json(F.col("c")).alias("j")).collect()} == cases


def test_glossary_is_all_or_nothing(spark):
    term = '{"business_term": "A", "description": "d"}'
    cases = {
        '{"terms": [%s]}' % ", ".join([term] * 7): 5, '{"terms": [%s, {"business_term": "B"}]}' % term: 0,
        '{"terms": [{"business_term": 5, "description": "d"}]}': 0, "junk": 0, "{}": 0,
    }
    df = spark.createDataFrame([(c,) for c in cases], "response string")
    assert {r.response: len(r.terms) for r in answers.glossaries(df).collect()} == cases


def test_judgment_defaults(spark):
    response = '{"columns": [{"column_name": "a"}, {"column_name": "b", "llm_confidence": "0.9", "agrees_with_heuristic": false}]}'
    df = spark.createDataFrame([("t", response), ("u", '{"columns": [{"llm_confidence": "high"}]}')], "table_name string, response string")
    rows = answers.judgments(df).orderBy("place").collect()
    assert [(r.column_name, r.llm_confidence, r.llm_filter_type, r.agrees_with_heuristic) for r in rows] == [
        ("a", 0.5, "categorical", True), ("b", 0.9, "categorical", False),
    ]


def test_wrong_types_spoil_an_answer(spark):
    texts = ['{"terms": [{"business_term": "a", "description": "b", "synonyms": "x"}]}', '{"terms": [{"business_term": "a", "description": "b"}]}']
    frame = spark.createDataFrame([(t,) for t in texts], "response string")
    assert [len(r.terms) for r in answers.glossaries(frame).collect()] == [0, 1]
    texts = ['{"domains": [{"domain": "d", "tables": ["t"]}, "odd"]}', '{"domains": [{"domain": "e", "tables": ["t"]}]}']
    frame = spark.createDataFrame([(t,) for t in texts], "response string")
    assert [r.domain for r in answers.domains(frame).collect()] == ["e"]
    texts = ['{"kpis": [{"name": "a", "description": "b", "linked_columns": 3}]}', '{"kpis": [{"name": "c", "description": "b", "linked_columns": ["t.c"]}]}']
    frame = spark.createDataFrame([(t,) for t in texts], "response string")
    assert [r["name"] for r in answers.kpis(frame, 5).collect()] == ["c"]


def test_repeated_domain_keeps_its_last_list(spark):
    response = '{"domains": [{"domain": "A", "tables": ["x"]}, {"domain": "B", "tables": ["y", "z"]}, {"domain": "A ", "tables": ["w"]}, {"domain": " ", "tables": ["v"]}]}'
    df = spark.createDataFrame([(response,)], "response string")
    rows = answers.domains(df).orderBy("domain_place", "place").collect()
    assert [(r.domain, r.table_name) for r in rows] == [("A", "w"), ("B", "y"), ("B", "z")]


def test_column_line(spark):
    df = spark.createDataFrame(
        [("id", "int", True, False, None, ["1", None, "2", "3"], None), ("s", "text", False, True, list("abcdefg"), [None], "about")],
        "column_name string, data_type string, is_primary_key boolean, is_nullable boolean, enum_values array<string>,"
        "sample_values array<string>, description string",
    )
    lines = [r.line for r in df.select(prompts.column_line().alias("line")).collect()]
    assert lines == ["  - id (int) [PK] [NOT NULL] samples: [1, 2]", "  - s (text) enum: [a, b, c, d, e, f] pg_desc: about"]


def test_update_keeps_fields_that_are_not_given(spark):
    runs = constant_rows(spark, [(1, "pending", "x"), (2, "failed", "y")], "id int, status string, note string")
    changes = constant_rows(spark, [(1, "completed", None), (9, "failed", None)], "id int, status string, note string")
    assert {tuple(r) for r in history.update(runs, changes, "id").collect()} == {(1, "completed", "x"), (2, "failed", "y")}
    assert history.updated_count(runs, changes, "id").first()[0] == 1
    assert history.existing(changes.select("id"), runs, "id").where("present").count() == 1


def test_update_has_one_winner_for_each_key(spark):
    runs = spark.createDataFrame([("a", "old", 1), ("b", "old", 2)], "id string, status string, n int")
    changes = spark.createDataFrame([("a", "first", None, 1), ("a", "second", 5, 2), ("a", None, None, 3)], "id string, status string, n int, at int")
    assert sorted(tuple(r) for r in history.update(runs, changes, "id", "at").collect()) == [("a", "second", 5), ("b", "old", 2)]
    assert history.update(runs, changes.drop("at"), "id").count() == 2


def test_long_words_are_searched_once(spark):
    frame = spark.createDataFrame([("x" * 500_000,), ("a@b.com",)], "s string")
    row = sensitivity.value_evidence({"t": frame}).first()
    assert row.email_share == 0.5
    assert sensitivity.value_evidence({"t": spark.range(3)}).collect() == []


def test_interrupted_runs(spark):
    runs = constant_rows(
        spark,
        [(1, "pending", None, None, None), (2, "completed", None, None, None), (3, "detecting_filters", None, None, None)],
        "id int, status string, error_code string, error_message string, completed_at timestamp_ntz",
    )
    now = F.expr("timestamp_ntz '2024-01-01 00:00:00'")
    rows = {r.id: r for r in history.mark_interrupted(runs, now).collect()}
    assert (rows[1].status, rows[1].error_code, rows[1].completed_at) == ("failed", "SERVER_RESTART", dt.datetime(2024, 1, 1))
    assert (rows[2].status, rows[3].status, rows[2].error_code) == ("completed", "detecting_filters", None)
    assert history.mark_interrupted(runs, now, with_detecting=True).where("id = 3").first().status == "failed"
    assert history.running_count(runs, with_detecting=True).first()[0] == 1


def test_usage_needs_cost_estimate_or_latency(spark):
    calls = constant_rows(
        spark,
        [("a", 1, 2, 0.1, 0.2, 0.3, 0, 0, 0, 0, 0.0), ("b", 5, 5, 0.0, 0.0, 0.0, 0, 0, 0, 0, 0.0)],
        "run string, input_tokens int, output_tokens int, input_cost double, output_cost double, total_cost double,"
        "estimated_text_tokens int, estimated_overhead_tokens int, estimated_total_tokens int, estimated_message_count int, latency_ms double",
    )
    assert [(r.run, r.input_tokens, r.total_cost) for r in answers.usage(calls, "run").collect()] == [("a", 1, 0.3)]
