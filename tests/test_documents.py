"""Open documents and nested answers: legacy forms, unknown fields, what is malformed; routing of tables of queries."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from skeinlake.functions import routing as Q
from skeinlake.operators import context, health, reports, retrieval
from skeinlake.sources import documents as D


def opened(spark, texts, rules):
    raw = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "n int, doc string")
    fine, bad = D.open_documents(raw, "doc", rules)
    as_json = lambda c: F.to_json(F.transform_values(c, lambda _, v: F.to_json(v)))
    rows = fine.select("n", *[as_json(c).alias(c) if t.startswith("map") else F.col(c) for c, t in fine.dtypes if c != "n"]).collect()
    return {r.n: r.asDict() for r in rows}, sorted(r.n for r in bad.collect())


def loaded(text):
    return {k: json.loads(v) for k, v in json.loads(text).items()}


def test_list_and_map_give_the_same(spark):
    texts = [
        '{"people": {"a": {"id": "a", "x": 1}, "b": {"x": [1, 2]}}, "version": 3, "more": {"deep": [null, true]}}',
        '{"people": [{"id": "a", "x": 1}, {"id": "b"}, {"id": "a", "x": 2}, {"x": "nameless"}, {"id": 7}], "version": "3"}',
        "{}",
        '{"people": null, "version": null}',
        '{"people": "neither"}',
        "[1, 2]",
        "{broken",
        None,
        '"text"',
    ]
    rows, bad = opened(spark, texts, [D.Keyed("people"), D.Typed("version", "int")])
    assert bad == [5, 6, 7, 8]
    assert loaded(rows[0]["people"]) == {"a": {"id": "a", "x": 1}, "b": {"x": [1, 2]}} and rows[0]["version"] == 3
    assert loaded(rows[0]["rest"]) == {"more": {"deep": [None, True]}}
    assert loaded(rows[1]["people"]) == {"a": {"id": "a", "x": 2}, "b": {"id": "b"}, "#3": {"x": "nameless"}, "7": {"id": 7}} and rows[1]["version"] == 3
    assert all(loaded(rows[k]["people"]) == {} for k in (2, 3, 4)) and rows[3]["version"] is None


def test_schema_of_documents(spark):
    raw = spark.createDataFrame([('{"a": 1}',), ('{"a": "x", "b": [1.5]}',), ("bad",)], "doc string")
    assert D.document_schema(raw, "doc").first().schema == "OBJECT<a: VARIANT, b: ARRAY<DECIMAL(2,1)>>"


SCHEMA = "score double, chapter array<struct<_n: int, issue: array<string>>>"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<r><score>7.5</score><chapter n='1'><issue>a</issue><issue>b &lt; c</issue></chapter><chapter n='2'/></r>", (7.5, [(1, ["a", "b < c"]), (2, None)])),
        ("Of course!\n<r>\n <score>1</score>\n</r>\nBye", (1.0, None)),
        ("<r x='1'><unknown>1</unknown><score>2</score></r>", (2.0, None)),
        ("<r><score>1</r>", None),
        ("<root><score>1</score></root>", None),
        ("no answer", None),
        ("", None),
        (None, None),
    ],
)
def test_answers(spark, text, want):
    fine, bad = D.xml_answers(spark.createDataFrame([(1, text)], "id int, text string"), "text", "r", SCHEMA)
    rows = fine.collect()
    if want is None:
        assert rows == [] and [tuple(r) for r in bad.collect()] == [(1, text)]
        return
    answer = rows[0].answer
    chapters = None if answer.chapter is None else [(c._n, c.issue) for c in answer.chapter]
    assert (answer.score, chapters) == want and bad.count() == 0


WORDS = {"relationship": ["relation", "关系"], "scene": ["where"], "entity": ["who"]}
QUERIES = ["relation of 甲乙 and 丙丁, 第3章", "who is 3", "where 9-4章", "where 9~12", "萧炎 与 药老 的关系 12-5", "天地人 天地人 甲乙", "", "plain words", "chapters 7 到 9", "who 00012", "a,b；c,, d ;"]


def test_columns_route_as_the_driver_does(spark):
    df = spark.createDataFrame([(k, q) for k, q in enumerate(QUERIES)], "n int, q string")
    for marker in ("", retrieval.CHAPTER):
        for stop in (frozenset(), frozenset({"甲乙"})):
            routed = Q.route(F.col("q"), WORDS, ("relationship", "entity"), stop, marker)
            got = df.select("n", routed.alias("r"), Q.steps(routed, retrieval.STRATEGIES).alias("s"), Q.split_query(F.col("q")).alias("p")).collect()
            for row in got:
                q = QUERIES[row.n]
                want = retrieval.route(q, WORDS, ("relationship", "entity"), stop, marker or None)
                scope = None if row.r.time_scope is None else tuple(row.r.time_scope)
                assert (row.r.intent, row.r.entities, scope, row.r.needs_graph) == (want["intent"], want["entities"], want["time_scope"], want["needs_graph"]), q
                assert [(s.name, s.strategy) for s in row.s] == [(s["name"], s["strategy"]) for s in retrieval.plan_subqueries(want)]
                assert row.p == retrieval.split_query(q)


def test_columns_agree_with_the_helpers(spark):
    df = spark.range(0, 3000, 37).withColumn("w", F.when(F.col("id") % 5 > 0, F.col("id").cast("double")))
    for r in df.select("id", "w", Q.stage(F.col("id")).alias("s"), Q.archive_due(F.col("id") * 1000, F.col("id")).alias("d"), Q.bar(F.col("w")).alias("b")).collect():
        assert (r.s, r.d, r.b) == (context.stage(r.id), health.archive_due(r.id * 1000, r.id), reports.bar(r.w))
    listed = spark.createDataFrame([("Epic ", w) for w in ("epic", " EPIC ,x", "other", "all", "*", "")], "g string, w string")
    for r in listed.select("g", "w", Q.enabled_for(F.col("g"), F.split("w", ",")).alias("e")).collect():
        assert r.e == reports.enabled_for(r.g, r.w.split(","))
