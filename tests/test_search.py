"""One entry to all searches, routing, rerank failure, scene search with parents, detailed edges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skeinlake.operators import graph, retrieval

VECS = "chunk_id string, embedding array<double>"


@pytest.fixture(scope="module")
def world(spark):
    rows = [("p1", "parent one", None, "summary", 1), ("s1", "red hen runs", "p1", "scene", 1), ("s2", "red hen", "p2", "scene", 2), ("s3", "a cow", "p1", "scene", 3), ("p2", "red parent", None, "summary", 2)]
    docs = spark.createDataFrame(rows, "chunk_id string, content string, parent_chunk_id string, chunk_type string, chapter long")
    vecs = spark.createDataFrame([("s1", [1.0, 0.0]), ("s2", [0.9, 0.1]), ("s3", [0.0, 1.0]), ("p2", [1.0, 0.05])], VECS)
    people = spark.createDataFrame([("h", "hen"), ("c", "cow")], "id string, canonical_name string")
    names = spark.createDataFrame([("Chick", "h", "x")], "alias string, entity_id string, entity_type string")
    edges = spark.createDataFrame([("h", "c", "knows", 1)], "from_entity string, to_entity string, type string, chapter long")
    return docs, vecs, people, names, edges


def ids(df):
    return [r.chunk_id for r in df.collect()]


def test_strategies_and_filters(world):
    docs, vecs, people, names, edges = world
    q = [1.0, 0.0]
    assert ids(retrieval.search(docs, vecs, "red hen", q, 9, "bm25")) == ids(retrieval.bm25(docs, "red hen", 9))
    assert set(ids(retrieval.search(docs, vecs, "red hen", q, 9, "BM25", filters={"to_chapter": "1"}))) == {"s1"}
    assert set(ids(retrieval.search(docs, vecs, "red hen", q, 9, "vector", filters={"to_chapter": 2}))) == {"s1", "s2", "p2"}
    assert set(ids(retrieval.search(docs, vecs, "red hen", q, 9, "hybrid", chapter=1))) == {"s1"}
    odd = retrieval.search(docs, vecs, "red hen", q, 9, "no such").collect()
    assert odd == retrieval.search(docs, vecs, "red hen", q, 9, "hybrid").collect() and len(odd) == 4
    assert retrieval.search(docs, vecs, "red hen", None, 9, "vector").count() == 0
    assert set(ids(retrieval.search(docs, vecs, "red hen", q, 9, filters={"to_chapter": "x"}))) == {"s1", "s2", "s3", "p2"}


def test_auto_takes_the_graph_where_it_is_needed(world):
    docs, vecs, people, names, edges = world
    intent = {"intent": "relationship", "entities": ["Chick"], "time_scope": None, "needs_graph": True}
    got = retrieval.search(docs, vecs, "what of them", [1.0, 0.0], 9, intent=intent, entities=people, aliases=names, edges=edges).collect()
    assert {r.source for r in got} == {"graph_hybrid"} and {r.chunk_id for r in got} >= {"s1", "s2", "s3"}
    off = retrieval.search(docs, vecs, "what of them", [1.0, 0.0], 9, intent=intent, entities=people, aliases=names, edges=edges, graph_enabled=False)
    assert "graph_hybrid" not in {r.source for r in off.collect()}


def test_scenes_with_their_parents(world):
    docs, vecs, *_ = world
    got = retrieval.search(docs, vecs, "red hen", [1.0, 0.0], 2, "backtrack").orderBy("position").collect()
    assert [(r.chunk_id, r.source == "parent") for r in got] in ([("p1", True), ("s1", False), ("p2", True), ("s2", False)], [("p2", True), ("s2", False), ("p1", True), ("s1", False)])
    assert all(r.score == 0 for r in got if r.source == "parent")
    few = retrieval.backtrack(docs, vecs, "red hen", [1.0, 0.0], 2, parents=docs.filter("chunk_id = 'p1'")).collect()
    assert [r.chunk_id for r in few if r.source == "parent"] == ["p1"]


def test_a_reranker_that_fails_leaves_the_fused_order(world):
    docs, vecs, *_ = world
    plain = retrieval.hybrid(docs, vecs, "red hen", [1.0, 0.0], 3).collect()

    def broken(hits):
        raise OSError("no service")

    def breaks_later(hits):
        return hits.select("chunk_id", F.raise_error(F.lit("no service")).cast("double").alias("score"))

    for service in (broken, breaks_later, lambda h: h.select("chunk_id", "rrf").withColumnRenamed("rrf", "score").limit(0)):
        assert retrieval.hybrid(docs, vecs, "red hen", [1.0, 0.0], 3, rerank=service).collect() == plain
    with pytest.raises(ZeroDivisionError):
        retrieval.hybrid(docs, vecs, "red hen", [1.0, 0.0], 3, rerank=lambda h: 1 / 0)


def test_all_vectors_are_compared_unless_asked(spark):
    docs = spark.createDataFrame([(f"d{i:04d}", "word" if i > 5 else "other") for i in range(1200)], "chunk_id string, content string")
    vecs = spark.createDataFrame([(f"d{i:04d}", [1.0, 0.0] if i == 3 else [0.0, 1.0]) for i in range(1200)], VECS)
    assert "d0003" in ids(retrieval.hybrid(docs, vecs, "word", [1.0, 0.0], 30))
    assert "d0003" not in ids(retrieval.hybrid(docs, vecs, "word", [1.0, 0.0], 30, full_scan=None))


def test_steps_of_a_routed_query():
    words = {"relationship": ["关系"], "scene": ["场景"]}
    steps = lambda q, **more: [(s["name"], s["strategy"]) for s in retrieval.plan_subqueries({**retrieval.route(q, words, marker=retrieval.CHAPTER), **more})]
    assert steps("甲乙的关系") == [("relationship_graph", "graph_lookup"), ("relationship_evidence", "graph_hybrid")]
    assert steps("场景", needs_graph=True, entities=["甲乙"]) == [("graph_enhanced_retrieval", "graph_hybrid")]
    assert steps("场景", needs_graph=True, entities=[]) == [("default_retrieval", "bm25")]
    assert steps("what") == [("default_retrieval", "hybrid")]


def test_time_scope_needs_its_marker():
    scope = lambda q: retrieval.time_scope(q, retrieval.CHAPTER)
    assert scope("the 3 heroes") is None and scope("第 3 章") == (3, 3) and scope("第12-5章 3") == (5, 12) and scope("4到6章") == (4, 6)
    assert retrieval.time_scope("chapters 7-9") == (7, 9)


EVENT = "id long, from_entity string, to_entity string, type string, action string, chapter long, description string, polarity int, strength double, evidence string, confidence double"


def test_detailed_edges(spark):
    events = spark.createDataFrame([(1, "a", "b", "ally", "create", 1, "d1", 1, 0.0, "e1", None), (2, "a", "c", "foe", "create", 2, None, None, None, None, 0.2)], EVENT)
    snap = spark.createDataFrame([("a", "b", "ally", 1), ("x", "y", "sworn enemy", 2), ("x", "z", "old friend", 9)], "from_entity string, to_entity string, type string, chapter long")
    got = graph.edges_as_of(events, snap, 5, details=True, negative=["enemy"], positive=["friend"])
    rows = {(r.from_entity, r.to_entity): (r.action, r.description, r.polarity, r.strength, r.evidence, r.confidence, r.event_id) for r in got.collect()}
    assert rows == {
        ("a", "b"): ("create", "d1", 1, 0.0, "e1", 1.0, 1),
        ("a", "c"): ("create", "", 0, 0.5, "", 0.2, 2),
        ("x", "y"): ("snapshot", "", -1, 0.5, "", 1.0, None),
    }
    now = graph.edges_as_of(events, snap, details=True, negative=["enemy"], positive=["friend"])
    assert sorted(r.polarity for r in now.collect()) == [-1, 0, 1]


def test_subgraph_takes_events_before_the_snapshot(spark):
    events = spark.createDataFrame([(k, "a", f"n{k}", "t", "create", 3, None, None, None, None, None) for k in range(4)], EVENT)
    snap = spark.createDataFrame([("a", "s", "t", 4)], "from_entity string, to_entity string, type string, chapter long")
    edges = graph.edges_as_of(events, snap, 9, details=True)
    assert [e[1] for e in graph.subgraph(edges, "a", 1, 3)[0]] == ["n3", "n2", "n1"]
    assert [e[1] for e in graph.subgraph(edges, "a", 1, 9)[0]] == ["n3", "n2", "n1", "n0", "s"]
    assert [e[1] for e in graph.subgraph(edges.drop("event_id"), "a", 1, 1)[0]] == ["s"]
