"""Seeds named in a query, and graph search from them."""

from __future__ import annotations

from skeinlake.operators import retrieval


def test_a_common_alias_does_not_crowd_out_other_words(spark):
    names = spark.createDataFrame([("A", i, "c") for i in range(1000)] + [("B", 5000, "c")], "alias string, entity_id long, entity_type string")
    people = spark.createDataFrame([(i,) for i in [*range(1000), 5000]], "id long")
    assert retrieval.normalize_ids(["B", "A"], people, names) == [5000, *range(29)]
    assert retrieval.normalize_ids(["A", "B"], people, names) == list(range(30))
    assert retrieval.normalize_ids([], people, names) == []


def test_a_word_that_is_an_id_keeps_its_alias_hits(spark):
    people = spark.createDataFrame([("hero",), ("p",)], "id string")
    names = spark.createDataFrame([("hero", "p", "c")], "alias string, entity_id string, entity_type string")
    assert retrieval.seed_entities("the hero here", people, names) == ["p", "hero"]
    assert retrieval.normalize_ids(["hero"], people, names) == ["hero"]


def graph_world(spark):
    people = spark.createDataFrame([("h", "Hero"), ("f", "Friend"), ("z", "Stranger")], "id string, canonical_name string")
    names = spark.createDataFrame([("Boss", "h", "c"), ("Pal", "f", "c")], "alias string, entity_id string, entity_type string")
    edges = spark.createDataFrame([("h", "f", "knows", 3), ("f", "z", "knows", 2)], "from_entity string, to_entity string, type string, chapter long")
    rows = [("base", "nothing", 9), ("alias", "the Boss came", 9), ("related", "a Pal left", 9), ("far", "the Stranger", 9), ("late", "Hero again", 20)]
    chunks = spark.createDataFrame([(i, t, c, [1.0, 0.0]) for i, t, c in rows], "chunk_id string, content string, chapter long, embedding array<double>")
    return people, names, edges, chunks, spark.createDataFrame([("base", 0.5)], "chunk_id string, score double")


def test_graph_hybrid_reaches_aliases_and_related_entities(spark):
    people, names, edges, chunks, base = graph_world(spark)

    def found(query, **more):
        got = retrieval.graph_hybrid(base, chunks, query, [1.0, 0.0], people, names, edges, 5, **more)
        return [(r.chunk_id, round(r.score, 6)) for r in got.collect()]

    assert found("where is Boss", now=9) == [("alias", 1.25), ("related", 1.15), ("base", 0.5)]
    assert found("nobody", centers=["h"], now=9) == found("where is Boss", now=9)
    assert [i for i, _ in found("Boss", now=9, hops=2)] == ["alias", "far", "related", "base"]
    assert [i for i, _ in found("Boss")] == ["late", "alias", "related", "base"]
    assert found("nobody") == [("base", 0.5)]


def test_graph_hybrid_reranks_the_merged_list(spark):
    people, names, edges, chunks, base = graph_world(spark)
    from pyspark.sql import functions as F

    by_id = lambda hits: hits.select("chunk_id", F.when(F.col("chunk_id") == "base", 2.0).otherwise(1.0).alias("score"))
    got = retrieval.graph_hybrid(base, chunks, "Boss", [1.0, 0.0], people, names, edges, 2, now=9, rerank=by_id).collect()
    assert [(r.chunk_id, r.score) for r in got] == [("base", 2.0), ("alias", 1.0)]
    none = retrieval.graph_hybrid(base, chunks, "Boss", [1.0, 0.0], people, names, edges, 2, now=9, rerank=lambda h: h.limit(0)).collect()
    assert [r.chunk_id for r in none] == ["alias", "related"]
