"""The stored index against scoring all living texts, after batches, deletions, repeats and merges; what it reads."""

from __future__ import annotations

import random

import pytest
from skeinlake.operators import retrieval as R
from skeinlake.operators.index import Overtaken, WordIndex
from skeinlake.operators.storage import new_folder

WORDS = ["iron", "river", "stone", "oak", "mill", "crow", "ash", "fern"]


def docs_of(spark, rows):
    return spark.createDataFrame(sorted(rows.items()), "chunk_id long, content string")


def same(spark, index, living, query, k):
    want = [(r.chunk_id, round(r.score, 9)) for r in R.bm25(docs_of(spark, living), query, k).collect()]
    found = index.search(query, k, first_cells=2)
    assert [(r.id, round(r.score, 9)) for r in found.hits.collect()] == want
    return found


def text(rng):
    return " ".join(rng.choices(WORDS, [30, 10, 8, 5, 3, 2, 1, 1], k=rng.randrange(0, 40)))


def test_batches_and_merges(spark):
    rng, index, living = random.Random(5), WordIndex(spark, new_folder(spark), cell_docs=8), {}
    same(spark, index, {1: ""}, "nothing here", 3)
    for turn in range(5):
        ids = rng.sample(range(200), 90 if turn == 0 else 40)
        batch = {i: None if turn and rng.random() < 0.3 else text(rng) for i in ids}
        index.apply(docs_of(spark, batch))
        living.update(batch)
        living = {i: t for i, t in living.items() if t is not None}
        for query in ("iron ash", "fern", "mill crow oak"):
            same(spark, index, living, query, 10)
        n, avg, df = index.statistics(WORDS)
        lengths = [len(t.split()) for t in living.values()]
        assert n == len(living) and avg == pytest.approx(sum(lengths) / n)
        assert {w: df.get(w, 0) for w in WORDS} == {w: sum(w in t.split() for t in living.values()) for w in WORDS}
    before = len(index.state()[1])
    while index.merge(2):
        pass
    assert len(index.state()[1]) < before
    same(spark, index, living, "iron ash", 10)
    index.apply(docs_of(spark, {1: "iron iron ash", 500: "fern"}))
    same(spark, index, living | {1: "iron iron ash", 500: "fern"}, "fern ash", 20)


def test_ties_at_the_last_place(spark):
    """Equal documents everywhere: ids decide, whatever cell they are in."""
    living = {i: "stone oak" if i % 3 else "stone" for i in range(300)}
    index = WordIndex(spark, new_folder(spark), cell_docs=16)
    index.apply(docs_of(spark, living))
    for k in (1, 50, 150, 400):
        same(spark, index, living, "stone", k)
    same(spark, index, living, "oak stone", 120)


def test_blocks_that_cannot_reach_the_best_are_not_read(spark):
    rng = random.Random(2)
    living = {i: " ".join(["iron"] * rng.randrange(1, 3) + ["x" + "abcdefgh"[k % 8] for k in range(rng.randrange(1, 200))]) for i in range(2000)}
    index = WordIndex(spark, new_folder(spark), cell_docs=32)
    index.apply(docs_of(spark, living))
    found = same(spark, index, living, "iron", 10)
    assert 0 < found.read < found.blocks / 4


def test_a_batch_reads_its_own_texts_only(spark):
    """What a batch is computed from are its rows and the stored counts of the documents it replaces."""
    index = WordIndex(spark, new_folder(spark))
    index.apply(docs_of(spark, {i: text(random.Random(i)) for i in range(50)}))
    seen = []
    real = index._living
    index._living = lambda segments, ids=None: seen.append(ids) or real(segments, ids)
    index.apply(docs_of(spark, {3: "iron", 999: "ash"}))
    assert len(seen) == 1 and sorted(r.id for r in seen[0].collect()) == [3, 999]


def test_edges(spark):
    index = WordIndex(spark, new_folder(spark))
    index.apply(docs_of(spark, {}))
    assert index.state()[0] == 0
    rows = [(1, "ash"), (1, "oak ash"), (1, None), (None, "ash"), (2, ""), (3, "药 ash"), (4, None)]
    index.apply(spark.createDataFrame(rows, "chunk_id long, content string"))
    same(spark, index, {1: "oak ash", 2: "", 3: "药 ash"}, "ash 药", 5)
    index.apply(docs_of(spark, {1: None, 2: None, 3: None}))
    assert index.search("ash", 5).hits.collect() == [] and index.statistics(["ash"])[2].get("ash", 0) == 0


def test_two_writers(spark):
    path = new_folder(spark)
    one, other = WordIndex(spark, path), WordIndex(spark, path)
    one.apply(docs_of(spark, {1: "ash"}))
    real = other.versions.add

    def late(after, content):
        one.apply(docs_of(spark, {2: "ash oak"}))
        return real(after, content)

    other.versions.add = late
    with pytest.raises(Overtaken):
        other.apply(docs_of(spark, {3: "ash"}))
    other.versions.add = real
    other.apply(docs_of(spark, {3: "ash"}))
    same(spark, one, {1: "ash", 2: "ash oak", 3: "ash"}, "ash", 5)


def test_only_the_query_words_are_read(spark):
    index = WordIndex(spark, new_folder(spark))
    index.apply(docs_of(spark, {i: text(random.Random(i)) for i in range(50)}))
    plan = index.search("iron ash", 3).hits._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, " in plan and "CartesianProduct" not in plan
