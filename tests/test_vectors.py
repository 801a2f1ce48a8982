"""Vector cells against comparing everything: clustered and scattered vectors, zero vectors, ties, splits."""

from __future__ import annotations

import numpy as np
import pytest

from skeinlake.operators import vectors as V


def frame(spark, vectors):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v]) for i, v in vectors], "chunk_id long, embedding array<float>").repartition(3)


def plain(vectors, queries, k):
    out = set()
    known = [(i, np.array(v, np.float32).astype(float)) for i, v in vectors if v is not None and len(v)]
    for qi, q in queries:
        if q is None or not len(q):
            continue
        q = np.array(q, np.float32).astype(float)
        scored = []
        for i, v in known:
            n = np.sqrt((v * v).sum()) * np.sqrt((q * q).sum())
            scored.append((-(0.0 if n == 0 else float((v * q).sum() / n)), i))
        out |= {(qi, i, round(-s, 9)) for s, i in sorted(scored)[:k]}
    return out


def check(spark, vectors, queries, k, **more):
    index = V.build_index(frame(spark, vectors), **more)
    hits, read = V.nearest(index, frame(spark, queries), k)
    got = {(r.query_id, r.id, round(r.score, 9)) for r in hits.collect()}
    assert got == plain(vectors, queries, k)
    return index, {r.query_id: r.cells for r in read.collect()}


def clustered(rng, groups, each, width=16, spread=0.02):
    centers = rng.normal(size=(groups, width))
    return [(g * each + i, centers[g] + spread * rng.normal(size=width)) for g in range(groups) for i in range(each)]


def test_most_cells_of_clustered_vectors_are_skipped(spark):
    vectors = clustered(np.random.default_rng(1), 20, 40)
    index, read = check(spark, vectors, vectors[::50], 10, cells=20)
    assert max(read.values()) < len(index.counts) / 2


def test_scattered_vectors(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, v) for i, v in enumerate(rng.normal(size=(300, 8)))]
    check(spark, vectors, vectors[:20], 7)


def test_split_groups(spark, monkeypatch):
    monkeypatch.setattr(V, "GROUP_VECTORS", 7)
    monkeypatch.setattr(V, "GROUP_QUERIES", 3)
    vectors = clustered(np.random.default_rng(3), 4, 30)
    check(spark, vectors, vectors[::5], 6, cells=4)


def test_zeros_nulls_ties_and_repeats(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=6)
    vectors = [(i, base * (i + 1)) for i in range(5)] + [(10 + i, -base) for i in range(3)] + [(20, np.zeros(6)), (21, np.zeros(6)), (22, None), (23, [])]
    queries = [(1, base), (2, np.zeros(6)), (3, None), (4, []), (5, -base), (6, rng.normal(size=6))]
    for k in (1, 3, 8, 50):
        hits, _ = V.nearest(V.build_index(frame(spark, vectors)), frame(spark, queries), k)
        got = {(r.query_id, r.id, round(r.score, 6)) for r in hits.collect()}
        want = {(q, i, round(s, 6)) for q, i, s in plain(vectors, queries, k)}
        assert {x[0] for x in got} == {1, 2, 5, 6} and {(q, s) for q, _, s in got} == {(q, s) for q, _, s in want}


@pytest.mark.parametrize("vectors", [[], [(1, None)], [(1, [0.0, 0.0])]])
def test_nearly_nothing(spark, vectors):
    hits, _ = V.nearest(V.build_index(frame(spark, vectors)), frame(spark, [(1, [1.0, 2.0])]), 3)
    assert len(hits.collect()) == sum(v is not None for _, v in vectors)
