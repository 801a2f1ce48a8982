"""The Gray index over several groups, forests of links, oversized groups, and the operator with a similarity."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from skeinlake.llm import near_copies, simhash
from skeinlake.llm.components import components
from tests.llm.test_near_copies import plain_near, planted


def prints_of(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, max(1, n // 12), dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(n)], np.uint64)
    return np.unique(rng.choice(base, n) ^ flips)


@pytest.mark.parametrize("seed", range(8))
def test_groups_are_searched_apart(seed):
    fps = np.concatenate([prints_of(seed, n) for n in (1, 2, 40, 300)])
    group = np.sort(np.random.default_rng(seed).integers(0, 9, len(fps)))
    got = {(int(a), int(b)) for x, y in simhash.GrayIndex(fps, group).links(fps, 4, 256, group) for a, b in zip(x, y, strict=True)}
    near = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4) & (group[:, None] == group[None, :])
    assert got == set(zip(*(v.tolist() for v in np.nonzero(near)), strict=True))


def classes(n, edges):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("seed", range(8))
def test_forest_connects_what_is_near(seed):
    rng = np.random.default_rng(seed)
    fps = np.concatenate([prints_of(seed, n) for n in (3, 40, 300)])
    group = np.sort(rng.integers(0, 5, len(fps)))
    left = rng.random(len(fps)) < rng.choice([0.3, 1.0])
    right = ~left | (rng.random(len(fps)) < rng.choice([0.0, 1.0]))
    edges = simhash.forest(fps, group, left, right, 4, 512)
    allowed = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4) & (group[:, None] == group[None, :])
    assert all(allowed[a, b] for a, b in edges)
    wanted = allowed & left[:, None] & right[None, :]
    have = classes(len(fps), edges)
    assert all(have[a] == have[b] for a, b in zip(*np.nonzero(wanted), strict=True))
    if left.all() and right.all():
        assert have == classes(len(fps), list(zip(*np.nonzero(wanted), strict=True)))


def test_dense_groups_cost_little():
    rng = np.random.default_rng(4)
    started = time.perf_counter()
    centre = np.uint64(0x0123456789ABCDEF)
    fps = np.unique(np.array([centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 8, replace=False))) for _ in range(8000)], np.uint64))
    everywhere = np.ones(len(fps), bool)
    edges = simhash.forest(fps, np.zeros(len(fps), np.int64), everywhere, everywhere, 24)
    assert len(edges) == len(fps) - 1 and time.perf_counter() - started < 20


@pytest.mark.parametrize("chunk", [8, 64])
def test_oversized_groups_lose_no_link(spark, chunk):
    """Dense clouds with strangers under one key, larger than a chunk many times."""
    rng = random.Random(chunk)
    fps = {}
    for cloud in range(4):
        centre = rng.getrandbits(64)
        for _ in range(60):
            fps[centre ^ sum(1 << b for b in rng.sample(range(64), 2))] = None
    fps |= {rng.getrandbits(64): None for _ in range(40)}
    rows = [(simhash.signed(x), i, 0, 7) for i, x in enumerate(fps)]
    keyed = spark.createDataFrame(rows, "fp long, id long, t int, key long")
    edges = simhash.links(keyed, 4, chunk, keyed)
    by = dict(enumerate(fps))
    assert all((by[r.a] ^ by[r.b]).bit_count() <= 4 for r in edges.collect())
    found = {r.node: r.component for r in components(edges).collect()}
    near = [(a, b) for a in by for b in by if a < b and (by[a] ^ by[b]).bit_count() <= 4]
    assert [found.get(i, i) for i in by] == classes(len(by), near)


@pytest.mark.parametrize("seed", [1, 7])
def test_operator_with_similarity_equals_brute_force(spark, seed):
    texts = planted(seed)
    want, _ = plain_near(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = simhash.near_duplicates(docs, shingle=5, bound=near_copies.BOUND, similarity=0.8)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_linked_texts_are_within_the_bound(spark):
    """Every pair of sf0.01 at 0.8 or more, and planted ones, is well within BOUND."""
    pool = [planted(k) for k in range(8)] + [{r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}]
    far = []
    for texts in pool:
        for a, b in plain_near(texts)[1]:
            x, y = (simhash.majority(near_copies.shingle_set(texts[i])) for i in (a, b))
            far.append((x ^ y).bit_count())
    assert len(far) > 200 and max(far) <= near_copies.BOUND


def test_other_ids_are_an_error(spark):
    with pytest.raises(TypeError):
        simhash.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
