"""Near copies of the pipeline against all pairs compared one by one."""

from __future__ import annotations

import random

import pytest

from skeinlake.llm import near_copies


def plain_sets(texts, shingle=5):
    out = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        out[i] = frozenset(tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))) if w else frozenset()
    return out


def plain_near(texts, least=0.8):
    """{id: smallest id within reach}, and the pairs of different sets that are linked."""
    sets, up, pairs = plain_sets(texts), {i: i for i in texts}, set()

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x != y and min(len(x), len(y)) < least * max(len(x), len(y)) - 1e-9:
                continue
            if x == y or len(x & y) >= least * len(x | y) - 1e-9:
                if x != y:
                    pairs.add((a, b))
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}, pairs


def changed(rng, words, share):
    return [w if rng.random() >= share else f"new{rng.randrange(10**6)}" for w in words]


def planted(seed):
    """Strangers, copies around the bound, chains whose ends aren't near each other, repeated lines, short texts."""
    rng = random.Random(seed)
    out = []
    for _ in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 6, 20, 80, 400]))]
        out.append(words)
        for _ in range(rng.choice([0, 1, 4])):
            out.append(changed(rng, words, rng.choice([0.01, 0.02, 0.04, 0.1])))
        for _ in range(rng.choice([0, 0, 5])):
            words = changed(rng, words, 0.02)
            out.append(words)
        if rng.random() < 0.2:
            out.append(words + words[-12:] * 30)
    rng.shuffle(out)
    return {i: " ".join(w).upper() if i % 7 == 0 else "  ".join(w) for i, w in enumerate(out)}


@pytest.mark.parametrize(("seed", "side"), [(1, 1024), (2, 3)])
def test_components_equal_brute_force(spark, monkeypatch, seed, side):
    monkeypatch.setattr(near_copies, "SIDE_TEXTS", side)
    texts = planted(seed)
    want, pairs = plain_near(texts)
    assert len(pairs) > 30
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == want


def test_pipeline_stage_has_whole_recall(spark):
    """sf0.01 has five pairs of different sets at 0.8 or more (twelve of ids); four bits find one of the five."""
    import corpus_pipeline as P

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want, pairs = plain_near({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    assert len(pairs) == 12
    kept = {r.doc_id for r in P.without_near_duplicates(spark, docs, folder).select("doc_id").collect()}
    assert kept == {i for i, c in want.items() if i == c}
