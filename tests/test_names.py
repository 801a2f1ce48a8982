"""Names in texts: nested and overlapping names, blocks, edges; linear in the text."""

from __future__ import annotations

import random
import time

import pytest

from skeinlake.operators import names as N


def plain(texts, names):
    out = set()
    for i, text in texts:
        for n in {n for n in names if n}:
            at = [k for k in range(len(text or "")) if text.startswith(n, k)]
            if at:
                out.add((i, n, len(at), at[0]))
    return out


def found(spark, texts, names, **more):
    t = spark.createDataFrame(texts, "id long, text string").repartition(3)
    n = spark.createDataFrame([(x,) for x in names], "name string")
    return {tuple(r) for r in N.names_in_texts(t, n, "id", "text", **more).collect()}


NAMES = ["he", "she", "his", "hers", "h", "ana", "banana", "nan", "药老", "老", "a b", "", None, "he"]
TEXTS = [(1, "ushers"), (2, "banana bananana"), (3, "药老在此 老"), (4, ""), (5, None), (6, "a b a b"), (7, "HE"), (1, "she"), (8, "𝒜he😀she")]


@pytest.mark.parametrize("block_chars", [1_000_000, 5])
def test_nested_and_overlapping(spark, block_chars):
    """The same from one block and from many."""
    want = plain(TEXTS, [n for n in NAMES if n])
    assert found(spark, TEXTS, NAMES, block_chars=block_chars) == want


def test_random_names(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    names = [word(rng.randrange(1, 6)) for _ in range(60)]
    texts = [(k, word(rng.randrange(0, 80))) for k in range(60)]
    assert found(spark, texts, names) == plain(texts, names)


def test_no_names_and_no_texts(spark):
    assert found(spark, TEXTS, []) == set() and found(spark, [], NAMES) == set()


def test_time_follows_the_text():
    """Ten times the names cost no more than a little."""
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghij ") for _ in range(300_000))
    took = []
    for many in (2_000, 20_000):
        built = N.automaton([f"name{k}" for k in range(many)] + ["zzzz"])
        began = time.perf_counter()
        N.found_in(built, text)
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 0.05


def test_term_counts(spark):
    t = spark.createDataFrame(TEXTS, "id long, text string").filter("id > 1")
    got = {tuple(r) for r in N.term_counts(t, {"x": ["he", "ana"], "y": ["he", "nan", ""]}, "id", "text").collect()}
    assert got == {(2, 2), (8, 2)}
