"""Greedy string tiling: equality with the plain form, repeated tokens, short items, whole documents."""

from __future__ import annotations

import random
import resource
import time

import pytest

from skeinlake.llm import decontaminate


def plain_tiles(text, item, least):
    """By trying every pair of places: longest first, then place in the item, then in the text."""
    ut, ui, out = [x == 0 for x in text], [False] * len(item), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                k = 0
                while t + k < len(text) and p + k < len(item) and not ut[t + k] and not ui[p + k] and text[t + k] == item[p + k]:
                    k += 1
                best = max(best, (k, -p, -t))
        k, p, t = best[0], -best[1], -best[2]
        if k < least:
            return out
        ut[t : t + k] = ui[p : p + k] = [True] * k
        out.append((t, p, k))


@pytest.mark.parametrize("seed", range(60))
def test_tiles_equal_the_plain_form(seed):
    rng = random.Random(seed)
    words = rng.choice([2, 3, 8, 40])
    item = [rng.randint(1, words) for _ in range(rng.randint(3, 50))]
    text = [rng.randint(0, words) for _ in range(rng.randint(0, 90))]
    for _ in range(rng.randint(0, 3)):
        a, b = sorted(rng.sample(range(len(item) + 1), 2))
        text[rng.randint(0, len(text)) : 0] = item[a:b]
    assert decontaminate.tile(text, item) == plain_tiles(text, item, decontaminate.TILE)


@pytest.mark.parametrize(("n", "m"), [(1_000_000, 200), (1_000_000, 5), (200, 20_000), (300_000, 30_000)])
def test_repeated_tokens_take_little_time_and_memory(n, m):
    started, before = time.perf_counter(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    index = decontaminate.Index([(1, "aa " * m)])
    (found,) = index.leaks(["aa " * n], 0.8)
    covered = min(n, m)
    assert [f[:4] for f in found] == ([(1, covered / m, covered, m)] if covered >= 0.8 * m else [])
    assert time.perf_counter() - started < 60
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_500_000


def test_periodic_tokens_take_little_time():
    started = time.perf_counter()
    index = decontaminate.Index([(k, "ab cd ef " * 60 + f"u{k} v{k}") for k in range(5)])
    (found,) = index.leaks(["cd ef ab xx " * 100_000], 0.8)
    assert time.perf_counter() - started < 60 and all(f[5] >= 3 for f in found)


def test_tiles_far_from_every_seed_count():
    """One seed of five and pieces of three and four far off cover the item."""
    item = [f"t{k}" for k in range(20)]
    pieces = [item[:5], item[5:9], item[9:12], item[12:16], item[16:20]]
    text = " ".join(" ".join(p) + " " + " ".join(f"z{k}x{j}" for j in range(300)) for k, p in enumerate(pieces))
    (found,) = decontaminate.Index([(7, " ".join(item))]).leaks([text], 0.8)
    assert found == [(7, 1.0, 20, 20, 5, 5)]


def test_short_items_match_whole(spark):
    bench = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta gamma delta"), (3, "omega"), (4, "...")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x Alpha, beta y"), (2, "alpha x beta"), (3, "see alpha beta gamma delta"), (4, "omegas"), (5, None), (6, "")], "doc_id long, text string")
    got = decontaminate.find_leaks(docs, bench)
    assert sorted((r.doc_id, r.item_id, r.coverage) for r in got.collect()) == [(1, 1, 1.0), (3, 1, 1.0), (3, 2, 1.0)]
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, bench, block_chars=8).collect()) == [2, 4, 5, 6]


def test_clashing_columns_and_blocks(spark):
    bench = spark.createDataFrame([(k, " ".join(f"b{k}w{j}" for j in range(12))) for k in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(f"b3w{j}" for j in range(12)), "a"), (2, "clean words", "b")], "doc_id long, text string, Leak string")
    kept = decontaminate.drop_leaks(docs, bench, block_chars=60)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "clean words", "b")]


def test_both_token_patterns_agree():
    pieces = ["Word", "_", "é", "ß1", "漢", "ไทย", "ー", "-", " ", "\n", "x2", "々", "ｱ", "က"]
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 12)))
        assert decontaminate.tokens(text) == decontaminate.TOKEN.findall(text.lower())
