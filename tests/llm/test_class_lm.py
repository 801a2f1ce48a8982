"""The class model: base counts against plain counting, probabilities that sum to one, gains of moves, edges."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinlake.llm import class_lm as M
from skeinlake.llm.common import crc_bucket

FOLDER = "/root/testdata/sf0.001"
END = object()


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), END]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def check_base(rows, got):
    """Rows (id, text) and results in the same order."""
    train = Counter()
    for i, text in rows:
        if not held(i):
            train.update(tokens(text))
    n, v = sum(train.values()), len(train)
    want = sorted((str(i), held(i), len(tokens(t)), sum(w in train for w in tokens(t)), n, round(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 5)) for i, t in rows)
    mine = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got)
    assert [x[:5] for x in mine] == [x[:5] for x in want]
    assert all(abs(a[5] - b[5]) < 1e-4 for a, b in zip(mine, want, strict=True))


def score(docs, **more):
    return M.score(docs, crc_bucket(F.col("doc_id"), 10) == 0, **more)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")


def test_query_against_plain_counts(spark, docs):
    got = M.op11_query(spark, FOLDER)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = got.collect()
    check_base([tuple(r) for r in docs.collect()], rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


@pytest.mark.parametrize(("head", "core"), [(200, 50), (1, 1), (0, 0), (5000, 5)])
def test_words_outside_the_head_are_joined(docs, head, core):
    """Whatever tasks look up, counts and base are the same; so are classes' probabilities for what a model gives."""
    check_base([tuple(r) for r in docs.collect()], score(docs, head=head, core=core, rounds=1).collect())


class Held:
    """What ``score`` builds, kept: every part of the model in plain form."""

    def __init__(self, monkeypatch):
        real, self.kept = M.modelled, {}

        def spy(head, classes, tail, found, documents, words):
            model = real(head, classes, tail, found, documents, words)
            self.kept |= {"model": model, "head": head, "tail": tail.collect(), "documents": documents}
            return model

        monkeypatch.setattr(M, "modelled", spy)

    def tables(self):
        k, m = self.kept, self.kept["model"]
        of = {w: (int(m.classes[i + 1]), int(k["head"].counts[i + 1])) for i, w in enumerate(k["head"].words)}
        of |= {bytes(r.word): (r["class"], r.n) for r in k["tail"]}
        return m, of


@pytest.mark.parametrize("head", [1 << 20, 150])
def test_scores_follow_from_classes(docs, monkeypatch, head):
    """Transitions and emissions counted anew from the classes; every document's score from the definition."""
    held_ = Held(monkeypatch)
    got = {r.doc_id: r.score for r in score(docs, head=head, core=100, rounds=2).collect()}
    model, of = held_.tables()
    rows = [tuple(r) for r in docs.collect()]
    train = Counter(w for i, t in rows if not held(i) for w in tokens(t) if w is not END)
    assert {w.encode(): n for w, n in train.items()} == {w: n for w, (_, n) in of.items()}
    cls = lambda w: 0 if w is END else of.get(w.encode(), (model.unknown, 0))[0]
    pairs, documents = np.zeros((M.CLASSES, M.CLASSES)), sum(not held(i) for i, _ in rows)
    for i, t in rows:
        if not held(i):
            line = [END, *tokens(t)]
            for a, b in zip(line, line[1:], strict=False):
                pairs[cls(a), cls(b)] += 1
    mass, types = np.zeros(M.CLASSES), np.zeros(M.CLASSES)
    for c, n in of.values():
        mass[c] += n
        types[c] += 1
    once, twice = (sum(n == k for _, n in of.values()) for k in (1, 2))
    discount = once / (once + 2 * twice)
    assert 0.1 < discount < 0.9 and model.discount == pytest.approx(discount)
    mass[0] = documents
    used = mass > 0
    share = np.where(used, pairs.sum(axis=0) + 1, 0)
    moved = (pairs + M.MU * share / share.sum()) / (pairs.sum(axis=1, keepdims=True) + M.MU)
    left = discount * types / np.maximum(mass, 1)
    least = M.ALPHA / (sum(train.values()) + documents + M.ALPHA * (len(train) + 2) + 1)

    def follows(a, b):
        c = cls(a)
        if b is not END and b.encode() not in of:
            return (1 - least) * float(moved[c] @ left) + least
        return (1 - least) * moved[c, cls(b)] * (1.0 if b is END else (of[b.encode()][1] - discount) / mass[cls(b)])

    for i, t in rows:
        line = [END, *tokens(t)]
        want = sum(math.log10(follows(a, b)) for a, b in zip(line, line[1:], strict=False))
        assert abs(got[i] - want) < 1e-6 * max(1, abs(want)), i
    # All that may follow: the end, every word of the vocabulary and an unknown one.
    for a in [END, "never seen", *[w.decode() for w in list(of)[:40]]]:
        assert sum(follows(a, b) for b in [END, "never seen", *[w.decode() for w in of]]) == pytest.approx(1)


def test_moves_raise_the_likelihood():
    """Two kinds of words in turn: exchange finds them, and each gain is the change of the likelihood."""
    rng = np.random.default_rng(1)
    line = []
    for _ in range(4000):
        line += [int(rng.integers(1, 11)), int(rng.integers(11, 21))]
    core = 20
    classes = np.array([M.CLASSES, *rng.integers(1, 3, core), 0], np.int64)

    def stats(classes):
        counts, pairs = np.zeros((core + 1, 2 * M.SLOTS + 1), np.int64), np.zeros((M.SLOTS, M.SLOTS), np.int64)
        for a, b in zip(line, line[1:], strict=False):
            counts[a, classes[b]] += 1
            counts[b, M.SLOTS + classes[a]] += 1
            pairs[classes[a], classes[b]] += 1
            counts[a, -1] += a == b
        return counts, pairs

    before = M.likelihood(stats(classes)[1])
    for _ in range(4):
        counts, pairs = stats(classes)
        moved = M.exchanged(counts, pairs, classes, core, at_once=1)
        assert M.likelihood(stats(moved)[1]) >= M.likelihood(pairs) - 1e-6
        classes = moved
    assert M.likelihood(stats(classes)[1]) > before
    assert not set(classes[1:11].tolist()) & set(classes[11:21].tolist())


def test_placing_agrees_with_exchange():
    """A rare word of one context goes where exchange would put it."""
    rng = np.random.default_rng(3)
    pairs = rng.integers(1, 500, (M.SLOTS, M.SLOTS))
    place = M.Placer(pairs)
    for _ in range(50):
        after, before = rng.integers(0, M.CLASSES), rng.integers(0, M.CLASSES)
        many = int(rng.integers(1, 12))
        got = place(np.array([0]), np.array([after, M.SLOTS + before]), np.array([many, many]), np.array([many]))[0]
        gain = []
        for b in range(1, M.CLASSES):
            p = pairs.astype(float)
            p[b, after] += many
            p[before, b] += many
            gain.append(M.likelihood(p) - M.likelihood(pairs))
        # The rows and columns of the context classes grow alike for each target.
        assert gain[got - 1] >= max(gain) - 0.35


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "Same WORDS same"), (5, "Same WORDS same"), (5, "Same WORDS same"), (None, "no id"), (7, "İstanbul É\x85x \U0001f600"), (8, "x" * 300 + " " + "y " * 5000), (9, "x" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for more in ({}, {"head": 2, "core": 1}):
        got = score(df, **more).collect()
        check_base(rows, got)
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
        same = {round(r.score, 9) for r in got if r.doc_id in (4, 5)}
        assert len(same) == 1
    clash = df.selectExpr("doc_id", "text", "1 as held", "'x' as codes", "2 as row", "text as score")
    check_base(rows, score(clash).collect())


def test_without_rows_or_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert score(empty).collect() == []
    out = [i for i in range(200) if held(i)][:3]
    df = spark.createDataFrame([(i, "some words") for i in out], "doc_id long, text string")
    got = score(df).collect()
    assert len(got) == 3 and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score) for r in got)


def test_one_word_with_most_rows(spark):
    """A word that only documents held out have, in most pairs, and a long word that all have."""
    out = [i for i in range(400) if held(i)]
    rows = [(i, "new " * 40) for i in out] + [(i, f"{'z' * 80} and {'z' * 80}") for i in range(400) if not held(i)]
    got = score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), head=1, core=1).collect()
    check_base(rows, got)
