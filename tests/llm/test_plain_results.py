"""Results of queries that SQL can't express, against plain versions over whole texts; and very long texts."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skeinlake.llm import common, decontaminate, fm, langid, near_copies, packing, quality_rules, secrets, sharding, simhash, token_rollup, toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def test_op1_against_a_plain_path(spark, tables):
    docs, _, texts = tables
    model = langid.fit(docs.filter(common.crc_bucket(F.col("doc_id"), 5) != 0))
    got = {r.doc_id: r.lang_pred for r in langid.op1_query(spark, FOLDER).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        score, letters, _, _ = model.words(text or "")
        if not len(score) or not any(unicodedata.category(c)[0] == "L" for c in text):
            assert got[i] == "und"
            continue
        rows, k = score.tolist(), len(model.langs)
        best, back = list(rows[0]), []
        for row in rows[1:]:
            came = [max(range(k), key=lambda j, i=i: (best[j] - (model.penalty if j != i else 0), j == i, -j)) for i in range(k)]
            best = [best[j] - (model.penalty if j != i else 0) + row[i] for i, j in enumerate(came)]
            back.append(came)
        at = max(range(k), key=lambda i: (best[i], -i))
        path = [at]
        for came in reversed(back):
            at = came[at]
            path.append(at)
        path.reverse()
        share = [0.0] * k
        for p, n in zip(path, letters.tolist(), strict=True):
            share[p] += n / letters.sum()
        share[path[0]] += model.opening
        top = sorted(share)[-2:]
        if len(top) < 2 or top[1] - top[0] > 1e-9:
            assert got[i] == model.langs[max(range(k), key=lambda i: share[i])], i


def sentences_of(text):
    """(tokens, words) of each sentence, tokens being distinct by their writing."""
    now, out = [], []
    for token in [*re.split(" ", re.sub(r"[^\S\n]", " ", (text or "").lower()).replace("\n", " \n ")), "\n"]:
        now.append(token)
        if token and (token[-1] in ".!?" or token == "\n"):
            out.append(now)
            now = []
    return out


def insulting(spark):
    """A small table in which every third text holds an insult, written in several ways."""
    rng = np.random.default_rng(3)
    fine = ["river", "stone", "garden", "window", "morning", "quiet", "letter", "bridge", "summer", "paper"]
    rows = []
    for i in range(60):
        words = [str(w) for w in rng.choice(fine, 12)]
        if i % 3 == 0:
            words[5:5] = ["you", rng.choice(["blockhead", "dimwit", "b l o c k h e a d", "dim-wit", "blockheads"])]
        text = " ".join(words[:6]) + ". " + "\t".join(words[6:]) + ("!" if i % 2 else "")
        rows.append((i, None if i == 50 else "" if i == 51 else text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 > 0)) for i in range(60)], "doc_id long, toxic int, quality int"), rows


def test_op7_against_the_definition(spark, tmp_path):
    """A model of its own over a small table: each score from the kernel's definition, sentence by sentence."""
    docs, labels, rows = insulting(spark)
    model = toxicity.fit(docs, labels)
    assert model.landmarks
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}

    def spans(word, cache={}):  # noqa: B006
        if word not in cache:
            out = defaultdict(float)
            for at in combinations(range(len(word)), toxicity.ORDER):
                out[tuple(word[k] for k in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1)
            cache[word] = out
        return cache[word]

    def kernel(a, b):
        x, y = spans(a), spans(b)
        return sum(v * y[k] for k, v in x.items() if k in y)

    def value(word, cache={}):  # noqa: B006
        if word not in cache:
            total = 0.0
            for part in toxicity.parts(word):
                for z, w in zip(model.landmarks, model.weights, strict=True):
                    base = math.sqrt(kernel(part, part) * kernel(z, z))
                    total += w * (kernel(part, z) / base) ** toxicity.POWER if base else 0.0
            cache[word] = total
        return cache[word]

    for i, text in rows:
        worst, telling, count = None, 0.0, 0
        seen = set()
        for tokens in sentences_of(text):
            words = {t: toxicity.letters(t) for t in tokens if t}
            # Single letters in a row are also the word they spell.
            runs, run = [], []
            for t in [*[t for t in tokens], "\n"]:
                w = toxicity.letters(t) if t else None
                if w is not None and len(w) == 1:
                    run.append(w)
                    continue
                if len(run) >= toxicity.SPELLED:
                    runs.append("".join(run))
                run = []
            total = sum(value(w) for w in words.values() if w) + sum(value(r) for r in runs)
            worst = total if worst is None else max(worst, total)
            telling += sum(value(r) for r in runs if value(r) > toxicity.TELLING)
            seen |= set(words)
            count += sum(bool(toxicity.letters(t)) for t in tokens if t)
        telling += sum(value(toxicity.letters(t)) for t in seen if toxicity.letters(t) and value(toxicity.letters(t)) > toxicity.TELLING)
        x = np.array([1.0, min(4.0, max(-4.0, (worst or 0.0) + model.bias)), math.log1p(telling), math.log1p(count) / 4])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-float(x @ model.curve))), abs=2e-3), (i, text)


def test_op9_verdict_against_plain_estimation(spark, tables):
    """Votes from the texts themselves, expectation-maximisation over documents one by one."""
    _, _, texts = tables
    votes = {}
    for i, t in texts.items():
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        n, letters = max(len(words), 1), max(sum(map(len, words)), 1)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {k + j for k, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for j in range(3)}
        symbols, upper, digits, stops = (len(re.findall(p, t)) for p in ("[#*$%&|<>]", "X^", "[0-9]", "[.!?]"))
        upper = sum(unicodedata.category(c) == "Lu" for c in t)
        dup, repeat, mean = (len(lines) - len(set(lines))) / max(len(lines), 1), len(covered) / n, letters / n if words else 0 / n
        mean = sum(map(len, words)) / n
        votes[i] = (
            symbols / n > 0.25, symbols / letters > 0.04, repeat > 0.4, dup > 0.5, upper / letters > 0.4, stops / n > 0.7 and upper / letters > 0.2, digits / letters > 0.25, mean < 2.2 or mean > 12,
            symbols / n < 0.05 and upper / letters < 0.15 and stops / n <= 0.4, repeat < 0.3, dup < 0.3,
        )
    sound = [False] * 8 + [True] * 3
    start = [quality_rules.SOUND if s else quality_rules.DEFECT for s in sound]
    prior, chance = 0.9, start

    def good(v):
        odds = math.log(prior / (1 - prior))
        for x, (g, b) in zip(v, chance, strict=True):
            odds += math.log(g / b) if x else math.log((1 - g) / (1 - b))
        return 1 / (1 + math.exp(-max(-60, min(60, odds))))

    for _ in range(100):
        p = {i: good(v) for i, v in votes.items()}
        mass, new = sum(p.values()), []
        for k, (s, (g0, b0)) in enumerate(zip(sound, start, strict=True)):
            g = (sum(p[i] for i, v in votes.items() if v[k]) + quality_rules.SMOOTH * g0) / (mass + quality_rules.SMOOTH)
            b = (sum(1 - p[i] for i, v in votes.items() if v[k]) + quality_rules.SMOOTH * b0) / (len(votes) - mass + quality_rules.SMOOTH)
            new.append((max(g, b), b) if s else (g, max(g, b)))
        prior, chance = min(0.99, max(0.01, mass / len(votes))), [(min(1 - 1e-9, max(1e-9, g)), min(1 - 1e-9, max(1e-9, b))) for g, b in new]
    for r in quality_rules.op9_query(spark, FOLDER).collect():
        want = good(votes[r.doc_id])
        assert r.quality == pytest.approx(want, abs=1e-9) and r.kept == (want >= 0.5 and not r.base_failed)


def test_op10_against_all_pairs(spark, tables):
    docs, labels, texts = tables
    model = fm.fit(docs, labels.filter(common.crc_bucket(F.col("doc_id"), 5) != 0), "quality")
    for r in fm.op10_query(spark, FOLDER).collect():
        _, at, x = fm.Features()([texts[r.doc_id]])
        v = model.v[at] * x[:, None]
        gram = v @ v.T
        raw = model.w0 + float(model.w[at] @ x) + float(np.triu(gram, 1).sum())
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-60, min(60, raw)))), abs=1e-9)
        assert r.predicted == int(r.score >= 0.3)


# --- very long texts, all of them read to their end

WORDS = 400_000


@pytest.fixture(scope="module")
def long_table(spark):
    text = " ".join(f"wort{k}" + ("\n" if k % 50 == 49 else "") for k in range(WORDS))
    rows = [(1, text + " password=hunter2222"), (2, text + " password=hunter2222"), (3, "short text"), (4, "y" * 2_000_000)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2), dict(rows)


def test_long_texts_secrets_and_tiles(spark, long_table):
    docs, texts = long_table
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    at = texts[1].index("password=")
    assert got[1].spans == f"assign:{at}:{len(texts[1])}" and got[4].spans == ""
    item = " ".join(f"wort{k}" for k in range(WORDS - 40, WORDS))
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.find_leaks(docs, bench).collect()) == [1, 2]


def test_long_texts_pieces_prints_and_shards(spark, long_table):
    docs, texts = long_table
    pieces = packing.pack(docs).collect()
    for i, t in texts.items():
        mine = sorted((p.start, p.length) for p in pieces if p.doc_id == i)
        assert mine[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:], strict=False)) and sum(n for _, n in mine) == len(packing.encoder()(t)) + 1
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == near
    assert {r.id: r.size for r in sharding.shard(docs).collect()} == {i: len(t.encode()) + 1 for i, t in texts.items()}


def test_long_texts_scores_and_counts(spark, long_table):
    docs, texts = long_table
    rows = {r.id: r for r in quality_rules.features(docs).collect()}
    assert rows[1].n_words == WORDS + 1 and rows[4].word_chars == 2_000_000 and rows[1].n_repeat_words == 0
    counts = docs.select("doc_id", token_rollup.pattern_count(token_rollup.WORDS).alias("n")).collect()
    assert {r.doc_id: r.n for r in counts} == {1: WORDS + 1, 2: WORDS + 1, 3: 2, 4: 1}
    train, labels, _ = insulting(spark)
    tail = docs.union(spark.createDataFrame([(5, texts[4] + ". river you blockhead stone!")], docs.schema))
    scores = {r.doc_id: r.score for r in toxicity.score(tail, toxicity.fit(train, labels)).collect()}
    assert len(scores) == 5 and scores[5] > scores[4]
    assert {r.doc_id for r in fm.score(docs, fm.fit(train, labels, "quality")).collect()} == set(texts)
    german = spark.createDataFrame([(i, "de" if i % 2 else "en", "wort satz und haus " * 5 if i % 2 else "the thing with three words " * 5) for i in range(20)], "doc_id long, lang string, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.fit(german)).collect()}[1] == "de"
    assert xxhash.VERSION
