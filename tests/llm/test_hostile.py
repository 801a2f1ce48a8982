"""Inputs made to be slow: secrets that are cut off, benchmarks from one template, stars of links, many languages."""

from __future__ import annotations

import base64
import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinlake.llm import decontaminate, langid, secrets, simhash
from skeinlake.llm.components import components


def kinds(text):
    return [k for _, _, k in secrets.all_spans(text)[1]]


BEGIN = "-----BEGIN PRIVATE KEY-----"
HEADERS = "Proc-Type: 4,ENCRYPTED\\nDEK-Info: AES-128-CBC,00\\n"


@pytest.mark.parametrize(
    "text",
    [
        BEGIN + "Aa: x\\n" * 160_000 + "!",
        (BEGIN + HEADERS * 12 + "!") * 1500,
        BEGIN * 40_000,
        (BEGIN + "\\n") * 30_000,
        BEGIN + " " * 1_000_000 + "!",
        BEGIN + "\\" * 1_000_000 + "!",
        BEGIN + "Aa: " + "\\" * 1_000_000,
        (BEGIN + "Aa: " + "\\" * 150 + "\n") * 5000,
        BEGIN + "A" * 1_000_000 + "!",
        "eyJ" * 330_000,
        "\\neyJaaaaa" * 100_000,
        "eyJaaaaa." * 110_000,
        "ssh-rsa " * 125_000,
        "ssh-rsa AAAA" * 83_000,
        "a" * 1_000_000,
        "0123456789abcdef" * 62_500,
        "AKIA" * 250_000,
        "password=" * 110_000,
        ("Aa1" * 20 + "\n") * 16_000,
    ],
)
def test_hostile_runs_are_walked_once(text):
    began = time.perf_counter()
    secrets.all_spans(text)
    assert time.perf_counter() - began < 6


def test_ten_megabytes_of_headers():
    text = (BEGIN + HEADERS * 3) * (10_000_000 // len(BEGIN + HEADERS * 3))
    began = time.perf_counter()
    assert not list(secrets.PEM.finditer(text))
    assert time.perf_counter() - began < 2


def encrypted(end):
    body = base64.b64encode(bytes(random.Random(5).randbytes(256))).decode()
    lines = [body[k : k + 64] for k in range(0, len(body), 64)]
    return end.join(["-----BEGIN RSA PRIVATE KEY-----", "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF", "", *lines, "-----END RSA PRIVATE KEY-----"])


@pytest.mark.parametrize("end", ["\n", "\r\n", "\\n", "\\\\n"])
def test_encrypted_keys_with_headers(end):
    assert kinds("x " + encrypted(end) + " y") == ["pem"]
    # The first of two is cut off.
    cut = encrypted(end)
    assert kinds(cut[:200] + " " + cut) == ["pem"]


@pytest.mark.parametrize("before", ["", " ", "a\\n", "a\\t", "a\\u000a", '"'])
def test_tokens_behind_escaped_breaks(before):
    def part(x):
        return base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")

    token = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': '1'})}.c2lnbmF0dXJlc2ln"
    (span,) = secrets.added_spans(before + token)
    assert span == (len(before), len(before) + len(token), "jwt")
    assert kinds("a" + token) == []


def plain_leaks(items, texts, threshold):
    """Every pair that shares a seed, tiled without any bound before."""
    out = set()
    for d, text in enumerate(texts):
        x = decontaminate.tokens(text)
        for i, item in items:
            y = decontaminate.tokens(item)
            if not {tuple(x[k : k + 5]) for k in range(len(x) - 4)} & {tuple(y[k : k + 5]) for k in range(len(y) - 4)}:
                continue
            number = {w: k + 1 for k, w in enumerate(dict.fromkeys(y))}
            tiles = decontaminate.tile([number.get(w, 0) for w in x], [number[w] for w in y])
            if sum(t[2] for t in tiles) >= threshold * len(y):
                out.add((d, i))
    return out


def templated(n, rng, words):
    return [(i, "what is the most likely answer to this question about " + " ".join(rng.choice(words) for _ in range(16))) for i in range(n)]


def test_template_seeds_give_the_same_leaks():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    items = templated(150, rng, words)
    texts = ["some words before " + " ".join(item.split()[:12] + [rng.choice(words) for _ in range(200)]) for _, item in items[:20]]
    texts += [f"{' '.join(rng.choice(words) for _ in range(9))} {item} tail" for _, item in items[20:30]]
    texts += [" ".join(item.split()[9:] + ["x"] + item.split()[:9]) for _, item in items[30:40]]
    texts += ["", "what is the most", " ".join(items[0][1].split()[:8])]
    index = decontaminate.Index(items)
    got = {(d, x[0]) for d, found in enumerate(index.leaks(texts, 0.8)) for x in found}
    assert got == plain_leaks(items, texts, 0.8) and len(got) >= 20


def test_known_words_without_a_shared_seed():
    """A batch in which every window of known words is unknown as a window."""
    index = decontaminate.Index([(1, "one two three four five six seven"), (2, "a b")])
    assert index.leaks(["six five four three two one seven " * 3, "one two", "", None], 0.8) == [[], [], [], []]


def test_many_items_of_one_template_are_quick():
    rng = random.Random(9)
    words = [f"w{k}" for k in range(5000)]
    items = templated(100_000, rng, words)
    index = decontaminate.Index(items)
    texts = ["what is the most likely answer to this question about " + " ".join(rng.choice(words) for _ in range(60)) for _ in range(99)] + [items[77][1]]
    began = time.perf_counter()
    got = index.leaks(texts, 0.8)
    assert time.perf_counter() - began < 20
    assert [d for d, found in enumerate(got) if found] == [99] and [x[0] for x in got[99]] == [77]


def test_a_star_of_links_is_split(spark):
    """Half of all links lead to one node; hot nodes' minima are broadcast, components stay the same."""
    rng = np.random.default_rng(4)
    pairs = [(1, int(k)) for k in range(2, 1500)] + [(int(a), int(b)) for a, b in rng.integers(2000, 6000, (1500, 2))]
    edges = spark.createDataFrame(pairs, "a long, b long")
    want = sorted(map(tuple, components(edges).collect()))
    assert sorted(map(tuple, components(edges, hot_rows=100).collect())) == want
    assert sum(c == 1 for _, c in want) == 1499


def test_hot_blocks_are_split(spark):
    """A block key with most of the fingerprints: its size goes to its rows, not its rows to one task."""
    rng = np.random.default_rng(6)
    base = int(rng.integers(1 << 62))
    prints = {base ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 30, (400, 3))} | {int(x) for x in rng.integers(0, 1 << 62, 300)}
    fps = spark.createDataFrame([(f, i) for i, f in enumerate(sorted(prints))], "fp long, id long")
    want = sorted(map(tuple, components(simhash.links(fps)).collect()))
    got = simhash.links(fps, chunk=64, hot_rows=50)
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, components(got).collect())) == want


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 3)
    rows = [(k, f"{'abc xyz' if k % 2 else 'klm nop'} text {k}", f"l{k % 2}") for k in range(40)] + [(100 + k, f"odd {k}", f"dirty{k}") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.langs) == 3 and {"l0", "l1"} < set(model.langs)
    got = langid.identify(docs, model).select(F.count_if(F.col("lang_pred").isin(model.langs))).first()[0]
    assert got == 70


def test_long_texts_without_spaces_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 100)
    text = "wort-" * 200
    pieces = [piece for _, piece in langid.blocks(text)]
    assert "".join(pieces) == text and len(pieces) > 1 and all(p.endswith("-") for p in pieces)
    assert "".join(p for _, p in langid.blocks("a" * 1000)) == "a" * 1000
