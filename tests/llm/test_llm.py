"""The corpus operators against plain-Python versions, round trips, held-out accuracy and edge cases."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from skeinlake.llm import decontaminate, fm, langid, packing, quality_rules, secrets, sharding, simhash, token_rollup, toxicity
from skeinlake.llm.components import components
from tests.llm.test_near_copies import plain_near

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and blank texts, ties, repeated rows, unusual characters.
EDGES = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \n\t ", "en", "s", 4),
    (4, "same words here again", "en", "s", 21),
    (5, "same words here again", "en", "s", 21),
    (5, "same words here again", "en", "s", 21),
    (None, "a row without an id", "de", None, None),
    (7, "İstanbul Ünï 漢字 \U0001f600 <|endoftext|> 123", None, "s", 1),
    (8, "x" * 5000, "fr", "s", 5000),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def documents(spark, data_dir):
    return spark.read.parquet(f"{data_dir}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


def clashing(df):
    """The same rows with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    for name in ("score", "fp", "id", "g", "range", "length", "part", "bucket", "leaks"):
        df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 1 language identification


def test_langid_learns_and_holds_out(spark, documents):
    from pyspark.sql import functions as F

    got = langid.op1_query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == 1000 and len(held) > 100
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()


@pytest.fixture(scope="module")
def lang_model(documents):
    return langid.fit(documents)


def test_viterbi_against_all_paths(lang_model):
    from itertools import product

    rng = np.random.default_rng(1)
    for _ in range(60):
        n, k, penalty = int(rng.integers(1, 6)), int(rng.integers(1, 4)), float(rng.choice([0.5, 2, 5]))
        score = rng.normal(0, 2, (n, k))

        def worth(p, score=score, penalty=penalty):
            return sum(score[i, x] for i, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:], strict=False))

        best = max(map(worth, product(range(k), repeat=n)))
        model = langid.Model(list("abc")[:k], None, None, penalty)
        assert worth(langid.viterbi(score, penalty)) == pytest.approx(best)
        assert worth(model.path(score)) == pytest.approx(best)


def test_langid_spans_of_mixed_text(documents, lang_model, texts):
    langs = {r.doc_id: r.lang for r in documents.collect()}
    pick = {}
    for i, t in texts.items():
        if len(t.split()) > 150 and langs[i] not in pick and "%%" not in t and "!!" not in t:
            pick[langs[i]] = " ".join(t.split()[:120])
    a, b = pick["en"], pick["de"]
    found = lang_model.spans(a + " " + b)
    assert [s[2] for s in found] == ["en", "de"]
    assert abs(found[1][0] - len(a)) < 40


def test_langid_scripts_narrow_candidates():
    table = np.zeros((3 << langid.BITS, 2), np.float32)
    scripts = np.zeros((len(langid.SCRIPTS) + 1, 2), bool)
    scripts[1, 0] = scripts[3, 1] = True
    model = langid.Model(["en", "ru"], table, scripts, 12.0)
    assert model.predict("просто слова")[0] == "ru"
    assert model.predict("plain words")[0] == "en"
    assert [s[2] for s in model.spans("plain words просто слова")] == ["en", "ru"]


def test_langid_edges(spark, edges, lang_model):
    got = langid.identify(clashing(edges), lang_model).collect()
    assert len(got) == len(EDGES)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3))
    assert by[8].lang_pred in lang_model.langs
    assert langid.identify(empty(spark), lang_model).count() == 0
    assert langid.fit(empty(spark)).predict("abc") == ("und", 0.0, 0, 0)


def test_langid_blocks_cover_long_texts(lang_model, monkeypatch):
    text = "the and of with this that " * 60
    whole = lang_model.words(text)
    monkeypatch.setattr(langid, "BLOCK", 100)
    cut = lang_model.words(text)
    assert all(np.allclose(a, b) for a, b in zip(whole, cut, strict=True))


# --- 2 secret scan


def base_by_contract(text):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for order, kind, pattern, least in ((1, "access", r"AKIA[A-Z0-9]+", 20), (2, "hex", r"[0-9a-f]+", 24)):
        for m in re.finditer(pattern, text):
            if len(m[0]) >= least:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_secrets_base_equals_contract(spark, edges):
    sample = ["token=token: abcdefg", "API_KEY='abcdef1' passwd: x", "AKIA" + "A" * 16, "ab" * 12, "Secret == abc123", "toKen=ſecret"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(sample)], "doc_id long, text string"))
    got = {r.doc_id: r for r in secrets.scan(rows).collect()}
    found = 0
    for r in rows.collect():
        want = base_by_contract(r.text or "")
        found += bool(want)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (got[r.doc_id].n_assign, got[r.doc_id].n_access, got[r.doc_id].n_hex) == tuple(want.count(k) for k in ("assign", "access", "hex"))
    assert found > 8


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x82, n >> 8, n & 255])
    return bytes([tag]) + size + body


def test_secrets_structure():
    rng = random.Random(5)
    number = lambda n: der(2, bytes([1, *(rng.randrange(256) for _ in range(n))]))
    pkcs1 = der(0x30, der(2, b"\0") + number(64) + number(3) + b"".join(number(32) for _ in range(6)))
    sec1 = der(0x30, der(2, b"\1") + der(4, bytes(32)))
    spki = der(0x30, der(0x30, der(6, b"\x2a\x03")) + der(3, bytes(33)))
    pkcs8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x03")) + der(4, pkcs1))
    for key in (pkcs1, sec1, spki, pkcs8):
        assert secrets.is_der_key(key)
        assert not secrets.is_der_key(key[:-1]) and not secrets.is_der_key(key + b"\0")
    b64 = lambda b: base64.b64encode(b).decode()
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{b64(pkcs1)}\n-----END RSA PRIVATE KEY-----"
    url = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    jwt = f"{url({'alg': 'HS256'})}.{url({'sub': 1})}.c2ln"
    field = lambda x: len(x).to_bytes(4, "big") + x
    ssh = "ssh-ed25519 " + b64(field(b"ssh-ed25519") + field(bytes(32)))
    text = f"see {pem} and {jwt} and {ssh} and {b64(pkcs8)} and {pkcs1.hex()}"
    kinds = Counter(k for _, _, k in secrets.all_spans(text)[1])
    assert (kinds["pem"], kinds["jwt"], kinds["ssh"], kinds["der"]) == (1, 1, 1, 2)
    again = f"x {b64(pem.encode())} y {jwt.encode().hex()} z"
    assert [k for _, _, k in secrets.added_spans(again)] == ["pem", "jwt"]
    for bad in (pem.replace("MII", "MIJ", 1), f"{url({'typ': 'x'})}.{url({})}.s", "ssh-rsa " + b64(field(b"ssh-dss") + b"\0\0"), "A" * 80, "ab" * 40):
        assert not secrets.added_spans(bad)
    assert "removed" in secrets.redact_text(text) and "BEGIN" not in secrets.redact_text(text)


def test_secrets_edges(spark, edges):
    got = secrets.scan(clashing(edges)).collect()
    assert len(got) == len(EDGES) and all(r.spans == "" for r in got)
    assert {r.base_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert secrets.scan(empty(spark)).count() == 0
    kept = secrets.redact(clashing(edges))
    assert kept.columns == clashing(edges).columns and kept.count() == len(EDGES)
    dirty = spark.createDataFrame([(1, "x password=hunter22 y", "en", "s", 21)], SCHEMA)
    assert secrets.redact(dirty).first() == (1, "x <assign-removed> y", "en", "s", 20)


# --- 3 packing


def check_packed(got, texts, window=1024):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(docs) == set(texts)
    for i, t in texts.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(docs[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rows in seqs.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return len(seqs)


def test_packing_round_trip(documents, texts):
    got = packing.pack(documents).collect()
    n = check_packed(got, texts)
    tokens = sum(r.length for r in got)
    assert tokens > 0.99 * 1024 * n


def best_fit_one_by_one(lengths, window):
    """Best-fit decreasing, one piece at a time: the multiset of windows' contents."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [x for x in rooms if window - sum(x) >= n]
        best = min(fits, key=lambda x: window - sum(x), default=None)
        if best is None:
            rooms.append(best := [])
        best.append(n)
    return Counter(tuple(x) for x in rooms)


@pytest.mark.parametrize("seed", range(25))
def test_packing_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    window = rng.choice([8, 16, 50])
    lengths = [rng.randint(1, window) if rng.random() < 0.7 else rng.choice([2, 3, window // 2]) for _ in range(rng.randint(0, 120))]
    steps = packing.plan(Counter(lengths), window)
    rooms = defaultdict(list)
    ranks = defaultdict(set)
    for length, rank, n, first, base, per in steps:
        for r in range(n):
            rooms[first + r // per].append((base + r % per * length, length))
            ranks[length].add(rank + r)
    assert {k: v for k, v in ranks.items()} == {k: set(range(n)) for k, n in Counter(lengths).items()}
    for got in rooms.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= window
    fill = lambda c: Counter(sum(k) for k in c.elements())
    mine = Counter(tuple(n for _, n in sorted(x)) for x in rooms.values())
    assert fill(mine) == fill(best_fit_one_by_one(lengths, window))


def test_packing_edges(spark, edges):
    rows = [r for r in EDGES if r[0] not in (5, None)]
    check_packed(packing.pack(clashing(spark.createDataFrame(rows, SCHEMA))).collect(), {r[0]: r[1] for r in rows})
    assert packing.pack(empty(spark)).count() == 0
    got = packing.pack(edges).collect()
    assert sum(r.doc_id == 5 for r in got) == 2 and sum(r.doc_id is None for r in got) == 1


def test_both_tokenizer_libraries_agree():
    import public_tokenizers
    from tokenizers import Tokenizer

    exact, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder()
    points = [c for c in [*range(0x3100), *range(0x3100, 0x110000, 97)] if not 0xD800 <= c < 0xE000]
    for c in map(chr, points):
        t = f"a{c} b {c}c 1{c}2{c}{c} !{c}? {c}"
        assert encode(t).tolist() == exact.encode(t, add_special_tokens=False).ids, hex(ord(c))
    t = "before <|endoftext|> after"
    assert encode(t).tolist() == exact.encode(t, add_special_tokens=False).ids


# --- 4 SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs):
    """{(id, fingerprint)} -> {id: smallest id within reach}."""
    up = {i: i for i, _ in pairs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, x in pairs:
        for b, y in pairs:
            if a < b and (x ^ y).bit_count() <= 4:
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i, _ in pairs}


def test_simhash_query_against_brute_force(spark, texts, data_dir):
    prints = [(i, plain_fingerprint(t)) for i, t in texts.items()]
    want = plain_components(prints)
    got = simhash.op4_query(spark, data_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{x:016x}", want[i]) for i, x in prints}


def planted_prints(seed, n=300):
    """Chains, dense clouds and strangers."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        x = rng.getrandbits(64)
        out.append(x)
        for _ in range(rng.choice([0, 0, 3, 40])):
            for b in rng.sample(range(64), rng.choice([1, 2, 4, 5])):
                x ^= 1 << b
            out.append(x)
            if rng.random() < 0.5:
                x = out[-2]
    return sorted({x: None for x in out})


@pytest.mark.parametrize(("chunk", "blocks"), [(4096, 5), (16, 5), (7, 6)])
def test_simhash_links_connect_exactly_what_is_near(spark, monkeypatch, chunk, blocks):
    monkeypatch.setattr(simhash, "blocks_for", lambda n, bound: blocks)
    prints = list(enumerate(planted_prints(chunk)))
    fps = spark.createDataFrame([(simhash.signed(x), i) for i, x in prints], "fp long, id long")
    edges = simhash.links(fps, 4, chunk)
    by = dict(prints)
    assert all((by[r.a] ^ by[r.b]).bit_count() <= 4 for r in edges.collect())
    found = {r.node: r.component for r in components(edges).collect()}
    assert {i: found.get(i, i) for i, _ in prints} == plain_components(prints)


@pytest.mark.parametrize("n", [1, 2, 33, 400, 1000])
def test_gray_index_finds_every_pair(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, max(1, n // 5), dtype=np.uint64)
    fps = np.unique(np.array([b ^ np.uint64(1 << int(rng.integers(64))) for b in rng.choice(base, n)], np.uint64))
    got = {(int(a), int(b)) for x, y in simhash.GrayIndex(fps).links(fps, 4, step=512) for a, b in zip(x, y, strict=True)}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)}


def test_gray_rank_is_gray_order():
    codes = np.array([i ^ (i >> 1) for i in range(256)], np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(256))


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(100, 100 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*path, *star, (7, 7), (3, 2)], "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_edges(spark, edges):
    got = simhash.near_duplicates(clashing(edges)).collect()
    assert len(got) == len(EDGES)
    by = {r.doc_id: r for r in got}
    assert {by[i].component_id for i in (1, 2, 3)} == {1} and by[1].fp == 0
    assert by[4].component_id == by[5].component_id == 4
    assert simhash.near_duplicates(empty(spark)).count() == 0


# --- 5 token rollup


def test_rollup_query_against_sql(spark, data_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{data_dir}/{t}.parquet'")
    cols = ["source", "lang", "tokenizer", "n_docs", "n_tokens"]
    want = con.execute(f"select {', '.join(cols)} from ({token_rollup.OP5_SQL})").fetchall()
    got = token_rollup.op5_query(spark, data_dir).select(*cols).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_rollup_equals_replay_and_is_idempotent(spark, tmp_path):
    rng = random.Random(3)
    rollup, state = token_rollup.TokenRollup(spark, f"file://{tmp_path}"), {}
    schema = "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long, change_no long"
    for b in range(4):
        batch = [(rng.choice(["insert", "revise", "delete"]), rng.randrange(12), rng.choice(["a", "b", None]), rng.choice(["en", None]), "t1", rng.choice([None, 3, 7]), k) for k in range(10)]
        frame = spark.createDataFrame([*batch, batch[0], ("insert", None, "a", "en", "t1", 5, 0)], schema)
        assert rollup.commit(f"b/{b}", frame)
        last = {}
        for row in batch:
            last[row[1]] = row
        for i, (op, _, source, lang, _, n, _) in last.items():
            state.pop(i, None)
            if op != "delete":
                state[i] = (source, lang, "t1", n or 0)
        assert not rollup.commit(f"b/{b}", spark.createDataFrame([("insert", 99, "z", "z", "z", 1, 0)], schema))
        want = defaultdict(lambda: [0, 0])
        for source, lang, v, n in state.values():
            want[source, lang, v][0] += 1
            want[source, lang, v][1] += n
        got = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in rollup.totals().collect()}
        assert got == want
    assert rollup.commit("none", spark.createDataFrame([], schema))
    assert len(rollup.commits()) == 5


def test_rollup_ignores_batches_without_a_marker(spark, tmp_path):
    rollup = token_rollup.TokenRollup(spark, f"file://{tmp_path}")
    frame = spark.createDataFrame([("insert", 1, "a", "en", "t", 5)], "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long")
    assert rollup.totals().count() == 0 and rollup.commit("x", frame)
    import shutil

    shutil.rmtree(tmp_path / "commits")
    assert rollup.totals().count() == 0 and rollup.commit("x", frame)
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "t", 1, 5)]


def test_bpe_counts(spark, edges):
    got = {r.doc_id: r.n_tokens for r in token_rollup.bpe_counts(edges).collect()}
    assert got[1] == got[2] == 0 and got[4] == len(packing.encoder()("same words here again"))


# --- 6 decontamination


def plain_tiles(text, item, least):
    """Greedy string tiling by trying every pair of places; tiled length."""
    ut, ui, total = [x == 0 for x in text], [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for t in range(len(text)):
            for p in range(len(item)):
                k = 0
                while t + k < len(text) and p + k < len(item) and not ut[t + k] and not ui[p + k] and text[t + k] == item[p + k]:
                    k += 1
                best = max(best, (k, -p, -t))
        k, p, t = best[0], -best[1], -best[2]
        if k < least:
            return total
        ut[t : t + k] = ui[p : p + k] = [True] * k
        total += k


@pytest.mark.parametrize("seed", range(40))
def test_tiles_against_plain_greedy_tiling(seed):
    rng = random.Random(seed)
    item = [rng.randint(1, 40) for _ in range(rng.randint(5, 60))]
    a, b = sorted(rng.sample(range(len(item) + 1), 2))
    text = [rng.randint(0, 60) for _ in range(10)] + item[b:] + [0] + item[a:b] + [rng.randint(0, 60) for _ in range(5)] + item[:a]
    tiles = decontaminate.tile(text, item)
    used_t, used_i = Counter(), Counter()
    for t, p, k in tiles:
        assert k >= decontaminate.TILE and text[t : t + k] == item[p : p + k] and 0 not in text[t : t + k]
        used_t.update(range(t, t + k))
        used_i.update(range(p, p + k))
    assert max([0, *used_t.values(), *used_i.values()]) <= 1
    assert abs(sum(k for _, _, k in tiles) - plain_tiles(text, item, decontaminate.TILE)) <= decontaminate.TILE


def test_decontamination_query_against_brute_force(spark, documents, data_dir, texts):
    items = {r.item_id: decontaminate.tokens(r.text) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.op6_query(spark, data_dir).collect()}
    want = set()
    for i, t in texts.items():
        words = decontaminate.tokens(t)
        grams = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        for j, item in items.items():
            shared = sum(tuple(item[k : k + 5]) in grams for k in range(len(item) - 4))
            if shared and shared >= 0.8 * (len(item) - 4):
                want.add((i, j))
    assert want and want <= set(got) and all(0.8 <= c <= 1 for c in got.values())
    assert len(got) <= len(want) + 2


def test_decontamination_catches_reordered_and_edited(spark):
    rng = random.Random(2)
    item = [f"w{rng.randrange(5000)}" for _ in range(40)]
    turned = item[25:] + ["x"] + item[:25]
    edited = [w if k % 9 else "changed" for k, w in enumerate(item)]
    half = item[:18]
    rows = [(1, " ".join(turned)), (2, "Intro, " + ". ".join(w.upper() for w in item)), (3, " ".join(edited)), (4, " ".join(half)), (5, None), (None, " ".join(item))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, "too short"), (13, "")], "item_id long, text string")
    got = decontaminate.find_leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 10), (2, 10), (3, 10), (None, 10)}
    blocks = decontaminate.find_leaks(docs, bench, block_chars=50).collect()
    assert sorted(map(str, got)) == sorted(map(str, blocks))
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {4, 5}
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_decontamination_edges(spark, edges):
    bench = spark.createDataFrame([(1, "nothing of this kind is there at all")], "item_id long, text string")
    assert decontaminate.find_leaks(clashing(edges), bench).count() == 0
    assert decontaminate.drop_leaks(clashing(edges), bench).count() == len(EDGES)
    assert decontaminate.find_leaks(empty(spark), bench).count() == 0


# --- 7 toxicity


def plain_kernel(s, t, order, decay):
    """The sum over all pairs of equal subsequences, straight from the definition."""
    from itertools import combinations

    def spans(x):
        out = defaultdict(float)
        for at in combinations(range(len(x)), order):
            out[tuple(x[i] for i in at)] += decay ** (at[-1] - at[0] + 1)
        return out

    a, b = spans(s), spans(t)
    return sum(v * b[k] for k, v in a.items() if k in b)


def test_subsequence_kernel_against_definition():
    words = ["^idiot", "^idxiot", "banana", "abc", "^i", "aaaaaa", "tooidi"]
    for order in (1, 2, 3, 4):
        for s in words:
            for t in words:
                got = toxicity.subsequence_kernel(toxicity.encode([s, "longer-one"], 0)[:1], toxicity.encode([t, "another-long-one"], 1)[:1], order)[0]
                assert got == pytest.approx(plain_kernel(s, t, order, toxicity.DECAY), rel=1e-4, abs=1e-7)


def test_kernel_skips_only_zero_pairs():
    landmarks = ["^idiot", "^banana", "^loser"]
    words = ["^tidiot", "^ban", "^xyz", "^nabnaana", "^solers", "^idiots"]
    got = toxicity.Kernel(landmarks)(words)
    for i, w in enumerate(words):
        for j, z in enumerate(landmarks):
            k = [plain_kernel(a, b, toxicity.ORDER, toxicity.DECAY) for a, b in ((w, z), (w, w), (z, z))]
            want = (k[0] / (k[1] * k[2]) ** 0.5) ** toxicity.POWER if k[1] else 0.0
            assert got[i, j] == pytest.approx(want, rel=1e-3, abs=1e-6)


@pytest.fixture(scope="module")
def insults():
    rng = random.Random(4)
    plain = [rng.choice("bcdfgklmnprstv") + rng.choice("aeiou") + rng.choice("bdfglmnr") + rng.choice("aeiou") + rng.choice("lnrst") for _ in range(300)]
    bad = ["wretch", "dimwit", "oafish"]

    def doc(toxic):
        out = []
        for _ in range(rng.randint(3, 8)):
            s = [rng.choice(plain) for _ in range(rng.randint(4, 10))]
            if toxic and (not out or rng.random() < 0.3):
                s.insert(rng.randrange(len(s)), rng.choice(bad))
            out.append(" ".join(s) + ".")
        return " ".join(out)

    labels = np.array([i % 3 == 0 for i in range(400)])
    return [doc(y) for y in labels], labels


def test_toxicity_tolerates_gaps_and_insertions(insults):
    texts, labels = insults
    model = toxicity.train(texts[:300], labels[:300])
    scorer = model.scorer()
    got = scorer.score(texts[300:]) >= 0.5
    assert (got == labels[300:]).mean() > 0.97
    clean = "balon radel gamus."
    for form in ("dimwit", "d.i.m.w.i.t", "d i m w i t", "dim-wit", "dimxwit", "DIMWIT!", "dimwits"):
        assert scorer.score([f"{clean} balon {form} radel"])[0] > scorer.score([f"{clean} balon radel"])[0] + 0.1, form


def test_toxicity_does_not_depend_on_batches(insults):
    texts, labels = insults
    model = toxicity.train(texts[:200], labels[:200])
    whole = model.scorer().score(texts)
    one = model.scorer()
    assert np.allclose(whole, np.concatenate([one.score([t]) for t in texts]))


def test_toxicity_held_out(spark):
    got = toxicity.op7_query(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    held = got[got.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert held[held.toxic == 1].predicted.mean() > 0.8
    assert held[held.toxic == 0].predicted.mean() < 0.01


def test_toxicity_edges(spark, edges, insults):
    texts, labels = insults
    model = toxicity.train(texts[:200], labels[:200])
    got = toxicity.score(clashing(edges), model).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.drop_toxic(clashing(edges), model, 2.0)
    assert kept.count() == len(EDGES) and set(kept.columns) == set(clashing(edges).columns)
    assert toxicity.score(empty(spark), model).count() == 0
    none = toxicity.train([], np.zeros(0, bool))
    assert none.scorer().score(["a", None, ""]).tolist() == pytest.approx([0.5] * 3)
    one = toxicity.train(["fine words", None], np.array([False, False]))
    assert one.scorer().score(["x"])[0] == pytest.approx(0.25)
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(edges, no_labels).landmarks == []


# --- 8 sharding


def check_shards(rows, texts, shards=8, slack=None):
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(0 <= s < shards for s in sizes)
    total = sum(sizes.values())
    largest = max((r.size for r in rows), default=0)
    slack = largest if slack is None else slack
    assert all(abs(sizes[s] - total / shards) <= 2 * slack for s in range(shards))


def test_sharding_query(spark, data_dir, texts):
    got = sharding.op8_query(spark, data_dir).collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    groups = defaultdict(int)
    for r in got:
        groups[texts[r.doc_id]] += r.size
    check_shards(got, texts, slack=max(groups.values()))


@pytest.mark.parametrize("hot", [0, 1000])
def test_sharding_hot_group_and_small_ranges(spark, monkeypatch, hot):
    monkeypatch.setattr(sharding, "LEAST_RANGES", 32)
    monkeypatch.setattr(sharding, "OVERFULL", 1)
    rows = [(i, f"text {i // 3} " + "y" * (i % 50)) for i in range(2000)] + [(5000 + i, "the same everywhere") for i in range(hot)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    assert len(got) == len(rows)
    check_shards(got, None, slack=max(300, 0))
    homes = defaultdict(set)
    text = dict(rows)
    for r in got:
        homes[text[r.id]].add(r.shard)
    assert all(len(v) == 1 for k, v in homes.items() if k != "the same everywhere")


def test_sharding_edges(spark, edges):
    got = sharding.shard(clashing(edges)).collect()
    assert len(got) == len(EDGES)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {r.size for r in got if r.id in (1, 2)} == {1} and {r.crc for r in got if r.id == 1} == {0}
    assert sharding.shard(empty(spark)).count() == 0


def test_write_shards(spark, documents, tmp_path):
    sharding.write_shards(documents, f"file://{tmp_path}/out", 4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == documents.count() and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


# --- 9 quality rules


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    seen = {k + d for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(seen)


def test_quality_query_base(spark, texts, data_dir):
    got = {r.doc_id: r for r in quality_rules.op9_query(spark, data_dir).collect()}
    for i, t in texts.items():
        r, want = got[i], plain_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_counts_on_odd_texts(spark):
    odd = ["a b c a b c", "a a a a a", "a a a", "x y", "", None, "\x0b\x0c a b \x85 c", " lead  and trail \n\n lead  and trail ", "é😀 <|> é😀 <|> é😀 <|>", "a b c d a b c e a b c", "\n \n \n"]
    rows = spark.createDataFrame(list(enumerate(odd)), "doc_id int, text string")
    got = {r.id: r for r in quality_rules.features(rows).collect()}
    for i, t in enumerate(odd):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(t), t


def test_quality_posterior_follows_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("quality", "label")
    got = quality_rules.op9_query(spark, "/root/testdata/sf0.01").join(labels, "doc_id").toPandas()
    got = got[~got.base_failed]
    assert got[got.label == 1].kept.mean() > 0.99 and got[got.label == 0].kept.mean() < 0.05


def test_estimate_recovers_planted_rules():
    rng = random.Random(1)
    ways, on_good, on_bad = [-1, -1, -1, 1, 1], [0.02, 0.05, 0.03, 0.9, 0.8], [0.6, 0.4, 0.5, 0.2, 0.3]
    rows, truth = [], []
    for _ in range(6000):
        good = rng.random() < 0.8
        rows.append(tuple(w if rng.random() < (g if good else b) else 0 for w, g, b in zip(ways, on_good, on_bad, strict=True)))
        truth.append(good)
    prior, chance = quality_rules.estimate(sorted(Counter(rows).items()), ways)
    assert prior == pytest.approx(0.8, abs=0.05)
    for (g, b), eg, eb in zip(chance, on_good, on_bad, strict=True):
        assert g == pytest.approx(eg, abs=0.05) and b == pytest.approx(eb, abs=0.1)
    right = sum((quality_rules.posterior(r, prior, chance) >= 0.5) == t for r, t in zip(rows, truth, strict=True))
    assert right > 0.93 * len(rows)


def test_quality_edges(spark, edges):
    got = quality_rules.judge(clashing(edges)).collect()
    assert len(got) == len(EDGES) and all(0 <= r.quality <= 1 for r in got)
    assert quality_rules.judge(empty(spark)).count() == 0


# --- 10 factorisation machine


def test_fm_score_equals_all_pairs():
    model = fm.FactorisationMachine(seed=1, size=50)
    rng = np.random.default_rng(2)
    model.w0, model.w, model.v = 0.3, rng.normal(size=50), rng.normal(size=(50, fm.FACTORS))
    feats, vals = rng.permutation(50)[:12], rng.normal(size=12)
    want = 0.3 + model.w[feats] @ vals + sum(model.v[feats[i]] @ model.v[feats[j]] * vals[i] * vals[j] for i in range(12) for j in range(i))
    assert model.raw(np.zeros(12, np.int64), feats, vals, 1)[0][0] == pytest.approx(want)


def test_fm_learns_an_interaction():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (3000, 2))
    rows, feats = np.repeat(np.arange(3000), 2), (bits + [0, 2]).ravel()
    y = (bits[:, 0] ^ bits[:, 1]).astype(float)
    model = fm.FactorisationMachine(size=4)
    model.fit((rows, feats, np.ones(6000)), y, epochs=60, rate=0.05)
    p = fm.sigmoid(model.raw(rows, feats, np.ones(6000), 3000)[0])
    assert ((p > 0.5) == (y > 0)).mean() > 0.95


def test_fm_held_out(spark):
    got = fm.op10_query(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert (held.predicted == held.quality).mean() > 0.97


def test_fm_edges(spark, edges):
    labels = spark.createDataFrame([(2, 0), (4, 1), (5, 1), (8, 0), (7, None), (None, 1)], "doc_id long, quality int")
    model = fm.fit(edges, labels, "quality")
    got = fm.score(clashing(edges), model).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert fm.score(empty(spark), model).count() == 0
    one = fm.fit(edges, labels.filter("quality = 1"), "quality")
    assert {round(r.score, 6) for r in fm.score(edges, one).collect()} == {round(4 / 5, 6)} or one.w0 > 0


# --- the pipeline


def test_pipeline_against_plain_stages(spark, data_dir, tmp_path):
    """Near copies are those of five words and a similarity of 0.8; public keys are listed, not redacted."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    columns, rows, kept = docs.columns, docs.collect(), {}
    for k, (name, stage) in enumerate(P.STAGES):
        path = f"file://{tmp_path}/{name}"
        stage(spark, docs, data_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < 4:
            assert docs.columns == columns
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
    start = {r.doc_id: r.text for r in rows}
    near, pairs = plain_near(kept["toxicity"])
    assert set(kept["toxicity"]) < set(start)
    assert pairs and set(kept["near_duplicates"]) == {i for i, c in near.items() if i == c}
    leaks = {r.doc_id for r in decontaminate.op6_query(spark, data_dir).collect()}
    assert leaks and set(kept["decontamination"]) == set(kept["near_duplicates"]) - leaks
    assert set(kept["secrets"]) == set(kept["decontamination"])
    for i, t in kept["secrets"].items():
        assert t == secrets.redact_text(start[i]) and not [s for s in secrets.all_spans(t)[1] if s[2] != "ssh"]
    check_packed(docs.collect(), kept["secrets"])
    assert sorted(map(tuple, P.run(spark, data_dir).select("doc_id", "start", "ids_crc32").collect())) == sorted((r.doc_id, r.start, r.ids_crc32) for r in docs.collect())


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages_on_edges(spark, edges, data_dir, k):
    import corpus_pipeline as P

    name, stage = P.STAGES[k]
    for docs in (edges, clashing(edges), empty(spark)):
        got = stage(spark, docs, data_dir)
        rows = got.collect()
        if k < 4:
            assert got.columns == docs.columns
            ids = [r.doc_id for r in rows]
            if docs.count():
                # Of the empty texts (1, 2, 3) and the equal ones (4, 5) near-duplicate removal keeps the first.
                gone = {2, 3, 5} if name == "near_duplicates" else set()
                assert sorted(map(str, ids)) == sorted(str(r[0]) for r in EDGES if r[0] not in gone)
        if not docs.limit(1).count():
            assert rows == []


# --- properties

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_PIECES = st.lists(st.sampled_from(["token", "API_KEY", "passwd", "=", ":", " ", "  ", '"', "'", "abc", "Zz9/+=", "AKIA", "AKIAB2", "0123456789abcdef", "deadbeef", ".", "\n", "é", "ſecret", "x" * 7]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(_PIECES)
def test_base_spans_equal_contract_on_any_text(text):
    assert secrets.join_spans(secrets.base_spans(text)) == base_by_contract(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "Éa", "\x85", "\x0b", " ", "\n", "word", "漢"]), max_size=60).map(" ".join))
def test_fingerprint_equals_contract_on_any_text(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=80, unique=True), st.integers(0, 6))
def test_gray_index_on_any_fingerprints(prints, bound):
    fps = np.array(prints, np.uint64)
    got = {(int(a), int(b)) for x, y in simhash.GrayIndex(fps).links(fps, bound, step=64) for a, b in zip(x, y, strict=True)}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bound
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)}


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_spans_lie_in_the_text(text):
    for a, b, _ in secrets.all_spans(text)[1]:
        assert 0 <= a < b <= len(text)
    assert toxicity.sentences(text) is not None and decontaminate.tokens(text) is not None
