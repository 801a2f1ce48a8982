"""Cases that once crashed, hid or lost something: odd tokens, keys and white space, labels and samples."""

from __future__ import annotations

import base64
import json
import random
import time

import numpy as np
import pytest

from skeinlake.llm import common, fm, secrets, toxicity


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x82, n >> 8, n & 255])
    return bytes([tag]) + size + body


def b64(data):
    return base64.b64encode(data).decode()


ED25519 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2b\x65\x70")) + der(4, der(4, bytes(range(32)))))
RSA = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([1, *random.Random(k).randbytes(40)])) for k in range(8)))
PUBLIC = der(0x30, der(0x30, der(6, b"\x2b\x65\x70")) + der(3, bytes(33)))


def field(x):
    return len(x).to_bytes(4, "big") + x


OPENSSH = secrets.MAGIC + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 51) + field(b"s" * 136)


def kinds(text):
    return [k for _, _, k in secrets.all_spans(text)[1]]


def test_deeply_nested_token_headers_are_not_confirmed():
    deep = '{"a":' + "[" * 200_000
    token = base64.urlsafe_b64encode(deep.encode()).decode().rstrip("=") + ".e30.c2ln"
    assert kinds(token) == []
    assert secrets.redact_text(token) == token


def test_public_keys_are_not_secrets():
    assert kinds("public " + b64(PUBLIC)) == []
    line = "ssh-ed25519 " + b64(field(b"ssh-ed25519") + field(bytes(32)))
    assert kinds(line) == ["ssh"] and secrets.redact_text(f"{line} me@host") == f"{line} me@host"


@pytest.mark.parametrize("key", [ED25519, RSA, OPENSSH])
@pytest.mark.parametrize(("before", "after"), [("https://host/a/", ""), ("/some+path_", " end"), ("x/y-", "/tail/of/it"), ("", "/tail")])
def test_keys_inside_longer_runs(key, before, after):
    text = f"see {before}{b64(key)}{after}"
    (span,) = [s for s in secrets.added_spans(text)]
    cut = text[span[0] : span[1]]
    assert span[2] == "der" and b64(key).rstrip("=")[4:-4] in cut
    assert b64(key)[10:30] not in secrets.redact_text(text)


def test_runs_with_many_starts_take_little_time():
    started = time.perf_counter()
    for text in ("MIIEpAIBAA" * 100_000, "MC" * 500_000, "b3BlbnNzaC1rZXktdjEA" * 50_000, "MIP//wIBAA" * 100_000):
        secrets.added_spans(text)
    assert time.perf_counter() - started < 60


def test_encrypted_pem_with_header_lines():
    body = b64(random.Random(3).randbytes(160))
    pem = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123ABCD\n\n{body}\n-----END RSA PRIVATE KEY-----"
    for text in (pem, json.dumps({"k": pem})):
        assert kinds(text) == ["pem"] and body[20:60] not in secrets.redact_text(text)
    assert kinds(pem.replace("DEK-Info", "DEK-Inf0")) == []


def test_white_space_of_any_kind_parts_words():
    plain = toxicity.sentences("you are a very nice person")
    for blank in ("\t", "\r", " ", " ", "\x0b", " \t "):
        assert toxicity.sentences(blank.join("you are a very nice person".split())) == plain


def test_labels_above_zero_count_as_one(spark):
    rows = [(i, ("good words here " if i % 2 else "bad ones there ") * 20) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = []
    for low, high in ((0, 1), (-1, 2)):
        labels = spark.createDataFrame([(i, high if i % 2 else low) for i, _ in rows], "doc_id long, quality int")
        scores.append([r.score for r in fm.score(docs, fm.fit(docs, labels, "quality")).orderBy("doc_id").collect()])
    assert np.allclose(*scores)
    only = fm.fit(docs, spark.createDataFrame([(1, 1), (3, 2)], "doc_id long, quality int"), "quality")
    assert {round(r.score, 6) for r in fm.score(docs, only).collect()} == {0.75}


def test_fitting_samples_are_bounded(spark):
    """An id with very many rows gives a few texts; a group's texts stop at its characters; nulls are kept."""
    rows = [(1, f"text {i}") for i in range(500)] + [(1, "same")] * 500 + [(k, "w" * 100) for k in range(2, 40)] + [(50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1) for i in [1, *range(2, 40), 50]] * 3, "doc_id long, quality int")
    known, got = common.labelled_sample(docs, labels, "quality", 10_000, "doc_id", "text")
    assert (got.doc_id == 1).sum() == common.TEXTS_PER_ID and len(got) == common.TEXTS_PER_ID + 39 and got.text.isna().sum() == 1
    few = common.bounded_texts(docs.join(labels.distinct(), "doc_id"), "quality", "doc_id", "text", chars=1000).toPandas()
    assert few.text.fillna("").str.len().sum() <= 1000 and few.text.dropna().isin([t for _, t in rows]).all()


def test_drop_toxic_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "fine words", "a", 2)], "doc_id long, text string, Score string, _score int")
    kept = toxicity.drop_toxic(docs, toxicity.train(["fine words", None], np.array([False, False])))
    assert kept.columns == docs.columns and kept.first() == (1, "fine words", "a", 2)


def test_redact_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "x password=hunter22 y", "a", "b")], "doc_id long, text string, New string, `__text` string")
    kept = secrets.redact(docs)
    assert kept.columns == docs.columns and kept.first() == (1, "x <assign-removed> y", "a", "b")
