"""Quality classification with a factorisation machine.

Features: hashed words (normalised frequencies), structure statistics of the text and metadata derived from it (its
size). A document's score is ``w0 + w.x + 1/2 * sum_f((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``: all pairwise
interactions in time linear in the features. The logistic loss is minimised with Adam on a bounded sample of labelled
documents; scoring is a map over all documents.

Defined edge results: null and empty texts have no words and are scored on their structure; without labels, or with one
class only, every score is the (smoothed) share of label 1; labels above 0 count as 1; texts of any length are read
whole; null ids keep their rows; repeated rows score alike; a label joins every row of its id; extra columns are not
read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_bucket, labelled_sample, map_rows

BUCKETS = 1 << 14
FACTORS = 8
UPPER, DIGIT, STOP, SYMBOL = (re.compile(p) for p in ("[A-ZÀ-ÖØ-Þ]", "[0-9]", "[.!?]", "[#*$%&|<>]"))
STRUCTURE = 14


def structure(text: str, words: list[str]) -> list[float]:
    """Statistics of one text, each scaled to about 0..1."""
    n, chars = max(len(words), 1), max(len(text), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    symbols, upper = len(SYMBOL.findall(text)), len(UPPER.findall(text))
    pairs = len(set(zip(words, words[1:], words[2:], strict=False)))
    windows = max(len(words) - 2, 1)
    return [
        1.0,
        min(np.log1p(len(text)) / 12, 2.0),
        min(len(text) / n / 12, 2.0),
        min(symbols / n, 1.0),
        min(8 * symbols / chars, 1.0),
        upper / chars,
        1.0 if upper > 0.3 * chars else 0.0,
        len(DIGIT.findall(text)) / chars,
        min(len(STOP.findall(text)) / n, 1.0),
        1 - len(set(lines)) / max(len(lines), 1),
        1 - pairs / windows if len(words) > 2 else 0.0,
        len(set(words)) / n,
        min(len(lines) / n, 1.0),
        min(text.count("!") / n, 1.0),
    ]


class Buckets(dict):
    """Word -> bucket, filled on demand and emptied when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        got = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return got


class Features:
    """Batch of texts -> sparse rows: (row index, feature index, value), features of a row being distinct."""

    def __init__(self):
        self.cache = Buckets()

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, feats, vals, cache = [], [], [], self.cache
        dense = np.zeros((len(texts), STRUCTURE))
        for i, text in enumerate(texts):
            text = text or ""
            words = text.lower().split()
            dense[i] = structure(text, words)
            if words:
                f, c = np.unique(np.array([cache[w] for w in words], np.int64), return_counts=True)
                v = np.sqrt(c)
                rows.append(np.full(len(f), i))
                feats.append(f)
                vals.append(v / np.sqrt((v * v).sum()))
        r, f = np.indices(dense.shape)
        return (
            np.concatenate([*rows, r.ravel()]).astype(np.int64),
            np.concatenate([*feats, f.ravel() + BUCKETS]).astype(np.int64),
            np.concatenate([*vals, dense.ravel()]),
        )


class FactorisationMachine:
    def __init__(self, seed: int = 7, size: int = BUCKETS + STRUCTURE):
        rng = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(size)
        self.v = rng.normal(0, 0.05, (size, FACTORS))

    def raw(self, rows: np.ndarray, feats: np.ndarray, vals: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of ``n`` rows, and the factor sums that the gradient needs."""
        vx = self.v[feats] * vals[:, None]
        sums = np.stack([np.bincount(rows, vx[:, k], n) for k in range(FACTORS)], 1)
        squares = np.bincount(rows, (vx * vx).sum(1), n)
        linear = np.bincount(rows, self.w[feats] * vals, n)
        return self.w0 + linear + 0.5 * ((sums * sums).sum(1) - squares), sums

    def fit(self, data, labels: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.02, decay: float = 1e-4, seed: int = 11) -> None:
        rows, feats, vals = data
        order = np.argsort(rows, kind="stable")
        rows, feats, vals = rows[order], feats[order], vals[order]
        starts = np.searchsorted(rows, np.arange(len(labels) + 1))
        rng = np.random.default_rng(seed)
        share = min(0.99, max(0.01, labels.mean()))
        self.w0 = float(np.log(share / (1 - share)))
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in (self.w, self.v)]
        t = 0
        for _ in range(epochs):
            shuffled = rng.permutation(len(labels))
            for k in range(0, len(labels), batch):
                pick, t = shuffled[k : k + batch], t + 1
                at = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in pick])
                local = np.repeat(np.arange(len(pick)), starts[pick + 1] - starts[pick])
                f, x = feats[at], vals[at]
                raw, sums = self.raw(local, f, x, len(pick))
                miss = (sigmoid(raw) - labels[pick]) / len(pick)
                used, inverse = np.unique(f, return_inverse=True)
                g = miss[local] * x
                gw = np.bincount(inverse, g, len(used)) + decay * self.w[used]
                gv = np.stack([np.bincount(inverse, g * (sums[local, k] - self.v[f, k] * x), len(used)) for k in range(FACTORS)], 1) + decay * self.v[used]
                self.w0 -= rate * float(miss.sum())
                for p, grad, (m, s) in zip((self.w, self.v), (gw, gv), state, strict=True):
                    m[used] = 0.9 * m[used] + 0.1 * grad
                    s[used] = 0.999 * s[used] + 0.001 * grad * grad
                    p[used] -= rate * (m[used] / (1 - 0.9**t)) / (np.sqrt(s[used] / (1 - 0.999**t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> FactorisationMachine:
    """Fit on about ``per_class`` documents of each label (the documented bound of the sample). Labels above 0 count as
    1, all others as 0."""
    known, rows = labelled_sample(docs, labels.withColumn(label_col, (F.col(f"`{label_col}`") > 0).cast("int")), label_col, per_class, id_col, text_col)
    shares = {r[0]: r[1] for r in known.groupBy(F.col(f"`{label_col}`")).count().collect()}
    model = FactorisationMachine()
    labels = rows[label_col].to_numpy(dtype=float)
    total = sum(shares.values())
    if len(set(labels)) < 2:
        share = (shares.get(1, 0) + 1) / (total + 2)
        model.w0, model.v[:] = float(np.log(share / (1 - share))), 0
        return model
    model.fit(Features()(rows[text_col].tolist()), labels)
    # The sample is balanced by class: move the intercept back to the shares among all labelled rows.
    seen = labels.mean()
    model.w0 += float(np.log(shares[1] / shares[0]) - np.log(seen / (1 - seen)))
    return model


def score(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability of label 1. Map-only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        features, m = Features(), shared.value
        return lambda texts: {"score": sigmoid(m.raw(*features(texts), len(texts))[0])}

    return map_rows(docs, [id_col], text_col, make, T.StructType([T.StructField("score", T.DoubleType())]))


def op10_query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out")
    model = fit(docs, labels.filter(~held), "quality")
    got = score(docs, model)
    return got.select("doc_id", held, "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"))
