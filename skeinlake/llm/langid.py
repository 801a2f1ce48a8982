"""Language identification of mixed-language text.

Method: script ranges narrow each word's candidate languages, per-word scores come from hashed character n-grams,
and a Viterbi pass with a switching penalty labels maximal one-language spans. A document takes the language that
holds most of its letters.

Most documents stay in one language. For those the constant path is proved optimal without the full recursion: with
``m_t`` the best gain of leaving the leading language at word ``t``, no deviation can pay its penalty if the largest
sum of ``m`` over consecutive words is below one penalty. Only the others run the full recursion, so results are
those of Viterbi over every document.

Where two languages hold similar shares, the opening one may be the document's own: how much being first counts for is
fitted on the sample, as a share of letters.

Defined edge results: null text, empty text and text without a letter give ``und`` with score 0; an empty training
table gives ``und`` everywhere; ties go to the alphabetically first language; a text of any length is read whole, in
blocks; extra columns are not read, whatever their names; null ids keep their rows; repeated rows are scored alike; an
empty table gives no rows.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, bounded_texts, crc_bucket, map_rows

BITS = 17
MUL = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))
#: Values of lang that are learned, the most frequent ones.
MOST_LANGS = 200
#: Long texts are scored in blocks of this many characters, cut at a non-letter.
BLOCK = 1_000_000
#: Unicode script ranges (first, last code point), by script.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F))),
)


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its lower-case code point (0: not part of a word) and its script number (0: other)."""
    low = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        ch = chr(cp)
        kind = unicodedata.category(ch)[0]
        if kind in "LM":
            small = ch.lower()
            low[cp] = ord(small) if len(small) == 1 else cp
    script = np.zeros(0x110000, np.uint8)
    for n, (_, ranges) in enumerate(SCRIPTS, 1):
        for a, b in ranges:
            script[a : b + 1] = n
    return low, script


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def features(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Of a code point array: hashes [letters, 3 orders], word start indexes among letters, letter positions, scripts."""
    low, script = tables()
    c = np.zeros(len(raw) + 3, np.uint32)
    c[1:-2] = low[raw]
    at = np.flatnonzero(c)
    if not len(at):
        return None
    a, b, d, e = c[at - 1], c[at], c[at + 1], c[at + 2]
    h2 = a * MUL[0] + b * MUL[1]
    h3 = h2 + d * MUL[2]
    h4 = np.where(d != 0, h3 + e * MUL[3] + np.uint32(7), h3)
    hashed = np.empty((3, len(at)), np.int64)
    for i, h in enumerate((h2, h3, h4)):
        h = h ^ (h >> np.uint32(15))
        h = h * MUL[i + 1]
        hashed[i] = ((h ^ (h >> np.uint32(13))) & np.uint32((1 << BITS) - 1)).astype(np.int64) + (i << BITS)
    starts = np.flatnonzero(a == 0)
    return hashed, starts, at - 1, script[raw[at - 1]]


def blocks(text: str):
    """Whole text in pieces of at most about BLOCK characters, cut at a space, or else behind the last character that
    isn't a letter; a longer run of letters is cut where the block ends."""
    start = 0
    while start < len(text):
        end = min(len(text), start + BLOCK)
        if end < len(text):
            cut = text.rfind(" ", start + BLOCK // 2, end)
            if cut < 0:
                other = np.flatnonzero(tables()[0][codes(text[start + BLOCK // 2 : end])] == 0)
                cut = start + BLOCK // 2 + int(other[-1]) + 1 if len(other) else end
            end = cut
        yield start, text[start:end]
        start = end


class Model:
    """Per-language n-gram log-probabilities (centred), script use per language, parameters of the path."""

    def __init__(self, langs: list[str], table: np.ndarray, scripts: np.ndarray, penalty: float, opening: float = 0.0):
        self.langs, self.table, self.scripts, self.penalty, self.opening = langs, table, scripts, penalty, opening

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores [words, langs], letters per word, start and end offset of each word."""
        got = []
        for base, piece in blocks(text):
            f = features(codes(piece))
            if f is None:
                continue
            hashed, starts, at, script = f
            s = self.table[hashed[0]]
            s += self.table[hashed[1]]
            s += self.table[hashed[2]]
            score = np.add.reduceat(s, starts, axis=0).astype(np.float64)
            ends = np.append(starts[1:], len(at))
            allowed = self.scripts[script[starts]]
            barred = ~allowed & allowed.any(axis=1, keepdims=True)
            if barred.any():
                score[barred] = -50.0
            got.append((score, ends - starts, at[starts] + base, at[ends - 1] + base + 1))
        if not got:
            return np.zeros((0, len(self.langs))), *[np.zeros(0, np.int64)] * 3
        return tuple(np.concatenate(x) for x in zip(*got, strict=True))

    def path(self, score: np.ndarray) -> np.ndarray:
        """Language index of each word on the best path; equal scores go to the lower index."""
        if len(self.langs) == 1:
            return np.zeros(len(score), np.int64)
        lead = int(score.sum(axis=0).argmax())
        other = np.delete(score, lead, axis=1).max(axis=1) - score[:, lead]
        run = np.concatenate([[0.0], np.cumsum(other)])
        if (run - np.minimum.accumulate(run)).max() < self.penalty:
            return np.full(len(score), lead)
        return viterbi(score, self.penalty)

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """Maximal spans (start, end, lang) of the labelled words; offsets in code points of the text."""
        score, _, start, end = self.words(text or "")
        if not len(score) or not self.langs:
            return []
        path = self.path(score)
        first = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
        last = np.append(first[1:], len(path)) - 1
        return [(int(start[i]), int(end[j]), self.langs[path[i]]) for i, j in zip(first, last, strict=True)]

    def predict(self, text: str | None) -> tuple[str, float, int, int]:
        """(language, score 0..1, number of spans, number of languages used)."""
        if not self.langs or not text:
            return "und", 0.0, 0, 0
        score, letters, _, _ = self.words(text)
        if not len(score) or not any(unicodedata.category(ch)[0] == "L" for ch in _letters_of(text)):
            return "und", 0.0, 0, 0
        path = self.path(score)
        share = np.bincount(path, weights=letters, minlength=len(self.langs))
        lean = share / share.sum()
        lean[path[0]] += self.opening
        best = int(lean.argmax())
        rest = np.delete(score, best, axis=1)
        margin = float((score[:, best] - rest.max(axis=1)).sum()) if rest.size else 10.0
        sure = 1.0 / (1.0 + np.exp(-np.clip(margin / 4, -30, 30)))
        return (
            self.langs[best],
            float(share[best] / share.sum() * sure),
            1 + int((path[1:] != path[:-1]).sum()),
            int((share > 0).sum()),
        )


def _letters_of(text: str):
    return (ch for ch in text if unicodedata.category(ch)[0] in "LM")


def viterbi(score: np.ndarray, penalty: float) -> np.ndarray:
    """Best path with a uniform cost per switch; staying wins ties, then the lower index."""
    n, k = score.shape
    value = score[0].tolist()
    back: list[list[int] | None] = []
    for row in score[1:].tolist():
        top = max(value)
        j = value.index(top)
        jump = top - penalty
        came = None
        for i in range(k):
            if value[i] < jump:
                if came is None:
                    came = list(range(k))
                came[i] = j
                value[i] = jump + row[i]
            else:
                value[i] += row[i]
        back.append(came)
    at = value.index(max(value))
    out = np.empty(n, np.int64)
    for t in range(n - 1, -1, -1):
        out[t] = at
        if t and back[t - 1] is not None:
            at = back[t - 1][at]
    return out


def fit(docs: DataFrame, per_lang: int = 1500, penalty: float = 12.0, alpha: float = 0.3) -> Model:
    """Fit on a bounded sample: about ``per_lang`` documents for each of the ``MOST_LANGS`` most frequent lang values
    (documented bounds: the table has a column for each language). Documents of other values get a learned one."""
    sample = bounded_sample(docs.filter("lang is not null and text is not null"), ["lang"], "doc_id", per_lang, MOST_LANGS)
    rows = bounded_texts(sample, "lang", "doc_id", "text").select("text", "lang").toPandas().sort_values(["lang", "text"], kind="stable")
    langs = sorted(set(rows["lang"]))
    counts = np.zeros((3 << BITS, len(langs)), np.int32)
    used = np.zeros((len(SCRIPTS) + 1, len(langs)))
    for i, lang in enumerate(langs):
        held: list[np.ndarray] = []
        for text in rows["text"][rows["lang"] == lang]:
            for _, piece in blocks(text):
                if (f := features(codes(piece))) is not None:
                    held.append(f[0].ravel())
                    used[:, i] += np.bincount(f[3], minlength=len(SCRIPTS) + 1)
            if sum(map(len, held)) > 1 << 20:
                counts[:, i] += np.bincount(np.concatenate(held), minlength=len(counts))
                held = []
        if held:
            counts[:, i] += np.bincount(np.concatenate(held), minlength=len(counts))
    table = np.zeros_like(counts, dtype=np.float32)
    for order in range(3):
        part = counts[order << BITS : (order + 1) << BITS].astype(np.float64)
        total = part.sum(axis=0, keepdims=True)
        seen = max(1, int((part.sum(axis=1) > 0).sum()))
        logp = np.log((part + alpha) / (total + alpha * seen))
        logp -= logp.mean(axis=1, keepdims=True) if len(langs) else 0
        logp[part.sum(axis=1) == 0] = 0
        table[order << BITS : (order + 1) << BITS] = 0.5 * np.clip(logp, -4, 4)
    scripts = used >= 0.01 * np.maximum(used.sum(axis=0, keepdims=True), 1)
    model = Model(langs, table, scripts, penalty)
    model.opening = fit_opening(model, rows["text"], rows["lang"])
    return model


def fit_opening(model: Model, texts, labels, steps: tuple[float, ...] = (0.0, 0.1, 0.2, 0.3, 0.4, 0.6)) -> float:
    """The bonus of the opening language that labels most sample documents of several languages right; the smallest on
    ties."""
    right = np.zeros(len(steps))
    for text, label in zip(texts, labels, strict=True):
        score, letters, _, _ = model.words(text)
        if not len(score):
            continue
        path = model.path(score)
        share = np.bincount(path, weights=letters, minlength=len(model.langs)) / letters.sum()
        if (share > 0).sum() < 2:
            continue
        for i, bonus in enumerate(steps):
            lean = share.copy()
            lean[path[0]] += bonus
            right[i] += model.langs[int(lean.argmax())] == label
    return steps[int(right.argmax())]


RESULT = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("n_langs", T.LongType()),
    ]
)
SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("lang", T.StringType()),
        ]
    )
)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score, n_spans, n_langs. Map-only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def fn(texts):
            got = [m.predict(t) for t in texts]
            return {n: [g[i] for g in got] for i, n in enumerate(("lang_pred", "score", "n_spans", "n_langs"))}

        return fn

    return map_rows(docs, [id_col], text_col, make, RESULT)


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per labelled span: id, start, end, lang."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: {"spans": [[dict(zip(("start", "end", "lang"), s, strict=True)) for s in shared.value.spans(t)] for t in texts]}

    got = map_rows(docs, [id_col], text_col, make, T.StructType([T.StructField("spans", SPANS)]))
    return got.select(id_col, F.explode("spans").alias("s")).select(id_col, "s.start", "s.end", "s.lang")


def op1_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out")
    model = fit(docs.filter(~held))
    found = identify(docs, model)
    return found.select("doc_id", held, "lang_pred", "score", "n_spans", "n_langs")
