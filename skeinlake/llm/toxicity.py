"""Toxicity scoring with a subsequence string-kernel support vector machine on Nyström landmarks.

Two strings are alike as far as they share subsequences of ``ORDER`` characters, each weighted by a decay for every
character it spans, so letters put between those of an insult, dots, spaces or a changed ending lower the value but
don't remove it. A sentence's kernel with a landmark is the sum over its distinct words of the normalised word kernel
raised to ``POWER``. Landmarks come from the labelled sentences: the most telling words, or beginnings of words, of
toxic documents, kept apart by their kernel, and the clean words most like them. The Nyström map turns the kernel with
the landmarks into features, and a linear machine with squared hinge loss is trained on sentences. Labels mark
documents, so each toxic document stands for its own worst sentences, found again after each fit. A logistic curve over
a document's worst sentence, the sum of its telling words and its length gives the score.

As the sentence kernel is a sum over words, a sentence's value is the sum of one number per word. Words are looked up,
and the kernel is computed once per distinct word of a task, only for pairs that can share a subsequence at all.

Defined edge results: null, empty and word-less texts get the score of an empty sentence; without labels, or with one
class only, every score is the smoothed share of label 1; a single word of any length is read whole, in overlapping
parts, and a text of any length sentence by sentence; equal scores stay equal; null ids keep their rows; repeated rows
score alike; extra columns are not read, or kept by ``drop_toxic``, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_bucket, free_name, labelled_sample, map_rows

ORDER = 4
DECAY = 0.7
POWER = 2
#: Landmarks from toxic and from clean sentences; words longer than PART are read in parts that overlap by half.
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 32, 16
PART = 24
#: Pairs of words computed at once (arrays of this many pairs stay in the processor's cache).
PAIRS = 1500
#: Single letters in a row that are read as one word as well.
SPELLED = 4
#: A word is telling above this value.
TELLING = 0.25
#: Characters put into words for training, and what a text so changed counts for beside its original.
COPY_WEIGHT = 0.3
FILLERS = "abcdefghijklmnopqrstuvwxyz.-*_"
MARK = "^"


def letters(token: str) -> str:
    """The letters and digits of a token, which is lower-case already."""
    return token if token.isalnum() else "".join(filter(str.isalnum, token))


def parts(word: str) -> list[str]:
    """What stands for a word in the kernel: itself behind a mark of its start, or overlapping parts."""
    if len(word) <= PART:
        return [MARK + word] if word else []
    return [(MARK if i == 0 else "") + word[i : i + PART] for i in range(0, len(word) - PART // 2, PART // 2)]


def encode(words: list[str], pad: int) -> np.ndarray:
    width = max(map(len, words), default=1)
    flat = "".join([w.ljust(width, chr(pad)) for w in words]).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(flat, np.int32).reshape(len(words), width)


def subsequence_kernel(a: np.ndarray, b: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Kernel of paired rows of two padded code arrays [n, la], [n, lb] (pads must differ): gap-weighted subsequences."""
    n, la, lb = len(a), a.shape[1], b.shape[1]
    match = np.ascontiguousarray((a.T[:, None, :] == b.T[None, :, :]).astype(np.float32)) * np.float32(decay * decay)
    inner = None
    for _ in range(order - 1):
        x = match.copy()
        if inner is not None:
            x[1:, 1:] *= inner[:-1, :-1]
            x[0], x[:, 0] = 0, 0
        for j in range(1, lb):
            x[:, j] += decay * x[:, j - 1]
        for i in range(1, la):
            x[i] += decay * x[i - 1]
        inner = x
    if inner is None:
        return match.sum(axis=(0, 1))
    if la < 2 or lb < 2:
        return np.zeros(n, np.float32)
    return (match[1:, 1:] * inner[:-1, :-1]).sum(axis=(0, 1))


def letter_bits(codes: np.ndarray) -> np.ndarray:
    """A bit set of the characters in each row (pads 0 and 1 left out); the mark has bit 63 of its own."""
    bit = np.where(codes == ord(MARK), 63, codes % 63).astype(np.uint64)
    one = np.where(codes > 1, np.uint64(1) << bit, np.uint64(0))
    return np.bitwise_or.reduce(one, axis=1) if codes.size else np.zeros(len(codes), np.uint64)


class Kernel:
    """Normalised kernel of words with fixed landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.codes = encode(landmarks, 1)
        own = encode(landmarks, 0)
        self.norm = np.sqrt(subsequence_kernel(own, self.codes)) if landmarks else np.zeros(0)
        self.bits = letter_bits(self.codes)
        # A pair below this many characters in common shares no subsequence of ORDER characters.
        self.least = np.array([min((len(set(c)) for c in combinations(w, ORDER)), default=64) for w in landmarks], np.uint8)

    def __call__(self, words: list[str]) -> np.ndarray:
        """[words, landmarks], raised to POWER."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        if not self.landmarks:
            return out
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for k in range(0, len(order), 4096):
            pick = order[k : k + 4096]
            codes = encode([words[i] for i in pick], 0)
            bits = letter_bits(codes)
            near = np.bitwise_count(bits[:, None] & self.bits[None, :]) >= self.least[None, :]
            z, w = np.nonzero(near.T)
            long = self.common(codes, z, w) >= ORDER
            z, w = z[long], w[long]
            if not len(w):
                continue
            used, inverse = np.unique(w, return_inverse=True)
            own = np.sqrt(self.paired(codes[used], np.where(codes[used] == 0, 1, codes[used])))
            vals = np.empty(len(w), np.float32)
            cuts = np.flatnonzero(np.append(True, z[1:] != z[:-1]))
            for a, b in zip(cuts, np.append(cuts[1:], len(z)), strict=True):
                one = self.codes[z[a], : len(self.landmarks[z[a]])]
                vals[a:b] = self.paired(codes[w[a:b]], np.broadcast_to(one, (b - a, len(one))))
            base = own[inverse] * self.norm[z]
            out[np.array(pick)[w], z] = np.where(base > 0, vals / np.where(base > 0, base, 1), 0) ** POWER
        return out

    def common(self, codes: np.ndarray, z: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of each pair, by bit vectors: below ORDER the kernel is 0."""
        chars, at = np.unique(codes, return_inverse=True)
        at = at.reshape(codes.shape)
        masks = np.zeros((len(self.landmarks), len(chars)), np.uint64)
        place = {c: i for i, c in enumerate(chars.tolist())}
        for n, word in enumerate(self.landmarks):
            for k, c in enumerate(word):
                if ord(c) in place:
                    masks[n, place[ord(c)]] |= np.uint64(1 << k)
        out = np.empty(len(z), np.uint8)
        for s in range(0, len(z), 1 << 14):
            zs, ws = z[s : s + (1 << 14)], at[w[s : s + (1 << 14)]]
            v = np.full(len(zs), ~np.uint64(0))
            for j in range(codes.shape[1]):
                u = v & masks[zs, ws[:, j]]
                v = (v + u) | (v - u)
            out[s : s + (1 << 14)] = np.bitwise_count(~v)
        return out

    @staticmethod
    def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.concatenate([subsequence_kernel(a[s : s + PAIRS], b[s : s + PAIRS]) for s in range(0, len(a), PAIRS)])


class Words(dict):
    """Token -> index, filled on demand; ``fresh`` holds what has no value yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, token: str) -> int:
        got = self[token] = len(self)
        self.fresh.append(token)
        return got


#: White space other than spaces and line ends: tabs, carriage returns, no-break spaces.
BLANK = re.compile(r"[^\S\n ]")


def ends_sentence(token: str) -> bool:
    return token[-1] in ".!?" or token == "\n"


def split_tokens(text: str | None) -> list[str]:
    """Lower-case tokens between white space of any kind, line ends being tokens of their own."""
    return BLANK.sub(" ", text.lower()).replace("\n", " \n ").split(" ") if text else []


def sentences(text: str | None) -> list[list[str]]:
    """The words (letters only) of each sentence; runs of single letters add the word they spell."""
    out, now = [], []
    for token in [*split_tokens(text), "\n"]:
        if not token:
            continue
        if word := letters(token):
            now.append(word)
        if ends_sentence(token) and now:
            out.append(now + spelled(now))
            now = []
    return out


def spelled(words: list[str]) -> list[str]:
    got, run = [], []
    for w in [*words, ""]:
        if len(w) == 1:
            run.append(w)
            continue
        if len(run) >= SPELLED:
            got.append("".join(run))
        run = []
    return got


class Model:
    """Landmarks, a weight for each, the machine's bias, and the curve's weights for (1, worst, sum, length)."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, curve: np.ndarray):
        self.landmarks, self.weights, self.bias, self.curve = landmarks, weights, bias, curve

    def scorer(self) -> Scorer:
        return Scorer(self)


def measures(worst: np.ndarray, total: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What the logistic curve sees of a document."""
    return np.stack([np.ones(len(worst)), np.clip(worst, -4, 4), np.log1p(total), np.log1p(words) / 4], 1)


class Scorer:
    """Task-local scoring with bounded tables of word values."""

    LIMIT = 400_000

    def __init__(self, model: Model):
        self.model, self.kernel = model, Kernel(model.landmarks)
        self.reset()

    def reset(self) -> None:
        self.words, self.known = Words(), {}
        self.value, self.ends, self.form = np.zeros(0), np.zeros(0, bool), np.zeros(0, np.int8)

    def values(self, words: list[str]) -> np.ndarray:
        """The value of each word (letters only): the sum over its parts and the landmarks."""
        pieces = [parts(w) for w in words]
        owner = np.repeat(np.arange(len(words)), [len(p) for p in pieces])
        flat = [x for p in pieces for x in p]
        return np.bincount(owner, self.kernel(flat) @ self.model.weights, len(words)) if flat else np.zeros(len(words))

    def learn(self) -> None:
        fresh, known = self.words.fresh, self.known
        if not fresh:
            return
        plain = [letters(t) for t in fresh]
        new = sorted({w for w in plain if w not in known})
        known.update(zip(new, self.values(new).tolist(), strict=True))
        self.value = np.append(self.value, [known[w] for w in plain])
        self.ends = np.append(self.ends, [bool(t) and ends_sentence(t) for t in fresh])
        self.form = np.append(self.form, np.array([min(len(w), 2) for w in plain], np.int8))
        self.words.fresh = []

    def measure(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: value of the worst sentence (0: none), sum of its distinct telling words, number of words."""
        if len(self.words) > self.LIMIT:
            self.reset()
        words, ids, base = self.words, [], [0]
        for text in texts:
            ids += [words[t] for t in split_tokens(text)]
            ids.append(words["\n"])
            base.append(len(ids))
        self.learn()
        at = np.array(ids, np.int64)
        sentence = np.concatenate([[0], np.cumsum(self.ends[at])[:-1]])
        doc_of = np.searchsorted(base, np.arange(len(at)), side="right") - 1
        worth_something = np.flatnonzero(self.value[at])
        once = np.unique(sentence[worth_something] * len(self.value) + at[worth_something])
        total = np.bincount(once // len(self.value), self.value[once % len(self.value)], int(sentence[-1]) + 1)
        doc = np.zeros(len(total), np.int64)
        doc[sentence] = doc_of
        telling = np.flatnonzero(self.value[at] > TELLING)
        pairs = np.unique(doc_of[telling] * len(self.value) + at[telling])
        who, worth = pairs // len(self.value), self.value[pairs % len(self.value)]
        for d, s, v in self.spelled_out(at, sentence, doc_of):
            total[s] += v
            if v > TELLING:
                who, worth = np.append(who, d), np.append(worth, v)
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, doc, total)
        count = np.bincount(doc_of, self.form[at] > 0, len(texts))
        return np.where(np.isfinite(worst), worst, 0.0), np.bincount(who, worth, len(texts)), count

    def spelled_out(self, at: np.ndarray, sentence: np.ndarray, doc_of: np.ndarray) -> list[tuple[int, int, float]]:
        """(document, sentence, value) of each run of SPELLED or more single letters, read as one word."""
        single = np.concatenate([[0], (self.form[at] == 1).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(single))
        runs = [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= SPELLED]
        if not runs:
            return []
        names = list(self.words)
        found = self.values(["".join(letters(names[i]) for i in at[a:b]) for a, b in runs])
        return [(int(doc_of[a]), int(sentence[a]), float(v)) for (a, _), v in zip(runs, found, strict=True)]

    def score(self, texts: list[str | None]) -> np.ndarray:
        worst, total, words = self.measure(texts)
        return 1 / (1 + np.exp(-np.clip(measures(worst + self.model.bias, total, words) @ self.model.curve, -60, 60)))


def choose_landmarks(toxic: list[list[list[str]]], clean: list[list[list[str]]]) -> list[str]:
    """Telling words and beginnings of words of toxic documents, most telling first and unlike those before; then clean
    words like them."""

    def found(docs, among=None):
        out = Counter()
        for d in docs:
            words = {w for s in d for w in s if 3 <= len(w) <= PART}
            mine = Counter(w[:n] for w in words for n in (4, 5, 6, 7, 8) if n <= len(w))
            mine.update(w for w in words if len(w) not in (4, 5, 6, 7, 8))
            out.update({w: min(n, 6) for w, n in mine.items() if among is None or w in among})
        return out

    t = {w: n for w, n in found(toxic).items() if n >= 4}
    c = found(clean, t)
    scale = len(toxic) / max(len(clean), 1)
    odds = {w: n * np.log((n + 1) / (scale * c[w] + 1)) for w, n in t.items() if n > 5 * scale * c[w]}
    picked: list[str] = []
    for w in sorted(odds, key=lambda w: (-odds[w], -len(w), w))[:1500]:
        if len(picked) == TOXIC_LANDMARKS:
            break
        if not picked or Kernel(picked)([MARK + w]).max() < 0.3:
            picked.append(MARK + w)
    if not picked:
        return []
    whole = Counter(w for d in clean for w in {w for s in d for w in s if 3 <= len(w) <= PART})
    common = [MARK + w for w, n in sorted(whole.items(), key=lambda x: (-x[1], x[0]))[:6000] if w not in odds]
    like = Kernel(picked)(common).max(axis=1)
    for i in np.argsort(-like, kind="stable")[:200]:
        if len(picked) >= TOXIC_LANDMARKS + CLEAN_LANDMARKS or like[i] <= 0:
            break
        if Kernel(picked)([common[i]]).max() < 0.6:
            picked.append(common[i])
    return picked


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine: half the squared norm of w plus cost times squared hinge, by Newton steps; bias unpenalised."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x1.shape[1]), np.append(np.ones(x.shape[1]), 1e-6)
    for _ in range(rounds):
        gap = 1 - y * (x1 @ w)
        on = gap > 0
        xa, c = x1[on], cost[on]
        grad = ridge * w - 2 * xa.T @ (c * y[on] * gap[on])
        step = np.linalg.solve(np.diag(ridge) + 2 * (xa.T * c) @ xa, grad)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 200, ridge: float = 0.05) -> np.ndarray:
    """Weights of a logistic curve over columns of which the first is 1, by damped Newton steps."""
    w, pull = np.zeros(x.shape[1]), ridge * np.array([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * (p * (1 - p) + 1e-9))[:, None]) + np.diag(pull + 1e-9), x.T @ (weight * (p - y)) + pull * w)
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return w


def blurred(text: str | None, scorer: Scorer, rng: random.Random) -> str:
    """The text with a character put inside each telling word: what such a word looks like when it is to be missed."""

    def one(token: str) -> str:
        word = letters(token.lower())
        if len(word) < 4 or scorer.known.get(word, 0.0) <= TELLING:
            return token
        at = rng.randint(1, len(token) - 1)
        return token[:at] + rng.choice(FILLERS) + token[at:]

    return " ".join(one(t) for t in (text or "").split(" "))


def sentence_rows(docs: list[list[list[str]]], kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """Of each sentence (one without words for a document that has none): its document, its kernel with the landmarks."""
    vocabulary = sorted({w for d in docs for s in d for w in s})
    index = {w: i for i, w in enumerate(vocabulary)}
    pieces = [(i, p) for i, w in enumerate(vocabulary) for p in parts(w)]
    rows = np.zeros((len(vocabulary), len(kernel.landmarks)), np.float32)
    np.add.at(rows, [i for i, _ in pieces], kernel([p for _, p in pieces]))
    doc_of = np.array([n for n, d in enumerate(docs) for _ in (d or [[]])], np.int64)
    raw = np.empty((len(doc_of), len(kernel.landmarks)), np.float32)
    for n, s in enumerate(s for d in docs for s in (d or [[]])):
        raw[n] = rows[sorted({index[w] for w in s})].sum(axis=0)
    return doc_of, raw


def machine(raw: np.ndarray, doc_of: np.ndarray, is_toxic: np.ndarray, nystroem: np.ndarray, rounds: int = 4, worst_of: tuple[int, int] = (8, 2)) -> tuple[np.ndarray, float]:
    """A weight for each landmark and the bias; clean and toxic documents each stand for so many of their worst
    sentences, found anew in every round (the clean ones' are the hardest to tell apart)."""
    value = raw[:, :TOXIC_LANDMARKS].max(axis=1).astype(np.float64)
    negative = ~is_toxic[doc_of]
    weights, bias = np.zeros(nystroem.shape[1]), 0.0
    for _ in range(rounds):
        order = np.lexsort((-value, doc_of))
        rank = np.arange(len(order)) - np.searchsorted(doc_of[order], doc_of[order])
        use = order[rank < np.where(negative[order], *worst_of)]
        y = np.where(negative[use], -1.0, 1.0)
        cost = np.where(y > 0, 1.0, max(0.02, (y > 0).sum() / max((y < 0).sum(), 1)))
        weights, bias = squared_hinge(raw[use].astype(np.float64) @ nystroem, y, 10 * cost)
        value = raw @ (nystroem @ weights) + bias
    return nystroem @ weights, bias


def train(texts: list[str | None], labels: np.ndarray, share: float | None = None) -> Model:
    """Fit on labelled texts, then once more with a blurred copy of every toxic one. ``share`` is the share of toxic
    documents that scores are to reflect, by default that among the texts."""
    is_toxic = labels.astype(bool)
    smooth = (labels.sum() + 1) / (len(labels) + 2)
    flat = np.array([float(np.log(smooth / (1 - smooth))), 0, 0, 0])
    same: dict[str, str] = {}  # one object for equal words
    docs = [[[same.setdefault(w, w) for w in s] for s in sentences(t)] for t in texts]
    toxic, clean = ([d for d, y in zip(docs, is_toxic, strict=True) if y == want] for want in (True, False))
    landmarks = choose_landmarks(toxic, clean) if toxic and clean else []
    if not landmarks:
        return Model([], np.zeros(0), 0.0, flat)
    kernel = Kernel(landmarks)
    gram = kernel(landmarks).astype(np.float64)
    vals, vecs = np.linalg.eigh((gram + gram.T) / 2)
    keep = vals > 1e-6 * vals.max()
    nystroem = vecs[:, keep] / np.sqrt(vals[keep])
    doc_of, raw = sentence_rows(docs, kernel)
    del same, docs, toxic, clean
    scorer, rng = Model(landmarks, *machine(raw, doc_of, is_toxic, nystroem), flat).scorer(), random.Random(5)
    toxic = [t for t, y in zip(texts, is_toxic, strict=True) if y]
    for k in range(0, len(toxic), 200):
        scorer.measure(toxic[k : k + 200])
    copies = [blurred(t, scorer, rng) for t in toxic]
    del scorer
    # The sentences of the texts keep their rows; only those of the copies are new.
    copy_of, more = sentence_rows([sentences(t) for t in copies], kernel)
    n, doc_of = len(doc_of), np.append(doc_of, copy_of + len(texts))
    raw.resize((len(doc_of), raw.shape[1]), refcheck=False)  # grows in place, no second array
    raw[n:] = more
    del more
    every = np.append(is_toxic, np.ones(len(copies), bool))
    weights, bias = machine(raw, doc_of, every, nystroem)
    del raw
    seen = float(np.mean(is_toxic))
    share = seen if share is None else min(max(share, 1e-3), 1 - 1e-3)
    # Copies count for COPY_WEIGHT of a document; together, toxic documents are to have their share.
    weight = np.where(is_toxic, share / seen, (1 - share) / (1 - seen))
    weight = np.concatenate([np.where(is_toxic, weight / (1 + COPY_WEIGHT), weight), np.full(len(copies), COPY_WEIGHT / (1 + COPY_WEIGHT) * share / seen)])
    model = Model(landmarks, weights, bias, flat)
    scorer, shown = model.scorer(), [*texts, *copies]
    worst, total, words = (np.concatenate(m) for m in zip(*(scorer.measure(shown[k : k + 200]) for k in range(0, len(shown), 200)), strict=True))
    model.curve = logistic(measures(worst + bias, total, words), every.astype(float), weight)
    return model


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on about ``per_class`` documents of each label (the documented bound of the sample). Labels above 0 count as
    1, all others as 0."""
    known, rows = labelled_sample(docs, labels.withColumn(label_col, (F.col(f"`{label_col}`") > 0).cast("int")), label_col, per_class, id_col, text_col)
    share = known.agg(F.avg((F.col(label_col) > 0).cast("double"))).first()[0]
    return train(rows[text_col].tolist(), rows[label_col].to_numpy() > 0, share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The id (or the columns ``keep``) and the score of each document, in the column ``name``. Map-only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = shared.value.scorer()
        return lambda texts: {name: scorer.score(texts)}

    return map_rows(docs, keep or [id_col], text_col, make, T.StructType([T.StructField(name, T.DoubleType())]))


def drop_toxic(docs: DataFrame, model: Model, at: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that score below ``at``, all columns as they were."""
    name = free_name(docs.columns, "score")
    return score(docs, model, id_col, text_col, docs.columns, name).filter(F.col(f"`{name}`") < at).drop(name)


def op7_query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = (crc_bucket(F.col("doc_id"), 3) == 1).alias("held_out")
    got = score(docs, fit(docs, labels.filter(~held)))
    return got.select("doc_id", held, "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"))
