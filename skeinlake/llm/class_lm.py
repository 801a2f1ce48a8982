"""Class-based n-gram language model: exchange clustering of words, class transitions and word emissions.

``P(text) = prod P(class_i | class_(i-1)) * P(word_i | class_i)`` over the words of a text and one end, which is also what
comes before the first word. Classes are found by exchange clustering: the likelihood of the training text under the
class bigrams, ``sum f(n(c, d)) - sum f(n(c, .)) - sum f(n(., d))`` with ``f(x) = x ln x``, is raised by moving words between
classes. Everything is counted over all training documents, and every training word gets a class and its own count:

1. Count all words. The most frequent ones (``HEAD``) get numbers by rank; they are the words that tasks look up.
2. Write each document once as numbers, with its other words beside them; what follows reads only that.
3. Exchange the most frequent words (``CORE``) in rounds. A round counts, in one map, how often each word stands before and
   after each class; tasks send one row a word. The driver, which holds this table of bounded size, moves words in order
   of frequency, a few at a time, to the class of the greatest gain. A round that lowers the likelihood is undone.
4. Place all other words, each by the same criterion: their context counts meet by word and are decided in tasks.
5. Count class transitions over all pairs of neighbours. Pairs with a word outside the head are few; they are joined with
   the classes of these words, and the head's pairs are counted in the map.
6. Score: a map adds what it knows of a document, and the joined pairs add the rest by row.

Transitions are smoothed with the classes' shares (``MU`` pseudo counts). Emissions are discounted: each type of a class
gives the same part of a count, found from how many words are seen once and twice, to the unknown words, which are one
type. How likely an unknown word is follows from the classes that may come next; what comes after it, from the class with
most words seen once. Probabilities sum to one over the vocabulary, the unknown type and the end.

Words are what stands between ASCII white space, with A-Z in lower case. ``HEAD`` and ``CORE`` are bounds of what tasks look
up and what is moved more than once; no word, pair or document is left out.

Defined edge results: null and empty texts are the end alone; without training documents every token has the same
probability under the base; texts and words of any length are read whole (words above 64 bytes are never looked up but
joined); null ids are held out; repeated rows count and are scored each; of equally frequent words, which make up one
more than fit, none is in the head; extra columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_code
from .common import crc_bucket, if_small, materialize, read_table, shared_dir

#: Words that tasks look up, and words that are exchanged in rounds.
HEAD, CORE = 1 << 20, 1 << 14
HEAD_BYTES = 64
#: Classes with that of the end (0). While clustering there is one more, ``CLASSES``, of words that have none yet.
CLASSES = 32
SLOTS = CLASSES + 1
ROUNDS = 4
MU = 5.0
ALPHA = 0.1
#: Distinct entries that a task holds before it sends them on.
HELD = 500_000


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


class Codes(dict):
    """Number of a word from 1; 0 for words outside the head."""

    def __missing__(self, word: bytes) -> int:
        return 0


@dataclass
class Head:
    """Words by rank; ``counts[k]`` is the count of number k, ``core`` the last number that is exchanged."""

    words: list[bytes]
    counts: np.ndarray
    core: int

    @property
    def end(self) -> int:
        return len(self.words) + 1


def prepared(docs: DataFrame, held: F.Column, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), held.alias("held"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) of all words; tasks send a row for each of their distinct words."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], schema=schema)
            held.clear()
            return got

        for batch in batches:
            for text in batch.column(0):
                held.update(words_of(text.as_py()))
                if len(held) > HELD:
                    yield out()
        yield out()

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_of(vocabulary: DataFrame, head: int = HEAD, core: int = CORE) -> Head:
    """The most frequent words: those above the least count at which they are no more than the bound."""
    short = vocabulary.filter(F.length("word") <= HEAD_BYTES)
    shares = sorted(((r.n, r["count"]) for r in short.groupBy("n").count().collect()), reverse=True)

    def least(bound: int) -> int:
        total = 0
        for n, count in shares:
            total += count
            if total > bound:
                return n + 1
        return 1

    table = short.filter(F.col("n") >= least(head)).toArrow()
    n, found = table.column("n").to_numpy().astype(np.int64), table.column("word").to_pylist()
    order = sorted(range(len(found)), key=lambda i: (-n[i], found[i]))
    return Head([found[i] for i in order], np.concatenate([[0], n[order]]).astype(np.int64), int((n >= least(core)).sum()))


def encoded(texts: DataFrame, head: Head) -> DataFrame:
    """(row, id, held, codes, rare): each document as numbers, 0 standing for the next of its ``rare`` words. Written once
    to the shared folder; ``row`` tells rows apart."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(Codes(zip(head.words, range(1, len(head.words) + 1), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value.__getitem__
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                codes, rare = [], []
                for text in part.column(3):
                    words = words_of(text.as_py())
                    numbers = np.fromiter(map(code, words), np.uint32, len(words))
                    codes.append(numbers.tobytes())
                    rare.append([words[k] for k in np.flatnonzero(numbers == 0)])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(codes, pa.binary()), pa.array(rare, pa.list_(pa.binary()))], names=["row", "id", "held", "codes", "rare"])

    id_type = texts.schema["id"].dataType.simpleString()
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "id", "held", "text")
    path = f"{shared_dir(spark)}/codes"
    rows.mapInArrow(run, f"row long, id {id_type}, held boolean, codes binary, rare array<binary>").write.option("compression", "zstd").parquet(path)
    shared.destroy()
    return spark.read.parquet(path)


def line(codes: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents of a batch in one row of numbers, with an end before the first and after each; tokens of each."""
    data, sizes = bytes_of(codes)
    sizes = sizes.astype(np.int64) // 4
    ends = np.cumsum(sizes)
    # Every document is put behind the end of the one before.
    flat = np.insert(np.frombuffer(data, np.int32), ends, end)
    return np.concatenate([np.array([end], np.int32), flat]), sizes + 1


def bytes_of(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """(all bytes of a binary column, length of each value), without a copy of each."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return memoryview(data)[offsets[0] : offsets[-1]] if data is not None else memoryview(b""), np.diff(offsets)


def binary_column(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of consecutive pieces of ``data`` that end before ``ends`` (in items)."""
    offsets = np.concatenate([[0], ends]).astype(np.int32) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def contexts(training: DataFrame, head: Head, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts [core + 1, 2 * SLOTS + 1], transitions [SLOTS, SLOTS]) over all training documents.

    Of a word: how often each class follows, how often each class precedes, how often it follows itself.
    """
    spark, core, end = training.sparkSession, head.core, head.end
    shared = spark.sparkContext.broadcast(classes)
    wide = 2 * SLOTS + 1
    schema = pa.schema([("w", pa.int32()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.astype(np.uint8)
        total, pairs = np.zeros((core + 1, wide), np.int64), np.zeros(SLOTS * SLOTS, np.int64)
        for batch in batches:
            flat, _ = line(batch.column(0), end)
            slots, own = of[flat], np.where(flat <= core, flat, 0)  # row 0 takes what isn't counted
            before, after = slots[:-1], slots[1:]
            pairs += np.bincount(before * np.int32(SLOTS) + after, minlength=SLOTS * SLOTS)
            for word, slot, base in ((own[:-1], after, 0), (own[1:], before, SLOTS)):
                total[:, base : base + SLOTS] += np.bincount(word * np.int32(SLOTS) + slot, minlength=(core + 1) * SLOTS).reshape(-1, SLOTS)
            total[:, -1] += np.bincount(own[:-1][flat[:-1] == flat[1:]], minlength=core + 1)
        total[0] = 0
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used], pa.int32()), pa.array([pairs.tobytes(), *(total[k].tobytes() for k in used)], pa.binary())], schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for w, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[w] = held.get(w, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], schema=schema)

    got = training.select("codes").mapInArrow(count, "w int, counts binary").repartition("w").mapInArrow(add, "w int, counts binary").toArrow()
    shared.destroy()
    total, pairs = np.zeros((core + 1, wide), np.int64), np.zeros(SLOTS * SLOTS, np.int64)
    for w, counts in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
        if w < 0:
            pairs = np.frombuffer(counts, np.int64)
        else:
            total[w] = np.frombuffer(counts, np.int64)
    return total, pairs.reshape(SLOTS, SLOTS)


def f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(pairs: np.ndarray) -> float:
    return float(f(pairs).sum() - f(pairs.sum(axis=1)).sum() - f(pairs.sum(axis=0)).sum())


def exchanged(counts: np.ndarray, pairs: np.ndarray, classes: np.ndarray, core: int, at_once: int = 64) -> np.ndarray:
    """Classes after one move of each core word, in order of frequency, to the class of the greatest gain.

    ``at_once`` words are decided on the same transitions, which then take their moves.
    """
    classes, pairs = classes.copy(), pairs.astype(np.float64)
    diagonal, targets = np.arange(SLOTS), slice(1, CLASSES)
    for start in range(1, core + 1, at_once):
        ids = np.arange(start, min(core + 1, start + at_once))
        own, k = classes[ids].astype(np.int64), np.arange(len(ids))
        after, before, same = counts[ids, :SLOTS].astype(float), counts[ids, SLOTS:-1].astype(float), counts[ids, -1].astype(float)
        after[k, own] -= same
        before[k, own] -= same
        after, before = np.maximum(after, 0), np.maximum(before, 0)
        without = np.repeat(pairs[None], len(ids), axis=0)
        without[k, own, :] -= after
        without[k, :, own] -= before
        without[k, own, own] -= same
        without = np.maximum(without, 0)
        base = f(without)
        rows = f(without + after[:, None, :]) - base
        columns = f(without + before[:, :, None]) - base
        rows[:, diagonal, diagonal] = 0
        columns[:, diagonal, diagonal] = 0
        middle = without[:, diagonal, diagonal]
        both = f(middle + after + before + same[:, None]) - base[:, diagonal, diagonal]
        out, into = without.sum(axis=2), without.sum(axis=1)
        n_out, n_into = after.sum(axis=1) + same, before.sum(axis=1) + same
        gain = rows.sum(axis=2) + columns.sum(axis=1) + both - (f(out + n_out[:, None]) - f(out)) - (f(into + n_into[:, None]) - f(into))
        gain = gain[:, targets]
        best = gain.argmax(axis=1) + 1
        stays = (own < CLASSES) & (own > 0)
        stays[stays] = gain[k[stays], own[stays] - 1] >= gain[k[stays], best[stays] - 1] - 1e-9
        for i in np.flatnonzero(~stays):
            a, b = own[i], best[i]
            pairs[a, :] -= after[i]
            pairs[:, a] -= before[i]
            pairs[a, a] -= same[i]
            np.maximum(pairs, 0, out=pairs)
            pairs[b, :] += after[i]
            pairs[:, b] += before[i]
            pairs[b, b] += same[i]
            classes[ids[i]] = b
    return classes


def clustered(training: DataFrame, head: Head, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each number, transitions) after the rounds; words outside the core are in class ``CLASSES``."""
    classes = np.full(head.end + 1, CLASSES, np.int16)
    classes[head.end] = 0
    alone = min(head.core, CLASSES - 1)
    classes[1 : alone + 1] = np.arange(1, alone + 1)
    best: tuple | None = None
    for k in range(rounds + 1):
        counts, pairs = contexts(training, head, classes)
        now = likelihood(pairs)
        # The first state has most words in no class, so the second always counts.
        if k > 1 and now <= best[0]:
            break
        best = now, classes, pairs
        moved = exchanged(counts, pairs, classes, head.core) if k < rounds else classes
        if (moved == classes).all():
            break
        classes = moved
    return best[1], best[2]


class Placer:
    """Class of the greatest gain for words that have none, from sparse context counts."""

    def __init__(self, pairs: np.ndarray):
        p = pairs.astype(np.float64)
        self.p = np.concatenate([p[1:CLASSES].T, p[:, 1:CLASSES]])  # [slot, target]: what follows, then what precedes
        self.out, self.into = p.sum(axis=1)[1:CLASSES], p.sum(axis=0)[1:CLASSES]
        self.table = np.stack([f(self.p + k) - f(self.p) for k in range(8)])

    def __call__(self, starts: np.ndarray, slots: np.ndarray, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Entries of a word stand together, from ``starts``."""
        gain = self.table[np.minimum(counts, 7), slots]
        for i in np.flatnonzero(counts > 7):
            gain[i] = f(self.p[slots[i]] + counts[i]) - f(self.p[slots[i]])
        total = np.add.reduceat(gain, starts, axis=0)
        n = n[:, None].astype(float)
        return (total - (f(self.out + n) - f(self.out)) - (f(self.into + n) - f(self.into))).argmax(axis=1) + 1


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of all parts with their sums."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)


def placed(training: DataFrame, head: Head, classes: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """(id, word, class, n) of all training words outside the core; ``id`` is null for words outside the head, ``word`` for
    those in it."""
    spark, core, end = training.sparkSession, head.core, head.end
    shared = spark.sparkContext.broadcast((classes, Placer(pairs)))
    schema = pa.schema([("code", pa.int32()), ("word", pa.binary()), ("slots", pa.binary()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value[0].astype(np.uint8)
        numbers: dict[bytes, int] = {}
        keys, sums, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def out() -> pa.RecordBatch:
            code, slot = keys // (2 * SLOTS), (keys % (2 * SLOTS)).astype(np.uint8)
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            ends, known = np.append(starts[1:], len(code)), code[starts]
            outside = known > end
            words = pa.array(list(numbers), pa.binary()).take(pa.array(np.where(outside, known - end - 1, 0), mask=~outside))
            return pa.RecordBatch.from_arrays([pa.array(known.astype(np.int32), mask=outside), words, binary_column(slot, ends), binary_column(sums.astype(np.uint32), ends)], schema=schema)

        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                flat, _ = line(part.column(0), end)
                slots, flat = of[flat], flat.astype(np.int64)
                at = np.flatnonzero(flat == 0)
                flat[at] = [numbers.setdefault(w, len(numbers)) + end + 1 for w in part.column(1).flatten().to_pylist()]
                mine = np.flatnonzero((flat > core) & (flat != end))
                new, n = np.unique(np.concatenate([flat[mine] * (2 * SLOTS) + slots[mine + 1], flat[mine] * (2 * SLOTS) + SLOTS + slots[mine - 1]]), return_counts=True)
                waiting.append((new, n))
                if sum(len(x) for x, _ in waiting) > 2 * HELD:
                    keys, sums = added(waiting)
                    waiting = [(keys, sums)]
                if len(keys) > 4 * HELD or len(numbers) > HELD:
                    keys, sums = added(waiting)
                    yield out()
                    numbers, keys, waiting = {}, np.zeros(0, np.int64), []
        keys, sums = added(waiting)
        if len(keys):
            yield out()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by word, so a word's are together; the last word of a batch waits for the next."""
        place = shared.value[1]
        waiting: list[pa.RecordBatch] = []

        def out(rows: pa.RecordBatch, key: np.ndarray) -> pa.RecordBatch:
            (slots, sizes), (counts, _) = bytes_of(rows.column(2)), bytes_of(rows.column(3))
            entry = np.repeat(key, sizes) * (2 * SLOTS) + np.frombuffer(slots, np.uint8)
            cells, back = np.unique(entry, return_inverse=True)
            total = np.bincount(back, np.frombuffer(counts, np.uint32)).astype(np.int64)
            owner, slot = cells // (2 * SLOTS), cells % (2 * SLOTS)
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            n = np.add.reduceat(np.where(slot < SLOTS, total, 0), starts)
            first = np.flatnonzero(np.diff(key, prepend=-1))
            return pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(first)), rows.column(1).take(pa.array(first)), pa.array(place(starts, slot, total, n).astype(np.int32)), pa.array(n)], names=["code", "word", "class", "n"]
            )

        for batch in _with_last(batches):
            if batch is not None:
                waiting.append(batch)
            rows = pa.Table.from_batches(waiting).combine_chunks().to_batches() if waiting else []
            if not rows:
                continue
            rows = rows[0]
            key = word_numbers(rows)
            cut = len(key) if batch is None else int(np.searchsorted(key, key[-1]))
            if cut:
                yield out(rows.slice(0, cut), key[:cut])
            waiting = [rows.slice(cut)] if cut < len(key) else []

    rows = training.select("codes", "rare").mapInArrow(count, "code int, word binary, slots binary, counts binary")
    return rows.repartition("code", "word").sortWithinPartitions("code", "word").mapInArrow(decide, "code int, word binary, class int, n long")


def _with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches that have rows, and None behind them."""
    yield from (b for b in batches if b.num_rows)
    yield None


def word_numbers(rows: pa.RecordBatch) -> np.ndarray:
    """A number from 0 for each distinct (code, word) of sorted rows."""
    codes, words = rows.column(0), rows.column(1)
    if rows.num_rows < 2:
        return np.zeros(rows.num_rows, np.int64)
    same = pc.and_(
        pc.equal(pc.fill_null(codes.slice(1), -1), pc.fill_null(codes.slice(0, len(codes) - 1), -1)), pc.equal(pc.fill_null(words.slice(1), b""), pc.fill_null(words.slice(0, len(words) - 1), b""))
    )
    return np.concatenate([[0], np.cumsum(~same.to_numpy(zero_copy_only=False))]).astype(np.int64)


@dataclass
class Model:
    """``emission`` and ``base`` hold log10 probabilities by number, ``transition`` [class, class] those of class pairs, its
    last column that of an unknown word; ``mass`` is the count of each class, ``discount`` what each type gives away."""

    classes: np.ndarray
    emission: np.ndarray
    base: np.ndarray
    known: np.ndarray
    transition: np.ndarray
    mass: np.ndarray
    discount: float
    base_total: float
    unknown: int
    tokens: int


RARE = "row long, held boolean, before binary, before_class int, word binary, after_class int, times long"


def rare_words(codes: DataFrame, head: Head, classes: np.ndarray) -> DataFrame:
    """What is to be joined: each occurrence of a word outside the head with the classes of its neighbours (null if they are
    outside too), and each pair of neighbours that both are (``before``, ``word``). Rows without a word say how often two
    classes follow each other (``before_class``, ``after_class``) in a task's training documents within the head."""
    shared, end = codes.sparkSession.sparkContext.broadcast(classes), head.end
    names = [x.split(" ")[0] for x in RARE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.astype(np.uint8)
        counts = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                flat, sizes = line(part.column(2), end)
                slots, rare = of[flat], flat == 0
                doc = np.repeat(np.arange(part.num_rows), sizes)
                held = part.column(1).to_numpy(zero_copy_only=False)[doc]
                mine = ~(rare[:-1] | rare[1:] | held)
                counts += np.bincount(slots[:-1][mine] * np.int32(CLASSES) + slots[1:][mine], minlength=CLASSES * CLASSES)
                # The first place is an end, so every such word has one before it, and the last one an end behind it.
                at, words = np.flatnonzero(rare), part.column(3).flatten()
                side = lambda x: pa.array(slots[x].astype(np.int32), mask=rare[x])
                row, out = part.column(0).take(pa.array(doc[at - 1])), pa.array(held[at - 1])
                none, one = pa.nulls(len(at), pa.binary()), pa.array(np.ones(len(at), np.int64))
                yield pa.RecordBatch.from_arrays([row, out, none, side(at - 1), words, side(at + 1), one], names=names)
                two = np.flatnonzero(np.diff(at) == 1)
                if len(two):
                    k, unknown = pa.array(two), pa.nulls(len(two), pa.int32())
                    yield pa.RecordBatch.from_arrays([row.take(k), out.take(k), words.take(k), unknown, words.take(pa.array(two + 1)), unknown, one.take(k)], names=names)
        used = np.flatnonzero(counts)
        n, none = len(used), pa.nulls(len(used), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, -1)), pa.array(np.zeros(n, bool)), none, pa.array((used // CLASSES).astype(np.int32)), none, pa.array((used % CLASSES).astype(np.int32)), pa.array(counts[used])], names=names
        )

    return codes.select("row", "held", "codes", "rare").mapInArrow(run, RARE)


def resolved(rare: DataFrame, tail: DataFrame) -> DataFrame:
    """(row, held, before_class, word_class, after_class, times, n) with the classes of the words outside the head: the
    unknown ones have -1 and the count ``n`` 0. Pairs have no ``n`` and no class before."""
    of = tail.select("word", F.col("class").alias("word_class"), "n")
    columns = ["row", "held", "before_class", "word_class", "after_class", "times", "n"]
    known = lambda c: F.coalesce(c, F.lit(-1))
    single = rare.filter("before is null and word is not null").join(of, "word", "left").withColumn("word_class", known("word_class")).withColumn("n", F.coalesce("n", F.lit(0)))
    first = of.select(F.col("word").alias("before"), F.col("word_class").alias("first_class"))
    second = of.select("word", F.col("word_class").alias("second_class"))
    pairs = rare.filter("before is not null").join(first, "before", "left").join(second, "word", "left")
    pairs = pairs.withColumn("word_class", known("first_class")).withColumn("after_class", known("second_class")).withColumn("n", F.lit(None).cast("long"))
    within = rare.filter("word is null").withColumn("word_class", F.col("before_class")).withColumn("before_class", F.lit(None).cast("int")).withColumn("n", F.lit(None).cast("long"))
    return single.select(columns).unionByName(pairs.select(columns)).unionByName(within.select(columns))


def modelled(head: Head, classes: np.ndarray, tail: DataFrame, found: DataFrame, documents: int, words: tuple[int, int]) -> Model:
    """From the classes of all words and the neighbours in the training documents; ``words``: tokens and distinct words."""
    followed = np.zeros((CLASSES, CLASSES), np.int64)
    for r in found.filter("not held").groupBy("before_class", "word_class", "after_class").agg(F.sum("times").alias("n")).collect():
        for a, b in ((r.before_class, r.word_class), (r.word_class, r.after_class)):
            if a is not None and b is not None:
                followed[a, b] += r.n
    of, counts = classes[1 : head.end].astype(np.int64), head.counts[1:].astype(float)
    mass, types, single = (np.bincount(of, w, CLASSES).astype(float) for w in (counts, None, (counts == 1).astype(float)))
    twice = float((counts == 2).sum())
    seen = [F.count_if(F.col("n") == k).alias(f"seen{k}") for k in (1, 2)]
    for r in tail.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("types"), *seen).collect():
        mass[r["class"]] += r.n
        types[r["class"]] += r.types
        single[r["class"]] += r.seen1
        twice += r.seen2
    once = float(single.sum())
    discount = float(np.clip(once / (once + 2 * twice), 0.1, 0.9)) if once else 0.1
    unknown = int(single[1:].argmax()) + 1 if once else int(types[1:].argmax()) + 1
    mass[0], tokens, distinct = documents, words[0] + documents, words[1] + (documents > 0)
    base_total = tokens + ALPHA * (distinct + 1)
    # Classes without a word are never entered; the end always may come.
    used = (mass > 0) | (np.arange(CLASSES) == 0)
    share = np.where(used, followed.sum(axis=0) + 1, 0)
    moved = (followed + MU * share / share.sum()) / (followed.sum(axis=1, keepdims=True) + MU)
    left = discount * types / np.maximum(mass, 1)
    left[0] = 0
    # An unknown word has some probability also where no class has anything left.
    least = ALPHA / (base_total + 1)
    to_unknown = (1 - least) * (moved @ left) + least
    with np.errstate(divide="ignore"):
        transition = np.log10(np.concatenate([(1 - least) * moved, to_unknown[:, None]], axis=1))
    transition[np.isinf(transition)] = 0  # never read
    emission = np.zeros(head.end + 1)
    emission[1 : head.end] = np.log10((counts - discount) / mass[of])
    by_number = np.concatenate([[0], counts, [documents]])
    return Model(np.concatenate([[unknown], of, [0]]).astype(np.uint8), emission, np.log10((by_number + ALPHA) / base_total), by_number > 0, transition, mass, discount, base_total, unknown, tokens)


def head_scores(codes: DataFrame, model: Model, end: int) -> DataFrame:
    """(row, id, held, n_tokens, known, base, score) of each document, as far as its words are in the head."""
    shared = codes.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            flat, sizes = line(batch.column(3), end)
            left, right = flat[:-1], flat[1:]
            slots = m.classes[flat]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            inside = right > 0
            score = np.where(inside, m.emission[right], 0) + np.where(inside & (left > 0), m.transition[slots[:-1], slots[1:]], 0)
            sums = [np.add.reduceat(x, starts) for x in ((inside & m.known[right]).astype(np.int64), np.where(inside, m.base[right], 0), score)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, (sizes, *sums))], names=["row", "id", "held", "n_tokens", "known", "base", "score"])

    id_type = codes.schema["id"].dataType.simpleString()
    return codes.select("row", "id", "held", "codes").mapInArrow(run, f"row long, id {id_type}, held boolean, n_tokens long, known long, base double, score double")


def rest_scores(found: DataFrame, model: Model) -> DataFrame:
    """(row, more_known, more_base, more_score): what words outside the head add, with the transitions to and from them."""
    moved = F.array(*[F.lit(float(x)) for x in model.transition.ravel()])
    mass = F.array(*[F.lit(float(x)) for x in model.mass])
    rows = found.filter("row >= 0").select("row", "n", "before_class", "word_class", "after_class")
    come = lambda c: F.when(F.col(c) < 0, model.unknown).otherwise(F.col(c))
    go = lambda c: F.when(F.col(c) < 0, CLASSES).otherwise(F.col(c))
    step = lambda a, b: F.coalesce(F.get(moved, come(a) * (CLASSES + 1) + go(b)), F.lit(0.0))
    word, known = F.col("n").isNotNull(), F.col("n") > 0
    emitted = F.when(known, F.log10((F.col("n") - F.lit(model.discount)) / F.get(mass, go("word_class")))).otherwise(0.0)
    return rows.groupBy("row").agg(
        F.count_if(known).alias("more_known"),
        F.sum(F.when(word, F.log10((F.col("n") + F.lit(ALPHA)) / F.lit(model.base_total))).otherwise(0.0)).alias("more_base"),
        F.sum(step("before_class", "word_class") + step("word_class", "after_class") + emitted).alias("more_score"),
    )


def score(docs: DataFrame, held: F.Column, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, core: int = CORE, rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; the model learns from those
    that aren't ``held``."""
    ship_code(docs.sparkSession)
    texts = prepared(docs, held, id_col, text_col)
    vocabulary = materialize(count_words(texts.filter(~F.col("held"))))
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    known = head_of(vocabulary, head, core)
    codes = encoded(texts, known)
    training = codes.filter(~F.col("held"))
    documents = training.count()
    classes, pairs = clustered(training, known, rounds)
    others = materialize(placed(training, known, classes, pairs))
    numbered = others.filter("code is not null").select("code", "class").toArrow()
    classes = classes.copy()
    classes[numbered.column(0).to_numpy()] = numbered.column(1).to_numpy()
    tail = others.filter("code is null")
    found = materialize(resolved(rare_words(codes, known, classes), tail))
    model = modelled(known, classes, tail, found, documents, (total[0], total[1]))
    rest = rest_scores(found, model)
    got = head_scores(codes, model, known.end).join(if_small(materialize(rest)), "row", "left")
    return got.select(
        F.col("id").alias(id_col),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def op11_query(spark, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"), crc_bucket(F.col("doc_id"), 10) == 0)
