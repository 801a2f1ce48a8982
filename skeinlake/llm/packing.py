"""Packing of token sequences by best-fit decreasing.

A document's ids (byte-level BPE, then an end id) are cut into full windows first; what remains is one piece of fewer
ids than a window. Pieces go, longest first, into the open window with the least room that still holds them.

Piece lengths are integers up to the window, so the plan is computed on the histogram of lengths: open windows with
equal contents are kept as one group with a count, a segment tree indexed by remaining capacity finds the tightest
group, and a whole group is filled per step. The histogram has at most ``window`` rows however many documents there
are. A piece finds its place by its rank among the pieces of its length; ranks come from per-task counters plus an
exact prefix sum over (length, task), so no length is ever gathered into one task.

Defined edge results: null and empty texts are one piece holding the end id; equal lengths are ranked by task and
position; repeated rows are packed separately; null ids keep their rows; a text of any length is cut into as many full
windows as it fills; extra columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship_code
from .common import materialize, split_batch

WINDOW = 1024
VOCABULARY = "byte_bpe_50k"


@functools.cache
def encoder(vocabulary: str = VOCABULARY, folder: str | None = None):
    """A function from text to its ids as a uint32 array.

    ``folder`` holds ``<vocabulary>.json`` and the same vocabulary as ranks, ``<vocabulary>.tiktoken``; by default it
    is that of the installed ``public_tokenizers``. The rank form encodes several times faster and splits every code
    point alike (a test compares them); texts with a special token's string, and those it can't split, take the other
    library, so ids are always those of ``tokenizers``.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    def path(name: str) -> str:
        return f"{folder}/{name}" if folder else public_tokenizers.path(name)

    with open(path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(path(f"{vocabulary}.json"))
    special = [t.content for t in exact.get_added_tokens_decoder().values()]

    def encode(text: str) -> np.ndarray:
        if not any(s in text for s in special):
            try:
                return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
            except ValueError:  # its splitter gives up on runs of about a million white-space characters
                pass
        return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


PIECES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "part", "local_rank")]
)


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 0, vocabulary: str = VOCABULARY, folder: str | None = None
) -> DataFrame:
    """One row per piece: full windows first, then the rest; with the task and the rank within (task, length)."""
    ship_code(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("__text"))
    schema = T.StructType([src.schema[id_col], *PIECES.fields])

    def run(batches):
        encode, seen, part = encoder(vocabulary, folder), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            for cut in split_batch(batch, 1):
                owner, rows = [], []
                for i, text in enumerate(cut.column(1).to_pylist()):
                    ids = np.append(encode(text) if text else np.zeros(0, np.uint32), np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        owner.append(i)
                        rows.append((start, len(piece), zlib.crc32(piece.tobytes()), len(ids), part, seen[len(piece)]))
                        seen[len(piece)] += 1
                if rows:
                    cols = np.array(rows, np.int64).T
                    yield pa.RecordBatch.from_arrays(
                        [cut.column(0).take(pa.array(owner, pa.int64())), *[pa.array(c) for c in cols]],
                        names=[id_col, *PIECES.names],
                    )

    return src.mapInArrow(run, schema)


class Capacities:
    """A segment tree over remaining capacities 0..window: the smallest capacity >= need that has open windows."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, capacity: int, count: int) -> None:
        i = capacity + self.size
        while i:
            self.tree[i] += count
            i >>= 1

    def tightest(self, need: int) -> int | None:
        i = need + self.size
        if self.tree[i]:
            return need
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram {length: count}.

    Returns (length, first rank, number of pieces, first sequence, offset, pieces per sequence): piece of rank r lies
    in sequence ``first + (r - rank) // per`` at ``offset + (r - rank) % per * length``. Placing pieces one at a time
    fills the tightest window until the length no longer fits, so a group of n equal windows takes n times that many.
    """
    open_windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
    tree, out, sequences = Capacities(window), [], 0

    def put(capacity: int, first: int, count: int) -> None:
        if count and capacity:
            open_windows[capacity].append((first, count))
            tree.add(capacity, count)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                per = window // length
                first, count, room = sequences, -(-left // per), window
                sequences += count
            else:
                first, count = open_windows[room].pop()
                tree.add(room, -count)
                per = room // length
            whole = min(count, left // per)
            base = window - room
            if whole:
                out.append((length, rank, whole * per, first, base, per))
                put(room - per * length, first, whole)
                rank, left = rank + whole * per, left - whole * per
            if whole < count and left:
                out.append((length, rank, left, first + whole, base, per))
                put(room - left * length, first + whole, 1)
                put(room, first + whole + 1, count - whole - 1)
                rank, left = rank + left, 0
            elif whole < count:
                put(room, first + whole, count - whole)
    return out


PLAN = "length long, rank_from long, n long, seq_from long, base long, per long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **tokens) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, id_col, text_col, window, **tokens))
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_base"))
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most ``window`` rows
    steps = F.broadcast(spark.createDataFrame(plan(histogram, window), PLAN))  # grows with window, not with rows
    ranked = cut.join(offsets, ["length", "part"]).withColumn("rank", F.col("rank_base") + F.col("local_rank"))
    s, r = steps.alias("s"), ranked.alias("r")
    at = F.col("r.rank") - F.col("s.rank_from")
    hit = (F.col("r.length") == F.col("s.length")) & (at >= 0) & (at < F.col("s.n"))
    return r.join(s, hit).select(
        F.col(f"r.{id_col}"),
        "r.start",
        "r.length",
        "r.ids_crc32",
        "r.doc_tokens",
        (F.col("s.seq_from") + F.floor(at / F.col("s.per"))).cast("long").alias("sequence_id"),
        (F.col("s.base") + at % F.col("s.per") * F.col("r.length")).cast("long").alias("offset"),
    )


def op3_query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
