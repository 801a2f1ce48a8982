"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are compared as lower-cased runs of letters and digits, and as single letters in scripts
without spaces. A shared seed of SEED tokens makes a candidate pair, and the whole document is tiled with the whole item:
the longest matches of unmarked tokens, found by running Karp-Rabin hashes of falling length, are marked again and
again, so reordered passages still cover the item. A pair is a leak if the tiles cover at least ``threshold`` of the
item's tokens. Items below SEED tokens have no seed: such an item is a leak of the documents that hold it whole.

The benchmark is the query set and is taken in blocks of bounded size: each block's seeds are broadcast and every
document is read whole. Nothing is shuffled, no pair that shares no seed is formed, and a passage shared by many
documents costs each of them one tiling. Tiling keeps arrays of the length of the text and the item, never their
pairs, so repeated tokens cost no more than others.

Defined edge results: null, empty and letterless texts and items have no tokens and no leaks; repeated items and
repeated rows are reported each; of matches of one length that with the smallest place in the item, then in the text, is
marked first; null ids keep their rows; very long texts are tiled whole; columns of any other name are kept by
``drop_leaks`` and not read by ``find_leaks``; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_rows, materialize

#: Han, Kana, Thai, Lao, Myanmar and Khmer, which write without spaces: each letter is a token of its own.
_ALONE = "\u3005-\u3007\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\U00020000-\U0003ffff"
TOKEN = re.compile(rf"(?![_\W])[{_ALONE}]|(?:(?![{_ALONE}])[^\W_])+")
SEED = 5
#: Shortest tile; a tile may be shorter than a seed once the pair is a candidate.
TILE = 3
#: Characters of benchmark text per broadcast block.
BLOCK_CHARS = 16_000_000
PRIME = np.uint64(1_000_003)


#: The same for texts without such letters, which are most and take half the time this way.
ALONE, SPACED = re.compile(f"[{_ALONE}]"), re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    return (SPACED if text.isascii() or not ALONE.search(text) else TOKEN).findall(text)


def window_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of each window of ``length`` ids."""
    n = len(ids) - length + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(length):
        h = h * PRIME + ids[k : k + max(n, 0)]
    return h


#: Inverse of PRIME modulo 2^64.
INVERSE = np.uint64(pow(int(PRIME), -1, 1 << 64))
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Running:
    """Karp-Rabin hashes of the unmarked windows of one sequence, for any length, from running sums."""

    def __init__(self, ids: np.ndarray, marked: np.ndarray):
        n = len(ids)
        powers = np.ones(n + 1, np.uint64)
        np.multiply.accumulate(np.full(n, PRIME), out=powers[1:])
        self.back = np.ones(n + 1, np.uint64)
        np.multiply.accumulate(np.full(n, INVERSE), out=self.back[1:])
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * SPREAD * powers[:n], out=self.sums[1:])
        self.ids, self.marked = ids, marked

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the windows without a marked token."""
        n = len(self.ids) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        bad = np.concatenate([[0], np.cumsum(self.marked)])
        at = np.flatnonzero(bad[length:] == bad[:n])
        return at, (self.sums[at + length] - self.sums[at]) * self.back[at]

    def longest(self) -> int:
        """Length of the longest unmarked run."""
        edges = np.flatnonzero(np.concatenate([[True], self.marked, [True]]))
        return int(np.diff(edges).max()) - 1 if len(edges) > 1 else 0


def tile(text, item, least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (text start, item start, length) of non-overlapping longest matches, in marking order.

    Token 0 of ``text`` matches nothing. The greatest length at which unmarked windows of both agree is found by
    bisection, as a match of some length holds one of each smaller length; then all matches of that length are marked.
    """
    x, y = np.asarray(text, np.int64), np.asarray(item, np.int64)
    a, b, tiles = Running(x, x == 0), Running(y, np.zeros(len(y), bool)), []
    high = min(len(x), len(y))
    while True:
        high = min(high, a.longest(), b.longest())
        low = least - 1
        probe = high  # a copy in one piece is found at once
        while low < high:
            if np.isin(b.windows(probe)[1], a.windows(probe)[1]).any():
                low = probe
            else:
                high = probe - 1
            probe = (low + high + 1) // 2
        if low < least:
            return tiles
        tiles += mark(a, b, low)
        high = low - 1


def mark(a: Running, b: Running, length: int) -> list[tuple[int, int, int]]:
    """Mark all matches of ``length``, by place in the item, then in the text."""
    at, h = a.windows(length)
    order = np.argsort(h, kind="stable")
    at, h = at[order], h[order]
    out, next_free = [], {}
    for p, x in zip(*(v.tolist() for v in b.windows(length)), strict=True):
        if b.marked[p : p + length].any():
            continue
        k, end = next_free.get(x) or (int(np.searchsorted(h, np.uint64(x))), int(np.searchsorted(h, np.uint64(x), side="right")))
        while k < end:
            t = int(at[k])
            used = np.flatnonzero(a.marked[t : t + length])
            if len(used):  # on to the first place behind the last mark in the way
                k += int(np.searchsorted(at[k:end], t + int(used[-1]) + 1))
            elif not np.array_equal(a.ids[t : t + length], b.ids[p : p + length]):
                k += 1
            else:
                a.marked[t : t + length] = b.marked[p : p + length] = True
                out.append((t, p, length))
                break
        next_free[x] = (k, end)
    return out


class Index:
    """Seeds of one block of items: windows of SEED tokens, or a shorter item as a whole."""

    def __init__(self, items: list[tuple]):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[object, np.ndarray]] = []
        seeds: dict[int, list] = defaultdict(list)
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(text)], np.int64)
            if not len(ids):
                continue
            width = min(SEED, len(ids))
            seeds[width].append((window_hashes(ids.astype(np.uint64), width), len(self.items)))
            self.items.append((item_id, ids))
        self.seeds = {}
        for width, found in seeds.items():
            hashes = np.concatenate([h for h, _ in found])
            owner = np.concatenate([np.full(len(h), n) for h, n in found])
            order = np.argsort(hashes, kind="stable")
            self.seeds[width] = hashes[order], owner[order]
        # Every place of every item with the number of the window of TILE tokens that starts there; the last places of an
        # item start none and have number 0, which no text holds.
        windows = [window_hashes(ids.astype(np.uint64), TILE) if len(ids) >= TILE else np.zeros(0, np.uint64) for _, ids in self.items]
        self.windows, number = np.unique(np.concatenate([*windows, np.zeros(0, np.uint64)]), return_inverse=True)
        self.starts = np.cumsum([0, *(len(ids) for _, ids in self.items)])
        self.number = np.zeros(int(self.starts[-1]), np.int64)
        self.number[np.arange(len(number)) + np.repeat(self.starts[:-1] - np.cumsum([0, *map(len, windows)])[:-1], [len(w) for w in windows])] = number + 1

    def reachable(self, text: np.ndarray, items: np.ndarray, threshold: float, step: int = 1 << 20) -> np.ndarray:
        """Of ``items`` those with enough tokens in windows of TILE tokens that the text has. A tile is made of such
        windows, so no leak is left out; one pass over the items' places decides for all of them."""
        present = np.zeros(len(self.windows) + 1, bool)
        at = np.flatnonzero((text[:-2] > 0) & (text[1:-1] > 0) & (text[2:] > 0)) if len(text) >= TILE else np.zeros(0, np.int64)
        if not len(items) or not len(at) or not len(self.windows):
            return items[:0]
        h = np.unique(window_hashes(text.astype(np.uint64), TILE)[at])
        place = np.minimum(np.searchsorted(self.windows, h), len(self.windows) - 1)
        present[place[self.windows[place] == h] + 1] = True
        sizes = self.starts[items + 1] - self.starts[items]
        kept, ends = [], np.cumsum(sizes)
        low = 0
        while low < len(items):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + step, side="right")))
            mine, n = items[low:high], sizes[low:high]
            first = np.cumsum(n) - n
            f = present[self.number[np.arange(int(n.sum())) + np.repeat(self.starts[mine] - first, n)]]
            covered = f.copy()
            covered[1:] |= f[:-1]  # an item's last two places start no window, so nothing runs on into the next
            covered[2:] |= f[:-2]
            kept.append(mine[np.add.reduceat(covered.astype(np.int64), first) >= threshold * n])
            low = high
        return np.concatenate(kept)

    def leaks(self, texts: list[str | None], threshold: float) -> list[list[tuple]]:
        """Per text: (item id, coverage, matched tokens, item tokens, tiles, longest tile) of each leak."""
        get = self.vocabulary.get
        out: list[list[tuple]] = [[] for _ in texts]
        if not self.items:
            return out
        lists, base = [], [0]
        for text in texts:
            lists.append(np.array([get(w, 0) for w in tokens(text)], np.int64))
            base.append(base[-1] + len(lists[-1]) + SEED)
        flat = np.zeros(base[-1] + SEED, np.uint64)
        for ids, at in zip(lists, base, strict=False):
            flat[at : at + len(ids)] = ids
        known = np.concatenate([[0], np.cumsum(flat != 0)])
        found = [list(x) for x in zip(*[self.candidates(width, flat, known, base) for width in self.seeds], strict=True)] if self.seeds else []
        for d, shared in enumerate(found):
            text = lists[d]
            mine = np.unique(np.concatenate(shared))
            if not len(mine):
                continue
            short = self.starts[mine + 1] - self.starts[mine] < SEED
            for n in sorted([*mine[short].tolist(), *self.reachable(text, mine[~short], threshold).tolist()]):
                item_id, item = self.items[n]
                if len(item) < SEED:
                    if any(np.array_equal(text[t : t + len(item)], item) for t in np.flatnonzero(text[: len(text) - len(item) + 1] == item[0])):
                        out[d].append((item_id, 1.0, len(item), len(item), 1, len(item)))
                    continue
                tiles = tile(shared_runs(text, item), item)
                matched = sum(t[2] for t in tiles)
                if matched >= threshold * len(item):
                    out[d].append((item_id, matched / len(item), matched, len(item), len(tiles), max(t[2] for t in tiles)))
        return out

    def candidates(self, width: int, flat: np.ndarray, known: np.ndarray, base: list[int]) -> list[np.ndarray]:
        """Of each text the items with which it shares a seed of this width."""
        hashes, owner = self.seeds[width]
        out = [np.zeros(0, np.int64)] * (len(base) - 1)
        at = np.flatnonzero(known[width:] - known[:-width] == width)
        if not len(at):
            return out
        h = np.zeros(len(at), np.uint64)
        for k in range(width):
            h = h * PRIME + flat[at + k]
        low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
        hit = high > low
        doc = np.searchsorted(base, at[hit], side="right") - 1
        # One look at each distinct seed of a text, however often it is repeated; an item is marked, not listed, so a seed
        # that all items share costs one stroke.
        seen = np.unique(np.stack([doc, low[hit], high[hit]], 1), axis=0)
        if not len(seen):
            return out
        starts = np.flatnonzero(np.diff(seen[:, 0], prepend=-1))
        mark = np.zeros(len(self.items), bool)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(seen)], strict=True):
            if int((seen[a:b, 2] - seen[a:b, 1]).sum()) < len(mark) // 8:
                out[seen[a, 0]] = np.unique(np.concatenate([owner[x:y] for _, x, y in seen[a:b].tolist()]))
                continue
            mark[:] = False
            for _, x, y in seen[a:b].tolist():
                mark[owner[x:y]] = True
            out[seen[a, 0]] = np.flatnonzero(mark)
        return out


def shared_runs(text: np.ndarray, item: np.ndarray, least: int = TILE) -> np.ndarray:
    """The runs of at least ``least`` tokens of the item in the text, set apart by a 0: no tile lies outside them."""
    edge = np.diff(np.concatenate([[0], np.isin(text, item).astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= least
    parts = [v for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True) for v in (text[a:b], [0])]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int = BLOCK_CHARS):
    """(block, whether it is the last): the items in blocks of about ``block_chars`` characters, by the hash of the id and
    text; each is brought in on its own."""
    items = benchmark.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("text")).filter("text is not null")
    chars = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    for b in range(blocks):
        part = F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text", F.lit("block")), F.lit(blocks)) == b
        yield Index([(r.item_id, r.text) for r in items.filter(part).orderBy("item_id", "text").collect()]), b + 1 == blocks


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """One row per leak: document id, item_id, coverage, matched and item tokens, number of tiles, longest tile.

    Of several blocks each but the last is worked off and its broadcast released before the next is brought in.
    """
    leak = T.StructType(
        [T.StructField("item_id", benchmark.schema[item_id_col].dataType), T.StructField("coverage", T.DoubleType())]
        + [T.StructField(n, T.LongType()) for n in ("matched_tokens", "item_tokens", "n_tiles", "longest_tile")]
    )
    names, out = leak.names, None
    for index, last in item_blocks(benchmark, item_id_col, item_text_col, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def make(shared=shared):
            return lambda texts: {"leaks": [[dict(zip(names, x, strict=True)) for x in found] for found in shared.value.leaks(texts, threshold)]}

        got = map_rows(docs, [id_col], text_col, make, T.StructType([T.StructField("leaks", T.ArrayType(leak))]))
        got = got.select(id_col, F.explode("leaks").alias("x")).select(id_col, "x.*")
        if not last:
            got = materialize(got)
            shared.destroy()
        out = got if out is None else out.unionByName(got)
    return out


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """The documents without a leak, all columns as they were. Blocks are worked off as in ``find_leaks``."""
    columns = docs.columns
    mark = free_name(columns, "leak")
    for index, last in item_blocks(benchmark, item_id_col, item_text_col, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def make(shared=shared):
            return lambda texts: {mark: [bool(found) for found in shared.value.leaks(texts, threshold)]}

        docs = map_rows(docs, columns, text_col, make, T.StructType([T.StructField(mark, T.BooleanType())])).filter(~F.col(mark)).drop(mark)
        if not last:
            docs = materialize(docs)
            shared.destroy()
    return docs


def op6_query(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(docs, benchmark)
