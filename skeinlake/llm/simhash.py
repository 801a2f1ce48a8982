"""SimHash near-duplicate detection with a Gray-order hierarchical index.

Every text gets a 64-bit fingerprint of its word shingles. Distinct fingerprints are grouped so that each pair within
the distance bound meets in at least one group: they agree exactly on some choice of bit blocks. Each group, of whatever
size, is searched with a hierarchy built over its fingerprints in Gray order: a node keeps the bits all its members
share, a child only the further ones, and whole nodes are dropped once the accumulated differences pass the bound, or
once all their members are connected with the query. A group emits a spanning forest, never all its pairs. Oversized
groups are cut into chunks and each pair of chunks is its own group, so nothing unbounded meets in one task and no pair
is lost.

With ``similarity`` given, texts are linked by the Jaccard similarity of their sets of shingles: see ``near_copies``.

Defined edge results: null, empty and word-less texts have fingerprint zero and are linked like any other; fewer words
than a shingle form one shingle; texts of any length are read whole; ids are whole numbers, other types are an error; a
null id keeps its row but has no part in component ids; repeated rows share a component; extra columns are not read,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship_code
from .common import HOT_ROWS, join_counted, join_named, map_rows, materialize
from .components import components

BITS = 64
#: A group of more fingerprints than this is cut into chunks of about this many.
CHUNK = 4096
#: Nodes under a node.
FANOUT = 16


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Majority bits of XXH64 over word shingles; words are runs of non-space characters, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: -shingle]]).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    return majority(np.array([h(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], dtype="<u8"))


def majority(hashes: np.ndarray, step: int = 1 << 16) -> int:
    """The bits set in over half the hashes."""
    counts, n = np.zeros(BITS, np.int64), len(hashes)
    for k in range(0, n, step):
        bits = np.unpackbits(hashes[k : k + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(((counts * 2 > n).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(dtype=np.uint64))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint as a signed long. Map-only."""

    def make():
        return lambda texts: {"fp": [signed(fingerprint(t, shingle, seed)) for t in texts]}

    return map_rows(docs, [id_col], text_col, make, T.StructType([T.StructField("fp", T.LongType())]))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of a code word in the reflected Gray sequence (prefix exclusive-or from the top bit)."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Fingerprints of one or several groups in Gray order, under one tree of shared masked bits for each group.

    Level 0 are the fingerprints; each node above covers up to FANOUT nodes below, up to the root of its group.
    ``shared[l]`` marks the bits on which all members of a node agree and ``value[l]`` holds them. A child's residual is
    what it shares beyond its parent.
    """

    def __init__(self, fps: np.ndarray, group: np.ndarray | None = None):
        group = np.zeros(len(fps), np.int64) if group is None else group
        self.order = np.lexsort((gray_rank(fps), group))
        own = group[self.order]
        self.roots = np.unique(own)
        self.shared, self.value, self.first = [np.full(len(fps), ~np.uint64(0))], [fps[self.order]], []
        self.labels: list[np.ndarray] | None = None
        while not self.first or len(own) > len(self.roots):
            mask, val = self.shared[-1], self.value[-1]
            place = np.arange(len(own)) - np.searchsorted(own, own)
            at = np.flatnonzero(place % FANOUT == 0)
            if len(at):
                all_and, all_or, agree = (f.reduceat(x, at) for f, x in ((np.bitwise_and, val), (np.bitwise_or, val), (np.bitwise_and, mask)))
            else:
                all_and = all_or = agree = val
            agree = agree & ~(all_and ^ all_or)
            self.shared.append(agree)
            self.value.append(all_and & agree)
            self.first.append(np.append(at, len(own)))
            own = own[at]

    def label(self, labels: np.ndarray) -> None:
        """Give each member a label (0 or more); a node has that of its members if it is one, else -1."""
        self.labels = [labels[self.order]]
        for first in self.first:
            low, high = (f.reduceat(self.labels[-1], first[:-1]) for f in (np.minimum, np.maximum))
            self.labels.append(np.where(low == high, low, -1))

    def links(self, queries: np.ndarray, bound: int, step: int = 1 << 20, group: np.ndarray | None = None, labels: np.ndarray | None = None):
        """Yield (query index, member index) arrays of all pairs of a group at most ``bound`` bits apart.

        With ``labels`` of the queries, nodes that have the query's label throughout are left out; both kinds of labels
        may be changed between two yields.
        """
        top = len(self.first)
        if not len(self.roots) or not len(queries):
            return
        root = np.zeros(len(queries), np.int64) if group is None else np.searchsorted(self.roots, group)
        there = np.ones(len(queries), bool) if group is None else self.roots[np.minimum(root, len(self.roots) - 1)] == group
        todo = []
        for k in range(0, len(queries), step):
            q = np.flatnonzero(there[k : k + step]) + k
            todo.append((top, q, root[q], np.zeros(len(q), np.uint8), None))
        todo.reverse()
        while todo:
            level, who, node, spent, parent = todo.pop()
            residual = self.shared[level][node]
            if parent is not None:
                residual = residual & ~self.shared[level + 1][parent]
            spent = spent + np.bitwise_count((queries[who] ^ self.value[level][node]) & residual)
            keep = spent <= bound
            if labels is not None:
                keep &= self.labels[level][node] != labels[who]
            who, node, spent = who[keep], node[keep], spent[keep]
            if not len(who):
                continue
            if level == 0:
                yield who, self.order[node]
                continue
            first = self.first[level - 1]
            width = max(1, step // FANOUT)
            for cut in reversed(range(0, len(who), width)):
                up = node[cut : cut + width]
                times = first[up + 1] - first[up]
                ends = np.cumsum(times)
                child = np.arange(ends[-1]) - np.repeat(ends - times, times) + np.repeat(first[up], times)
                todo.append((level - 1, np.repeat(who[cut : cut + width], times), child, np.repeat(spent[cut : cut + width], times), np.repeat(up, times)))


def forest(fps: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray, bound: int, step: int = 1 << 20) -> list[tuple[int, int]]:
    """Edges that connect all rows whose links lie between the ``left`` and the ``right`` rows of a group.

    ``group`` is sorted. Neighbours in Gray order are linked first; after that a query only looks at nodes that aren't
    connected with it as a whole, so a dense group doesn't cost its pairs.
    """
    members, asking = np.flatnonzero(right), np.flatnonzero(left)
    index = GrayIndex(fps[members], group[members])
    labels = np.arange(len(fps))
    chain = members[index.order]
    a, b = chain[:-1], chain[1:]
    near = (group[a] == group[b]) & (np.bitwise_count(fps[a] ^ fps[b]) <= bound)
    edges = list(zip(a[near].tolist(), b[near].tolist(), strict=True))
    if len(chain):
        labels[chain] = chain[np.maximum.accumulate(np.where(np.append(False, near), 0, np.arange(len(chain))))]
    index.label(labels[members])
    own = labels[asking]
    for x, y in index.links(fps[asking], bound, step, group[asking], own):
        x, y = asking[x], members[y]
        pairs, at = np.unique(np.stack([labels[x], labels[y]], 1), axis=0, return_index=True)
        up: dict[int, int] = {}

        def root(i, up=up):
            while i in up:
                i = up[i]
            return i

        for (p, q), k in zip(pairs.tolist(), at.tolist(), strict=True):
            p, q = root(p), root(q)
            if p != q:
                up[max(p, q)] = min(p, q)
                edges.append((int(x[k]), int(y[k])))
        if up:
            new = np.arange(len(fps))
            for i in up:
                new[i] = root(i)
            labels = new[labels]
            index.label(labels[members])
            own[:] = labels[asking]
    return edges


def blocks_for(n: int, bound: int) -> int:
    """Number of bit blocks: more fingerprints, more blocks to agree on, so groups stay small; any choice is exact."""
    extra = 1 if n <= 1 << 25 else 2 if n <= 1 << 31 else 3
    return bound + extra


def tables(blocks: int, bound: int) -> list[int]:
    """Masks: each choice of ``blocks - bound`` blocks that a pair within the bound must share at least once."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(masks, blocks - bound)]


def block_groups(fps: DataFrame, bound: int) -> DataFrame:
    """(fp, id, t, key): each fingerprint under each choice of bit blocks."""
    masks = tables(blocks_for(fps.count(), bound), bound)
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)])
    return fps.select("fp", "id", F.explode(keys).alias("k")).select("fp", "id", "k.t", "k.key")


def links(fps: DataFrame, bound: int = 4, chunk: int = CHUNK, keyed: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Edges (a, b) of representatives; ``fps`` has distinct fp and its representative id.

    Every two fingerprints of a group that are within the bound are connected by emitted edges. The groups are those of
    the bit blocks, in which every pair within the bound meets, or those of ``keyed`` (fp, id, t, key). A group's size and
    its head are broadcast to its rows if it has more than ``hot_rows``, so it is cut into chunks where its rows are.
    """
    ship_code(fps.sparkSession)
    keyed = block_groups(fps, bound) if keyed is None else keyed
    group, total = ["t", "key"], keyed.count()
    sizes = keyed.groupBy(*group).agg(F.count("*").alias("rows")).filter("rows > 1")
    keyed = join_counted(keyed, sizes.withColumn("size", F.col("rows")), group, total, hot_rows)
    small = keyed.filter(F.col("size") <= chunk).select(*group, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"), "fp", "id")
    # Rows near the head of an oversized group are connected by it; only the others are compared with all.
    big = keyed.filter(F.col("size") > chunk)
    heads = big.groupBy(*group).agg(F.min("id").alias("head"), F.min_by("fp", "id").alias("head_fp"), F.count("*").alias("rows"))
    big = join_counted(big, heads, group, total, hot_rows)
    big = big.withColumn("near", F.bit_count(F.col("fp").bitwiseXOR(F.col("head_fp"))) <= bound)
    counts = big.groupBy(*group).agg(F.count_if(~F.col("near")).alias("far"), F.count("*").alias("rows")).filter("far > 0")
    open_ = join_counted(big, counts, group, total, hot_rows)
    far = F.ceil(F.col("far") / F.lit(chunk)).cast("int")
    near = F.ceil((F.col("size") - F.col("far")) / F.lit(chunk)).cast("int")
    mixed = F.xxhash64("fp", "id", F.lit("chunk"))
    open_ = open_.withColumn("own", F.when(F.col("near"), far + F.pmod(mixed, near)).otherwise(F.pmod(mixed, far)).cast("int"))
    open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("near"), far - 1).otherwise(far + near - 1))))
    open_ = open_.select(*group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", "id")
    group += ["i", "j"]
    placed = small.unionByName(open_).repartition(*group).sortWithinPartitions(*group, "own")
    found = placed.mapInArrow(lambda batches: _search(batches, bound), "a long, b long")
    return found.unionByName(big.filter("near and id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))).distinct()


def _search(batches, bound: int):
    """Walk sorted groups, carrying an unfinished group over batch ends; one group is at most two chunks."""
    held: list[pa.RecordBatch] = []
    for batch in _with_end(batches):
        if batch is not None:
            held.append(batch)
            if sum(b.num_rows for b in held) < 1 << 16:
                continue
        if not held:
            continue
        rows = pa.Table.from_batches(held)
        cols = [rows.column(i).to_numpy() for i in range(7)]
        change = np.zeros(len(cols[0]), bool)
        for c in cols[:4]:
            change[1:] |= c[1:] != c[:-1]
        end = len(change)
        if batch is not None:
            end = int(np.flatnonzero(change)[-1]) if change.any() else 0
            held = rows.slice(end).to_batches()
        else:
            held = []
        group, fps, ids = np.cumsum(change)[:end], cols[5].view(np.uint64)[:end], cols[6][:end]
        # Within a chunk all rows ask all rows; of two chunks the first asks the second.
        same = cols[2][:end] == cols[3][:end]
        first = cols[4][:end] == cols[2][:end]
        edges = forest(fps, group, same | first, same | ~first, bound)
        if edges:
            a, b = np.array(edges, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64())], names=["a", "b"])


def _with_end(batches):
    yield from batches
    yield None


def whole_ids(docs: DataFrame, id_col: str) -> None:
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"component ids need whole numbers, {id_col} is {kind.simpleString()}")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, bound: int = 4, similarity: float | None = None
) -> DataFrame:
    """One row per document: id, fp (signed long), component_id (the smallest id reachable over links).

    Two fingerprints are linked at ``bound`` or fewer differing bits. With ``similarity``, fingerprints are those of the
    distinct shingles, and texts are linked if the Jaccard similarity of these sets reaches it, ``bound`` being the most
    bits two such texts are taken to differ by.
    """
    whole_ids(docs, id_col)
    if similarity is not None:
        from .near_copies import similar_texts

        return similar_texts(docs, id_col, text_col, shingle, bound, similarity)
    prints = materialize(fingerprints(docs, id_col, text_col, shingle, seed))
    distinct = materialize(prints.groupBy("fp").agg(F.min(id_col).cast("long").alias("id"), F.count("*").alias("rows")))
    found = components(links(distinct.filter("id is not null"), bound))
    named = distinct.join(found, distinct["id"] == found["node"], "left").select("fp", "rows", F.coalesce("component", "id").alias("component_id"))
    return join_named(prints, named, "fp").select(id_col, "fp", "component_id")


def op4_query(spark, sf_dir: str) -> DataFrame:
    got = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
