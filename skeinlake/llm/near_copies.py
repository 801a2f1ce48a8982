"""Near copies by set similarity of word shingles: the part of the SimHash operator that takes a similarity.

Two texts are linked if the sets of their shingles have a Jaccard similarity of ``least`` or more. Texts with the same
set are collapsed first; the others get a SimHash fingerprint of their distinct shingles. Groups in which such texts meet
come from MinHash bands, as bit blocks can't give them: at 0.8, fingerprints differ by some ten bits and up to twice
that, and no choice of blocks that such a pair must share tells unrelated texts apart. BANDS keys of ROWS minima put a
pair at 0.8 into at least one common group but for 7 in 100,000. Each group is searched with the Gray-order index at
BOUND bits, which leaves out fewer still.

What the index proposes only forms provisional components; inside these every link is decided on the whole sets: first
each member against the component's smallest id, then the members that aren't linked to it against all others. So no link
rests on an estimate, and a group of mutual near copies costs one comparison a member.

Defined edge results: null, empty and word-less texts have the empty set and are copies of each other; fewer words than
a shingle form one shingle; texts of any length are read whole; a null id keeps its row but has no part in component
ids; repeated rows share a component, and an id that has several texts is linked by any of them; extra columns are not
read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship_code
from .common import if_small, join_named, map_rows, materialize
from .components import components
from .simhash import links, majority, near_duplicates, signed

SHINGLE = 5
SEED = 42
LEAST = 0.8
BANDS, ROWS = 24, 5
#: Bits by which the fingerprints of two linked texts are taken to differ at most. The mean at 0.8 is ten to twelve, with
#: a standard deviation of three.
BOUND = 24
#: A comparison holds at most about this many texts and shingles on each side; larger sides are cut, none is dropped.
SIDE_TEXTS, SIDE_SHINGLES = 1024, 1 << 20

_RNG = np.random.default_rng(20)
_MUL = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def shingle_set(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles of the lower-cased words."""
    words = " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass")
    if not words:
        return np.zeros(0, np.uint64)
    ends = [i for i, c in enumerate(words) if c == 32] if len(words) < 64 else np.flatnonzero(np.frombuffer(words, np.uint8) == 32).tolist()
    starts, ends = [0, *(e + 1 for e in ends)], [*ends, len(words)]
    h = xxhash.xxh64_intdigest
    got = {h(words[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=False)} or {h(words, seed)}
    return np.sort(np.fromiter(got, np.uint64, len(got)))


def band_keys(hashes: np.ndarray, step: int = 1 << 13) -> list[int]:
    """One signed key a band; texts without words have none."""
    if not len(hashes):
        return []
    low = np.full(len(_MUL), ~np.uint64(0))
    for k in range(0, len(hashes), step):
        part = hashes[k : k + step]
        np.minimum(low, (part[None, :] * _MUL[:, None] + _ADD[:, None]).min(axis=1), out=low)
    x = (low.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)
    x ^= x >> np.uint64(29)
    return (x * _MIX[0, 0] + _BAND).view(np.int64).tolist()


def similar(inter, a, b, least: float):
    """Whether Jaccard reaches the bound, from the sizes of the intersection and the sets."""
    return inter >= least * (a + b - inter) - 1e-9


def prints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, digest of the set, its size, fingerprint of the set, band keys). Map-only."""

    def make():
        def fn(texts):
            sets = [shingle_set(t, shingle) for t in texts]
            return {
                "digest": [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets],
                "n": [len(s) for s in sets],
                "fp": [signed(majority(s)) for s in sets],
                "keys": [band_keys(s) for s in sets],
            }

        return fn

    fields = [("digest", T.StringType()), ("n", T.LongType()), ("fp", T.LongType()), ("keys", T.ArrayType(T.LongType()))]
    return map_rows(docs, [id_col], text_col, make, T.StructType([T.StructField(n, t) for n, t in fields]))


def _against_first(batches, shingle: int, least: float):
    """Walk sorted (component, part, side) rows, the component's first text (side 0) before its members:
    (id, component, n, near), near telling whether a member is linked to the first."""
    first = np.zeros(0, np.uint64)
    for batch in batches:
        side, near = batch.column(2).to_pylist(), []
        for k, text in zip(side, batch.column(5), strict=True):
            mine = shingle_set(text.as_py(), shingle)
            if k == 0:
                first = mine
            near.append(bool(similar(len(np.intersect1d(mine, first, assume_unique=True)), len(mine), len(first), least)))
        members = pa.array(side, pa.int32()).to_numpy() > 0
        out = pa.RecordBatch.from_arrays([batch.column(3), batch.column(0), batch.column(4), pa.array(near, pa.bool_())], names=["id", "component", "n", "near"])
        yield out.filter(pa.array(members))


def side_links(left: list[np.ndarray], right: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """All pairs (position left, position right) that reach the bound; sets of size zero reach none."""
    right_n = np.array([len(s) for s in right])
    flat = np.concatenate(right)
    vocabulary, place = np.unique(flat, return_inverse=True)
    at = np.concatenate([[0], np.cumsum(right_n)[:-1]])
    mark = np.zeros(len(vocabulary) + 1, np.int32)
    out = []
    for k, s in enumerate(left):
        if not len(s):
            continue
        hit = np.searchsorted(vocabulary, s)
        hit = hit[(hit < len(vocabulary)) & (vocabulary[np.minimum(hit, len(vocabulary) - 1)] == s)]
        if not len(hit):
            continue
        mark[hit] = 1
        inter = np.add.reduceat(mark[place], at)
        mark[hit] = 0
        out += [(k, int(j)) for j in np.flatnonzero(similar(inter, len(s), right_n, least))]
    return out


def _compare(batches, shingle: int, least: float):
    """Walk sorted (component, i, j) groups, left side first; edges of the links found."""

    def flush(left, right):
        if not left or not right:
            return None
        up: dict[int, int] = {}
        a, b = [], []

        def root(x):
            while up.get(x, x) != x:
                x = up[x]
            return x

        for x, y in side_links([s for _, s in left], [s for _, s in right], least):
            x, y = left[x][0], right[y][0]
            rx, ry = root(x), root(y)
            if rx != ry:
                up[max(rx, ry)] = min(rx, ry)
                a.append(x)
                b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]) if a else None

    known, sides = None, ([], [])
    for batch in batches:
        for c, i, j, side, ident, text in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5), strict=True):
            if (c, i, j) != known:
                if (got := flush(*sides)) is not None:
                    yield got
                known, sides = (c, i, j), ([], [])
            s = shingle_set(text.as_py(), shingle)
            if len(s):
                sides[side].append((ident, s))
    if (got := flush(*sides)) is not None:
        yield got


def _parts(cond) -> F.Column:
    """Number of slices of the rows of a component that meet a condition."""
    texts, shingles = F.count_if(cond), F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return F.greatest(F.ceil(texts / F.lit(SIDE_TEXTS)), F.ceil(shingles / F.lit(SIDE_SHINGLES))).cast("int")


def confirmed(proposed: DataFrame, texts: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """Edges (a, b) whose components are those of the exact links within the proposed components.

    ``proposed`` has id, component (its smallest id) and n; ``texts`` has (id, text), several rows of an id included.
    """
    ship_code(proposed.sparkSession)
    # The first text stands before each part of the other members.
    sizes = proposed.groupBy("component").agg(F.ceil(F.count("*") / F.lit(SIDE_TEXTS)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")).cast("int").alias("part")
    members = proposed.filter("id <> component").join(sizes, "component").select("component", part, F.lit(1).alias("side"), "id", "n")
    heads = sizes.select("component", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("component").alias("id"), F.lit(0).cast("long").alias("n"))
    rows = if_small(materialize(members.unionByName(heads))).join(texts, "id").select("component", "part", "side", "id", "n", "text")
    rows = rows.repartition("component", "part").sortWithinPartitions("component", "part", "side")
    tried = materialize(rows.mapInArrow(lambda b: _against_first(b, shingle, least), "id long, component long, n long, near boolean"))
    open_ = tried.groupBy("component").agg(_parts(~F.col("near")).alias("ni"), _parts(F.lit(True)).alias("nj"), F.count_if(~F.col("near")).alias("far"), F.count("*").alias("all"))
    open_ = open_.filter("far > 0 and all > 1")
    left_over = tried.join(open_, "component")
    # The first text has been compared with everyone; of the others, the far ones (left) meet all (right).
    i, j = F.pmod(F.xxhash64("id", F.lit("i")), F.col("ni")).cast("int"), F.pmod(F.xxhash64("id", F.lit("j")), F.col("nj")).cast("int")
    left = left_over.filter(~F.col("near")).select("component", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), F.lit(0).alias("side"), "id")
    right = left_over.select("component", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), j.alias("j"), F.lit(1).alias("side"), "id")
    group = ["component", "i", "j"]
    placed = if_small(materialize(left.unionByName(right).distinct())).join(texts, "id").select(*group, "side", "id", "text").repartition(*group).sortWithinPartitions(*group, "side")
    found = placed.mapInArrow(lambda b: _compare(b, shingle, least), "a long, b long")
    return tried.filter("near").select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(found)


def similar_texts(docs: DataFrame, id_col: str, text_col: str, shingle: int, bound: int, least: float) -> DataFrame:
    """One row per document: id, fp, component_id (the smallest id reachable over links)."""
    rows = materialize(prints(docs, id_col, text_col, shingle))
    same = materialize(
        rows.groupBy("digest").agg(F.min(id_col).cast("long").alias("id"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    )
    # The keys of different bands differ by their hash.
    keyed = same.filter("id is not null").select("fp", "id", F.lit(0).alias("t"), F.explode("keys").alias("key"))
    proposed = components(links(same, bound, keyed=keyed))
    proposed = materialize(proposed.withColumnRenamed("node", "id").join(same.groupBy("id").agg(F.max("n").alias("n")), "id"))
    # Only texts with a proposed link are read again.
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = components(confirmed(proposed, texts, shingle, least))
    named = same.join(found, same["id"] == found["node"], "left").select("digest", "rows", F.coalesce("component", "id").alias("component_id"))
    return join_named(rows, named, "digest").select(id_col, "fp", "component_id")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """One row per document: id, component_id."""
    return near_duplicates(docs, id_col, text_col, shingle, bound=BOUND, similarity=least).select(id_col, "component_id")
