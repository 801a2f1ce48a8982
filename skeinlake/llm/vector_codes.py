"""Compressing vectors to codes: one small codebook for each part of the vector, the nearest entry found in a metric tree.

Components become integers (``floor(4096 * x)``), vectors are cut into equal parts, and each part position has a codebook
that starts as that part of the first vectors and moves to the integer means of its members in each round. All arithmetic
that decides anything is on integers, so results don't depend on the order of rows, tasks or additions.

The nearest entry comes from a vantage-point tree over the entries of a part position. Every node holds one entry; the
others are split at the median of their distance to it, and each half knows the least and the greatest of these
distances, rounded outwards to integers. A half is visited unless its lower bound by the triangle inequality is *above*
the best distance so far: entries at equal distance are still met, and the lower index is taken. Candidates are compared
by exact squared distances. A batch of vectors goes down the tree at once.

A round is one map over the vectors; a task sends one sum for each part, entry and component.

Defined edge results: rows whose vector is null, or has a null or non-finite component, are dropped, and so are rows
whose length isn't a positive multiple of the number of parts or isn't that of the first vector; of an id's different
vectors the smallest in array order starts an entry, null ids come after all others there; with fewer ids than entries
the codebooks are as much smaller; integers beyond ``limit`` (2^27 for parts of eight) are set to it, as squares of their
differences wouldn't fit in 64 bits; null labels are one label; repeated rows count each and get equal codes; extra
columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_code
from .common import BROADCAST_ROWS, HOT_ROWS, join_named, materialize, read_table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096


def limit(length: int) -> int:
    """Integers up to this have squared distances over whole vectors of ``length`` components below 2^62."""
    return isqrt(2**62 // length) // 2


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(4096 * x) of finite components, within the limit."""
    most = limit(max(1, vectors.shape[1]))
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -most, most).astype(np.int64)


class Vantage:
    """A node: an entry, the nearer and the farther half of the other entries, and bounds of each half's distances."""

    def __init__(self, entries: np.ndarray, own: list[int]):
        self.index, self.at, self.halves = own[0], entries[own[0]], []
        rest = own[1:]
        square = {i: int(((entries[i] - self.at) ** 2).sum()) for i in rest}
        rest.sort(key=lambda i: (square[i], i))
        cut = (len(rest) + 1) // 2
        self.split = square[rest[cut - 1]] if rest else 0
        for half in (rest[:cut], rest[cut:]):
            if half:
                low, high = square[half[0]], square[half[-1]]
                self.halves.append((isqrt(low), isqrt(high) + (isqrt(high) ** 2 < high), Vantage(entries, sorted(half))))


def nearest(root: Vantage, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, its squared distance) for each row of ``points``; ties to the lower index."""
    best = np.full(len(points), np.iinfo(np.int64).max)
    index = np.full(len(points), np.iinfo(np.int64).max)

    def visit(node: Vantage, rows: np.ndarray) -> None:
        square = ((points[rows] - node.at) ** 2).sum(axis=1)
        closer = (square < best[rows]) | ((square == best[rows]) & (node.index < index[rows]))
        best[rows[closer]], index[rows[closer]] = square[closer], node.index
        if not node.halves:
            return
        root_of = np.sqrt(square.astype(np.float64))
        low, high = np.floor(root_of).astype(np.int64) - 1, np.ceil(root_of).astype(np.int64) + 1
        inside = square <= node.split
        for mine, order in ((inside, node.halves), (~inside, node.halves[::-1])):
            group, group_low, group_high = rows[mine], low[mine], high[mine]
            for least, most, half in order:
                gap = np.maximum(0, np.maximum(group_low - most, least - group_high))
                reach = gap * gap <= best[group]
                if reach.any():
                    visit(half, group[reach])

    if len(points):
        visit(root, np.arange(len(points)))
    return index, best


@dataclass
class Codebooks:
    """``entries`` is [parts, entries, width] of integers."""

    entries: np.ndarray

    @property
    def length(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def trees(self) -> list[Vantage]:
        return [Vantage(book, list(range(len(book)))) for book in self.entries]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> np.ndarray:
        """The vector that a code stands for, in units of the integers."""
        return np.concatenate([book[int(code[2 * k : 2 * k + 2], 16)] for k, book in enumerate(self.entries)])


def finite(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Rows whose vector is there and has finite components only."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(v.isNotNull() & ~F.coalesce(bad, F.lit(True)))


def matrix(column: pa.ListArray, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def first_vectors(kept: DataFrame, many: int) -> np.ndarray:
    """Vectors of the smallest ids that have the length of the first: each task sends its smallest ones, the rest is a top-k of
    a few rows a task."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = (i is None, i or 0)
                if key in held or len(held) < many or key < max(held):
                    held[key] = min(held.get(key, v), v)
                    if len(held) > many:
                        del held[max(held)]
        yield pa.RecordBatch.from_pydict({"id": [None if none else i for none, i in held], "v": list(held.values())}, pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64()))]))

    got = kept.select("id", "v").mapInArrow(smallest, "id long, v array<double>")
    rows = got.groupBy("id").agg(F.min("v").alias("v")).orderBy(F.col("id").asc_nulls_last()).limit(many).collect()
    lengths = {len(r.v) for r in rows}
    if len(lengths) > 1:
        return first_vectors(kept.filter(F.size("v") == len(rows[0].v)), many)
    return np.array([r.v for r in rows], np.float64).reshape(len(rows), max(lengths, default=0))


def named(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None = None) -> DataFrame:
    cols = [F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")]
    if label_col:
        cols.append(F.col(f"`{label_col}`").alias("label"))
    return finite(vectors, vector_col).select(*cols)


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks over all rows; None without a usable row. What reaches the driver is one row for each part, entry and
    component in a round."""
    ship_code(vectors.sparkSession)
    kept = named(vectors, id_col, vector_col)
    start = first_vectors(kept.filter((F.size("v") > 0) & (F.size("v") % PARTS == 0)), entries)
    length = start.shape[1]
    if not length:
        return None
    width = length // PARTS
    books = Codebooks(integers(start).reshape(len(start), PARTS, width).transpose(1, 0, 2).copy())
    used = kept.filter(F.size("v") == length).select("v")
    for _ in range(rounds):
        found = used.mapInArrow(sums(books), "part int, entry int, total array<long>")
        cells = found.select("part", "entry", F.posexplode("total").alias("pos", "s")).groupBy("part", "entry", "pos").agg(F.sum("s").alias("s")).collect()
        total = np.zeros((*books.entries.shape[:2], width + 1), np.int64)
        for r in cells:
            total[r.part, r.entry, r.pos] = r.s
        n = total[:, :, width:]
        books = Codebooks(np.where(n > 0, np.floor_divide(total[:, :, :width], np.maximum(n, 1)), books.entries))
    return books


def sums(books: Codebooks):
    """Of a task's vectors: the sum of each component and the number of members, by part and entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (parts, entries, width), trees = books.entries.shape, books.trees()
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            cut = integers(matrix(batch.column(0), books.length)).reshape(-1, parts, width)
            for p in range(parts):
                at, _ = nearest(trees[p], cut[:, p])
                for e in np.unique(at):
                    total[p, e, :width] += cut[at == e, p].sum(axis=0)
                total[p, :, width] += np.bincount(at, minlength=entries)
        part, entry = np.nonzero(total[:, :, width])
        yield pa.RecordBatch.from_pydict(
            {"part": part, "entry": entry, "total": total[part, entry].tolist()}, pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("total", pa.list_(pa.int64()))])
        )

    return run


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, code, error) of every usable row. Map-only."""
    ship_code(vectors.sparkSession)
    rows = named(vectors, id_col, vector_col, label_col).filter(F.size("v") == books.length).select("id", "label", "v")
    label_type = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, (parts, _, width) = books.trees(), books.entries.shape
        hexed = np.array([f"{k:02x}" for k in range(256)])
        for batch in batches:
            cut = integers(matrix(batch.column(2), books.length)).reshape(-1, parts, width)
            code, error = np.zeros(len(cut), "U0"), np.zeros(len(cut), np.int64)
            for p in range(parts):
                at, square = nearest(trees[p], cut[:, p])
                code, error = np.char.add(code, hexed[at]), error + square
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code.tolist(), pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return rows.mapInArrow(run, f"id long, label {label_type}, code string, error long")


def op12_query(spark, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    books = train(vectors)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = materialize(encode(vectors, books).withColumn("label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))))
    labels = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")))
    # A hot label isn't brought into one task: few labels are broadcast, and of many the hot ones.
    joined = coded.join(F.broadcast(labels.drop("rows")), "label") if labels.count() <= BROADCAST_ROWS else join_named(coded, labels, "label", HOT_ROWS)
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _sql() -> str:
    """The same in SQL, a round at a time, for vectors of 64 components."""
    width = 8
    out = [
        "x as materialized (select vec_id, label, list_transform(embedding, lambda e: cast(floor(4096 * cast(e as double)) as bigint)) as v from embeddings "
        "where embedding is not null and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0)",
        f"p as materialized (select vec_id, label, part, v[part * {width} + 1 : part * {width} + {width}] as c from x, (select unnest(range({PARTS})) as part))",
        f"c0 as materialized (select part, e, c from p join (select vec_id, row_number() over (order by vec_id) - 1 as e from x order by vec_id limit {ENTRIES}) using (vec_id))",
    ]
    for k in range(ROUNDS + 1):
        out.append(
            f"a{k} as materialized (select vec_id, any_value(label) as label, part, any_value(c) as c, min(d * {ENTRIES} + e) as m from (select vec_id, label, p.part, p.c, e, "
            f"list_sum(list_transform(range(1, {width + 1}), lambda i: (p.c[i] - b.c[i]) * (p.c[i] - b.c[i]))) as d from p join c{k} b on p.part = b.part) group by vec_id, part)"
        )
        if k < ROUNDS:
            out.append(
                f"c{k + 1} as materialized (select o.part, o.e, coalesce(n.c, o.c) as c from c{k} o left join (select part, e, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as c from "
                f"(select part, m % {ENTRIES} as e, i, sum(c[i]) as s, count(*) as n from a{k}, (select unnest(range(1, {width + 1})) as i) group by 1, 2, 3) group by 1, 2) n on n.part = o.part and n.e = o.e)"
            )
    last = f"a{ROUNDS}"
    out.append(f"r as (select vec_id, any_value(label) as label, string_agg(printf('%02x', cast(m % {ENTRIES} as int)), '' order by part) as code, cast(sum(m // {ENTRIES}) as bigint) as error from {last} group by vec_id)")
    out.append(f"h as (select sha256(string_agg(cast(t.i as varchar), ',' order by part, e, pos)) as codebooks_sha256 from (select part, e, unnest(c) as i, unnest(range({width})) as pos from c{ROUNDS}) t)")
    return f"with {', '.join(out)} select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from r, h"


OP12_SQL = _sql()
