"""Exact nearest vectors for many queries, by cells with radius bounds. (R-02, R-03, R-04, Y-02)

Vectors are scaled to length one and dealt to the nearest of a few thousand centroids, fitted on a bounded sample; each
cell keeps the greatest distance of a member from its centroid. By the triangle inequality no member of a cell is nearer
to a query than the centroid's distance less that radius. A query is first compared with the cells around it until they
hold k vectors; then with those cells only whose bound reaches the k-th similarity found. What is skipped can't be among
the best, so the result is that of comparing everything. How much is skipped depends on how clustered the vectors are.

Cells and the queries that need them meet in groups of bounded size: a cell with many vectors, or that many queries
need, is split. Vectors of length zero, whose cosine is 0, are a cell of their own that every query may need.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_code
from .lookup import per_group_top
from .storage import materialize, new_folder

#: Cells at most, vectors of the sample for each, rounds of its fitting.
MOST_CELLS, SAMPLE_PER_CELL, ROUNDS = 1024, 64, 8
#: Vectors and queries of a group.
GROUP_VECTORS, GROUP_QUERIES = 20_000, 1_000
#: Rows that a task compares with all centroids at once, and rows that it hands on at once.
BATCH_QUERIES, BATCH_ROWS = 512, 1 << 14
#: Room for rounding in bounds.
ROOM = 1e-9


@dataclass
class VectorIndex:
    """``rows`` (id, v, cell) are stored by cell; of cell k there are ``centroids[k]``, ``radii[k]`` and ``counts[k]``, the
    last one being that of vectors of length zero."""

    rows: DataFrame
    centroids: np.ndarray
    radii: np.ndarray
    counts: np.ndarray


def _units(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, lengths) of a list column; those of length zero stay zero."""
    column = batch.column(at)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    n = np.sqrt((x * x).sum(axis=1))
    return x / np.where(n == 0, 1, n)[:, None], n


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, BATCH_QUERIES) for batch in batches for at in range(0, batch.num_rows, BATCH_QUERIES))


def _squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)[None])


def _fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Means of the sample's parts around points of itself, after a few rounds."""
    rng = np.random.default_rng(7)
    centers = sample[rng.choice(len(sample), cells, replace=False)].copy()
    for _ in range(ROUNDS):
        own = _squares(sample, centers).argmin(axis=1)
        for k in np.unique(own):
            centers[k] = sample[own == k].mean(axis=0)
    return centers


def build_index(vectors: DataFrame, id_col: str = "chunk_id", vec_col: str = "embedding", cells: int | None = None) -> VectorIndex:
    """Store vectors by cell. Null and empty vectors are left out; all others must be of one width."""
    spark = vectors.sparkSession
    ship_code(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0))
    total = rows.count()
    cells = max(1, min(MOST_CELLS, int(total**0.5))) if cells is None else cells
    want = cells * SAMPLE_PER_CELL
    share = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, 2 * want / max(total, 1))) + 1)
    x, n = _units(rows.filter(share).limit(2 * want).select("v").toArrow().combine_chunks().to_batches()[0], 0) if total else (np.zeros((0, 1)), np.zeros(0))
    sample = x[n > 0]
    centers = _fit(sample, min(cells, len(sample))) if len(sample) else np.zeros((0, x.shape[1]))
    shared = spark.sparkContext.broadcast(centers)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in _slices(batches):
            x, n = _units(batch, 1)
            cell, far = np.full(len(x), len(c)), np.zeros(len(x))
            some = np.flatnonzero(n > 0)
            if len(some) and len(c):
                d = _squares(x[some], c)
                cell[some] = d.argmin(axis=1)
                far[some] = np.sqrt(((x[some] - c[cell[some]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(far)], names=["id", "v", "cell", "far"])

    path = new_folder(spark)
    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.mapInArrow(deal, f"id {kind}, v array<double>, cell int, far double")
    # A large cell is several files: rows of a cell go to tasks by their id too.
    dealt.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-total // (cells * GROUP_VECTORS)))))).write.partitionBy("cell").parquet(path)
    stored = spark.read.schema(f"id {kind}, v array<double>, far double, cell int").parquet(path)
    radii, counts = np.zeros(len(centers) + 1), np.zeros(len(centers) + 1, np.int64)
    for r in stored.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():
        radii[r.cell], counts[r.cell] = r.far * (1 + ROOM) + ROOM, r.n
    return VectorIndex(stored.select("id", "v", "cell"), centers, radii, counts)


def _asked(queries: DataFrame, index: VectorIndex, k: int, home: bool) -> DataFrame:
    """(qid, q, cell) to compare: the cells around a query that hold k vectors (``home``), or the others whose bound reaches
    the query's ``least``."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, index.radii, index.counts))
    kind = queries.schema["qid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, radii, counts = shared.value
        for batch in _slices(batches):
            x, n = _units(batch, 1)
            qid, q, cells = batch.column(0), batch.column(1), []
            far = np.sqrt(_squares(x, centers)) if len(centers) else np.zeros((len(x), 0))
            # Of two unit vectors at distance d the cosine is 1 - d^2 / 2; with length zero it is 0.
            near = np.maximum(0, far - radii[:-1] - 1e-7)
            best = np.concatenate([1 - near * near / 2, np.zeros((len(x), 1))], axis=1) + ROOM
            best[n == 0] = ROOM
            order = np.argsort(np.concatenate([far, np.full((len(x), 1), np.sqrt(2))], axis=1), axis=1, kind="stable")
            least = batch.column(2).to_numpy(zero_copy_only=False) if not home else None
            for i in range(len(x)):
                filled = order[i][counts[order[i]] > 0]
                first = filled[: int(np.searchsorted(np.cumsum(counts[filled]), k)) + 1]
                if home:
                    cells.append(first)
                else:
                    rest = filled[len(first) :]
                    cells.append(rest if np.isnan(least[i]) else rest[best[i, rest] >= least[i]])
            of = np.repeat(np.arange(len(x)), [len(c) for c in cells])
            flat = np.concatenate([*cells, np.zeros(0, np.int64)]).astype(np.int32)
            # A query may ask for all cells, each with its vector: so many rows at once, whatever the batch.
            for at in range(0, len(flat), BATCH_ROWS):
                some = pa.array(of[at : at + BATCH_ROWS])
                yield pa.RecordBatch.from_arrays([qid.take(some), q.take(some), pa.array(flat[at : at + BATCH_ROWS])], names=["qid", "q", "cell"])

    columns = ["qid", "q"] if home else ["qid", "q", "least"]
    return queries.select(*columns).mapInArrow(run, f"qid {kind}, q array<double>, cell int")


def _compared(asked: DataFrame, index: VectorIndex, k: int) -> DataFrame:
    """(qid, id, score): the k best of each group of a cell's vectors, for each query that asked for the cell."""
    spark = asked.sparkSession
    wanted = asked.groupBy("cell").agg(F.count("*").alias("n")).collect()  # one row a cell
    parts = [(r.cell, max(1, -(-int(index.counts[r.cell]) // GROUP_VECTORS)), -(-r.n // GROUP_QUERIES)) for r in wanted]
    table = F.broadcast(spark.createDataFrame(parts, "cell int, vp int, qp int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda col, n: F.pmod(F.xxhash64(col), F.col(n)).cast("int")
    left = asked.join(table, "cell").select("cell", each("vp").alias("v_part"), own("qid", "qp").alias("q_part"), "qid", "q")
    right = index.rows.filter(F.col("cell").isin([p[0] for p in parts])).join(table, "cell").select("cell", own("id", "vp").alias("v_part"), each("qp").alias("q_part"), "id", "v")
    kinds = [dict(asked.dtypes)["qid"], dict(index.rows.dtypes)["id"]]

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        qid, ids, scores = [], [], []
        if mine.num_rows and theirs.num_rows:
            q, qn = _units(mine.select(["q"]).combine_chunks().to_batches()[0], 0)
            raw = theirs.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(theirs.num_rows, -1)
            length = np.sqrt((raw * raw).sum(axis=1))
            names, keys = np.array(theirs.column("id").to_pylist(), object), mine.column("qid").to_pylist()
            raw_q = mine.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)
            for i, key in enumerate(keys):
                n = length * np.sqrt((raw_q[i] * raw_q[i]).sum())
                s = np.where(n == 0, 0.0, (raw * raw_q[i]).sum(axis=1) / np.where(n == 0, 1, n))
                # All that tie with the k-th, as ids decide among them.
                at = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))
                at = sorted(at.tolist(), key=lambda j: (-s[j], names[j]))[:k]
                qid += [key] * len(at)
                ids += names[at].tolist()
                scores += s[at].tolist()
        return pa.table({"qid": qid, "id": ids, "score": scores}, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = f"qid {kinds[0]}, id {kinds[1]}, score double"
    schema = to_arrow_schema(_parse_datatype_string(out))
    group = ["cell", "v_part", "q_part"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(run, out)


def nearest(index: VectorIndex, queries: DataFrame, k: int, id_col: str = "chunk_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """((query id, id, score): the k most similar of each query, ties by id; (query id, cells): how many were read).

    Null and empty query vectors have no rows; query ids must tell queries apart.
    """
    ship_code(queries.sparkSession)
    asked = queries.select(F.col(id_col).alias("qid"), F.col(vec_col).cast("array<double>").alias("q")).filter(F.col("q").isNotNull() & (F.size("q") > 0))
    first = materialize(_asked(asked, index, k, True))
    found = materialize(per_group_top(_compared(first, index, k), "qid", k, "score desc", "id"))
    least = found.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    more = materialize(_asked(asked.join(least, "qid", "left"), index, k, False))
    both = found if more.isEmpty() else found.unionByName(_compared(more, index, k))
    read = first.unionByName(more).groupBy("qid").agg(F.count("*").alias("cells"))
    best = per_group_top(both, "qid", k, "score desc", "id")
    return best.withColumnRenamed("qid", "query_id"), read.withColumnRenamed("qid", "query_id")
