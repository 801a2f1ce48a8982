"""Vector codes against plain rounds over all entries; the tree against brute force; edges."""

from __future__ import annotations

import hashlib
import math
import os

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinlake.llm import vector_codes as V

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{FOLDER}/embeddings.parquet'")
    want = con.execute(V.OP12_SQL)
    names, rows = [d[0] for d in want.description], want.fetchall()
    got = V.op12_query(spark, FOLDER)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(rows)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.integers(1, 6), st.sampled_from([2, 5, 1000, 2**27]), st.integers(0, 10**6))
def test_nearest_equals_brute_force(entries, width, most, seed):
    rng = np.random.default_rng(seed)
    book, points = rng.integers(-most, most + 1, (entries, width)), rng.integers(-most, most + 1, (50, width))
    points[:10] = book[rng.integers(0, entries, 10)]
    at, square = V.nearest(V.Vantage(book, list(range(entries))), points)
    all_ = ((points[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    assert at.tolist() == all_.argmin(axis=1).tolist() and square.tolist() == all_.min(axis=1).tolist()


def test_the_tree_skips_entries():
    """Far groups of entries aren't visited."""
    rng = np.random.default_rng(2)
    book = np.concatenate([rng.integers(0, 50, (8, 4)), rng.integers(10**6, 10**6 + 50, (8, 4))])
    seen = []
    root = V.Vantage(book, list(range(16)))

    class Counted(np.ndarray):
        def __rsub__(self, other):
            seen.append(len(other))
            return np.subtract(other, np.asarray(self))

    def wrap(node):
        node.at = node.at.view(Counted)
        for _, _, half in node.halves:
            wrap(half)

    wrap(root)
    V.nearest(root, np.ascontiguousarray(rng.integers(0, 50, (100, 4))))
    assert 0 < sum(seen) < 100 * 16


def plain(rows, entries=16, rounds=6):
    """(id, label, vector) of usable rows -> {id: (code, error)}, all entries."""
    ints = [(i, [math.floor(4096 * x) for x in v]) for i, _, v in rows]
    width = len(ints[0][1]) // 8
    first = sorted({i: v for i, v in sorted(ints, reverse=True)}.items())[:entries]
    out = {i: ["", 0] for i, _ in ints}
    final = []
    for p in range(8):
        cut = lambda v, p=p: v[p * width : (p + 1) * width]
        book = [cut(v) for _, v in first]

        def near(x):
            return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

        for _ in range(rounds):
            groups = {}
            for _, v in ints:
                groups.setdefault(near(cut(v))[1], []).append(cut(v))
            book = [[sum(c) // len(c) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(book)]
        for i, v in ints:
            d, k = near(cut(v))
            out[i][0] += f"{k:02x}"
            out[i][1] += d
        final += [str(x) for e in book for x in e]
    return {i: tuple(x) for i, x in out.items()}, hashlib.sha256(",".join(final).encode()).hexdigest()


def run(spark, tmp_path, rows, schema="vec_id long, embedding array<float>, label int"):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return V.op12_query(spark, str(tmp_path)).collect()


def test_edges(spark, tmp_path):
    rng = np.random.default_rng(5)
    good = [(i * 3, [float(np.float32(x)) for x in rng.normal(size=16)], None if i % 3 else i % 4) for i in range(60)]
    good[7] = (21, [float(np.float32(x)) for x in rng.normal(size=16) * 7], 1)
    bad = [(1, None, 1), (2, [1.0] * 15 + [None], 1), (4, [float("nan")] * 16, 2), (5, [float("-inf")] + [0.0] * 15, 2), (7, [], 1), (8, [1.0] * 8, 1), (10, [1.0] * 17, 1)]
    got = run(spark, tmp_path, [*good, *bad], "vec_id long, embedding array<float>, label int")
    want, sha = plain([(i, lab, v) for i, v, lab in good])
    assert {r.vec_id: (r.code, r.error) for r in got} == want and len(got) == 60
    assert {r.codebooks_sha256 for r in got} == {sha}
    errors = {}
    for i, _, label in good:
        errors[label] = errors.get(label, 0) + want[i][1]
    assert {r.vec_id: r.label_error for r in got} == {i: errors[label] for i, _, label in good}


def test_ties_repeats_and_few_rows(spark, tmp_path):
    rows = [(1, [0.5] * 8, 1), (1, [0.5] * 8, 1), (2, [0.5] * 8, 1), (None, [0.25] * 8, None), (3, [-0.00001] * 8, None)]
    got = sorted(run(spark, tmp_path, rows), key=lambda r: (r.vec_id is None, r.vec_id))
    # The entries are those of ids 1, 2, 3 and null; equal ones keep the lower index.
    assert [r.code[:2] for r in got] == ["00", "00", "00", "02", "03"] and all(r.error == 0 for r in got)
    assert V.integers(np.array([[-0.00001]], np.float32)).tolist() == [[-1]]


def test_huge_components_are_limited(spark, tmp_path):
    rows = [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [0.0] * 8, 1)]
    got = {r.vec_id: r for r in run(spark, tmp_path, rows)}
    assert {r.error for r in got.values()} == {0} and got[1].code == "00" * 8 and got[2].code == "01" * 8


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [1.0, 2.0], 1)]])
def test_nothing_usable(spark, tmp_path, rows):
    assert run(spark, tmp_path, rows) == []


def test_many_labels_and_hot_ones(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)], i if i % 2 else 0) for i in range(80)]
    want = sorted(map(tuple, run(spark, tmp_path / "a", rows)))
    monkeypatch.setattr(V, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(V, "HOT_ROWS", 10)
    assert sorted(map(tuple, run(spark, tmp_path / "b", rows))) == want


def test_codes_decode_near_the_vector(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    books = V.train(vectors)
    held = {r.vec_id: np.floor(np.array(r.embedding, float) * 4096).astype(int) for r in vectors.collect()}
    for r in V.encode(vectors, books).collect():
        assert int(((books.decode(r.code) - held[r.id]) ** 2).sum()) == r.error


def test_clashing_names(spark, tmp_path):
    rows = [(i, [float(i)] * 8, i % 2, "x", 1) for i in range(5)]
    got = run(spark, tmp_path, rows, "vec_id long, embedding array<float>, label int, code string, v int")
    assert len(got) == 5
