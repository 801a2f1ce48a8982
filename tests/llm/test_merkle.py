"""The Merkle manifest against a plain tree; proofs; tampering; edges and tasks that meet in the middle of a run."""

from __future__ import annotations

import hashlib
import os
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from skeinlake.llm import merkle as M

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    out = ""
    for name in ("doc_id", "source", "lang", "n_chars", "text"):
        x = row[name]
        if x is None:
            out += "-"
            continue
        if name == "text" and lower:
            x = "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
        out += f"{len(str(x).encode())}:{x}"
    return H(out)


def fold(nodes):
    """[(digest, [(slot, siblings)])] -> root; each node's path is filled in."""
    level = [(d, [k]) for k, (d, _) in enumerate(nodes)]
    while len(level) > 1:
        up = []
        for at in range(0, len(level), 8):
            run = level[at : at + 8]
            for slot, (_, members) in enumerate(run):
                others = "".join(d for j, (d, _) in enumerate(run) if j != slot)
                for m in members:
                    nodes[m][1].append((slot, others))
            up.append((H("".join(d for d, _ in run)), [m for _, members in run for m in members]))
        level = up
    return level[0][0]


def plain(rows):
    """Sorted result rows of the contract."""
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    leaves, subroots = {}, []
    for lang in langs:
        mine = sorted(((leaf(r), r) for r in groups[lang]), key=lambda x: (x[1]["doc_id"] is not None, x[1]["doc_id"] or 0, x[0]))
        nodes = [(d, []) for d, _ in mine]
        subroots.append((fold(nodes), []))
        leaves[lang] = [(d, r, path) for (d, r), (_, path) in zip(mine, nodes, strict=True)]
    root = fold(subroots) if subroots else None
    out = []
    for lang, (subroot, up) in zip(langs, subroots, strict=True):
        for d, row, path in leaves[lang]:
            whole = [*path, *up]
            key = "" if row["doc_id"] is None else str(row["doc_id"])
            now = leaf(row, True) if zlib.crc32(key.encode()) % 3 == 0 else d
            for slot, others in whole:
                now = H(others[: 64 * slot] + now + others[64 * slot :])
            out.append((row["doc_id"], d, subroot, root, H("".join(o for _, o in whole)), now, now == root))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def written(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_against_sql_and_plain(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    cur = con.execute(M.OP13_SQL)
    names, want = [d[0] for d in cur.description], cur.fetchall()
    got = M.op13_query(spark, FOLDER)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want)
    rows = [r.asDict() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert result(got) == plain(rows)
    tampered = [r for r in got.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 0]
    assert tampered and not all(r.verified for r in tampered) and all(r.verified for r in got.collect() if r not in tampered)


def made(n, seed, langs=("a", "é", None, "B", "")):
    rng = random.Random(seed)
    return [(i, f"s{i % 3}" if i % 5 else None, rng.choices(langs, [60, 30, 9, 1, 1][: len(langs)])[0], i if i % 7 else None, rng.choice(["Text", "text", "", None, "Ünï X"]) ) for i in range(n)]


@pytest.mark.parametrize(("n", "seed"), [(1, 1), (2, 2), (8, 3), (9, 4), (63, 5), (64, 6), (65, 7), (700, 8)])
def test_sizes(spark, tmp_path, n, seed):
    rows = made(n, seed, ("a",) if n < 64 else ("a", "é", None, "B", ""))
    folder = written(spark, tmp_path, rows)
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    assert result(M.op13_query(spark, folder)) == plain([dict(zip(names, r, strict=True)) for r in rows])


def test_many_tasks_meet(spark, tmp_path, monkeypatch):
    """More tasks than a run has leaves in some of them: several rounds over frontiers."""
    monkeypatch.setattr(M, "ROWS_PER_TASK", 13)
    rows = made(1300, 9)
    folder = written(spark, tmp_path, rows)
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    assert result(M.op13_query(spark, folder)) == plain([dict(zip(names, r, strict=True)) for r in rows])


def test_repeated_rows_and_null_ids(spark, tmp_path):
    rows = [(1, "s", "a", 1, "X")] * 30 + [(None, "s", "a", 1, "Y")] * 3 + [(1, "s", "a", 1, "Z"), (None, None, None, None, None), (2, "s", "a", 1, "X" * 100_000)]
    folder = written(spark, tmp_path, rows)
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    got = M.op13_query(spark, folder)
    assert result(got) == plain([dict(zip(names, r, strict=True)) for r in rows])


def test_one_language_a_row(spark, tmp_path):
    rows = [(i, "s", f"lang{i}", 1, "T") for i in range(200)]
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    assert result(M.op13_query(spark, written(spark, tmp_path, rows))) == plain([dict(zip(names, r, strict=True)) for r in rows])


def test_empty_and_clashing(spark, tmp_path):
    assert M.op13_query(spark, written(spark, tmp_path / "a", [])).collect() == []
    rows = [(i, "s", "a", 1, "T", "x", 1) for i in range(20)]
    folder = written(spark, tmp_path / "b", rows, SCHEMA + ", g string, task int")
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    assert result(M.op13_query(spark, folder)) == plain([dict(zip(names, r[:5], strict=True)) for r in rows])


def test_proofs_check_out(spark):
    """The written proofs lead every leaf to the root, and no other leaf."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = M.manifest(docs).collect()
    for r in rows:
        assert M.climb(r.leaf, r.slots, r.siblings) == r.root == r.folded_root
        assert M.climb(rows[0].leaf if r.leaf != rows[0].leaf else rows[1].leaf, r.slots, r.siblings) != r.root
        assert H("".join(r.siblings)) == r.proof_sha256
    changed = M.row_digest([F.col(c) if c != "n_chars" else F.col(c) + 1 for c in M.FIELDS])
    assert not any(r.verified for r in M.verify(M.manifest(docs, changed=changed)).collect())


def test_tree_takes_children_in_any_order():
    rng = random.Random(1)
    for n in (1, 5, 8, 60, 600):
        digests = [H(str(k)) for k in range(n)]
        order = list(range(n))
        rng.shuffle(order)
        tree = M.Tree(keep_links=True)
        for k in order:
            tree.arrive("g", n, 0, k, digests[k])
        ((_, _, _, _, root),) = tree.frontier()
        nodes = [(d, []) for d in digests]
        assert root == fold(nodes)
        for k in range(n):
            slots, siblings, _, _ = tree.path("g", 0, k)
            assert list(zip(slots, siblings, strict=True)) == nodes[k][1]
