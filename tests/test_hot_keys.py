"""Keys with most of the rows, repeated rows, and ties."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skeinlake.operators import aggregates, joins, reports, upsert, windows
from skeinlake.sources import files


@pytest.mark.parametrize("seed", range(4))
def test_runs_by_blocks_equal_runs_in_one_go(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for key in ("hot", "cold"):
        label, run = "none", 0
        for n in range(400 if key == "hot" else 7):
            now = label if rng.random() < 0.85 and n else rng.choice(["a", "b", None])
            run = run + 1 if n and now == label else 1
            label = now
            rows.append((key, n, label))
            want[key, n] = run
    df = spark.createDataFrame(rows, "k string, n int, l string").repartition(4)
    for block in (None, F.floor(F.col("n") / 10), F.floor(F.col("n") / 3)):
        got = windows.run_since_switch(df, "k", ["n"], "l", block)
        assert got.columns == ["k", "n", "l", "run"] and {(r.k, r.n): r.run for r in got.collect()} == want
    kept = reports.strand_tracker(df.withColumnRenamed("n", "chapter"), "k", label="l", keep=25, block=10)
    assert {(r.k, r.chapter): r.run for r in kept.collect()} == {(k, n): v for (k, n), v in want.items() if k == "cold" or n >= 375}


def test_equal_points_keep_their_rows(spark):
    ranges = spark.createDataFrame([(1, 1, 100), (2, 50, 60)], "volume long, first long, last long")
    points = spark.createDataFrame([(5, "x"), (5, "x"), (55, "y"), (900, "z")], "chapter long, name string")
    got = joins.containing_range(points, ranges, "chapter", "first", "last", "volume")
    assert got.columns == ["chapter", "name", "volume", "first", "last"]
    assert sorted((r.chapter, r.volume) for r in got.collect()) == [(5, 1), (5, 1), (55, 2)]


def test_the_first_of_equal_keys_is_inserted(spark):
    have = spark.createDataFrame([("a", 1, {"x": "1"})], "k string, n int, m map<string,string>")
    new = spark.createDataFrame([("b", 3, {"x": "3"}), ("b", 2, {"x": "2"}), ("a", 0, {})], have.schema)
    for df in (new, new.orderBy("n"), new.repartition(3)):
        got = upsert.insert_if_absent(have, df, ["k"], ["n"])
        assert sorted((r.k, r.n) for r in got.collect()) == [("a", 1), ("b", 2)]
    ties = [upsert.insert_if_absent(have, df, ["k"]).filter("k = 'b'").first().n for df in (new, new.orderBy(F.desc("n")), new.repartition(3))]
    assert len(set(ties)) == 1


def test_latest_wins_takes_maps_and_nested_rows(spark):
    rows = [(1, 1, {"a": "1"}, [{"b": "2"}]), (1, 2, {"a": "3"}, []), (2, 1, None, None)]
    log = spark.createDataFrame(rows, "id int, at int, m map<string,string>, l array<map<string,string>>")
    assert sorted((r.id, r.m) for r in upsert.latest_wins(log, ["id"], ["at"]).collect()) == [(1, {"a": "3"}), (2, None)]


def test_alias_index_and_export(spark, tmp_path):
    aliases = spark.createDataFrame([("x", 1, "c"), ("x", 2, "c"), ("x", 2, "c"), ("y", 3, "p")], "alias string, entity_id long, entity_type string")
    assert sorted(map(tuple, aggregates.alias_index(aliases).collect())) == [("x", "c", 1), ("x", "c", 2), ("y", "p", 3)]
    assert [(r.alias, [e.id for e in r.entities]) for r in aggregates.alias_index(aliases, "x").collect()] == [("x", [1, 2])]
    people = spark.createDataFrame([(1, "c", "Hero"), (3, "p", "Place")], "id long, type string, name string")
    aggregates.write_entity_export(people, f"file://{tmp_path}/out")
    back = spark.read.json(f"file://{tmp_path}/out").collect()
    assert sorted((r.type, r.id, r.record.name) for r in back) == [("c", 1, "Hero"), ("p", 3, "Place")]


def test_no_name_of_a_long_list_is_left_out(spark, tmp_path):
    (tmp_path / "chapter-1.md").write_text("zz2999 met aa0001", encoding="utf-8")
    names = spark.createDataFrame([(f"{'aa' if i < 1500 else 'zz'}{i:04d}",) for i in range(3000)], "name string")
    got = files.chapters(files.markdown(spark, f"file://{tmp_path}"), "Points", names).collect()
    assert [r.characters for r in got] == [["aa0001", "zz2999"]]


def test_shared_folder_must_be_shared(spark, monkeypatch):
    from types import SimpleNamespace

    from skeinlake.operators import storage

    unset = SimpleNamespace(get=lambda *_: None)
    far = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        storage.shared_root(far)
    assert storage.shared_root(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="local[4]"))).startswith("file://")
