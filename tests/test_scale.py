"""Many seeds, ranges as tree nodes, pages, hot groups, rules, snapshots and tables of versions."""

from __future__ import annotations

import random
import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinlake.operators import context, graph, joins, lookup, retrieval, snapshots, storage, tables, windows
from skeinlake.operators.pages import pages

# --- search from many seeds


def random_edges(spark, seed, nodes, many):
    rng = random.Random(seed)
    rows = sorted({(rng.randrange(nodes), rng.randrange(nodes), "knows") for _ in range(many)})
    return spark.createDataFrame([(a, b, t, rng.randrange(40)) for a, b, t in rows], "from_entity long, to_entity long, type string, chapter long"), rows


def plain_reach(rows, seeds, hops):
    near = {}
    for a, b, _ in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = set()
    for s in seeds:
        seen, front = {s}, {s}
        out.add((s, s, 0))
        for hop in range(1, hops + 1):
            front = {y for x in front for y in near.get(x, ())} - seen
            seen |= front
            out |= {(s, y, hop) for y in front}
    return out


@pytest.mark.parametrize("many_edges", [100_000, 3])
def test_reach_of_many_seeds(spark, many_edges):
    """More than one word of bits, a hub, seeds without edges, repeated and null seeds."""
    edges, rows = random_edges(spark, 1, 150, 220)
    hub = [(999, k, "knows", 1) for k in range(60)]
    edges = edges.unionByName(spark.createDataFrame(hub, edges.schema))
    rows = rows + [(a, b, t) for a, b, t, _ in hub]
    seeds = [*range(0, 150, 2), 5000, 4, None]
    frame = spark.createDataFrame([(s,) for s in seeds], "id long")
    got = graph.reached_pairs(graph.reach(edges, frame, 3, many_edges), frame)
    assert {tuple(r) for r in got.collect()} == plain_reach(rows, {s for s in seeds if s is not None}, 3)


def test_a_hop_is_one_join_of_the_edges(spark):
    edges, _ = random_edges(spark, 2, 40, 60)
    found = graph.reach(edges, spark.createDataFrame([(1,), (2,)], "id long"), 2)
    assert {c for c in found.columns} == {"id", "hop", "word", "bits"}
    assert "CartesianProduct" not in found._jdf.queryExecution().toString()


def test_subgraphs_equal_one_by_one(spark):
    edges, _ = random_edges(spark, 3, 60, 150)
    centers = [0, 7, 13, 59, 4242]
    for depth, cap in ((1, 50), (2, 20), (3, 7)):
        got = graph.subgraphs(edges, centers, depth, cap)
        for c in centers:
            assert got[c] == graph.subgraph(edges, c, depth, cap), (c, depth, cap)


def test_expansion_keeps_the_order_of_seeds(spark):
    edges, _ = random_edges(spark, 4, 80, 100)
    seeds = [5, 9, 5, 30]
    want = dict.fromkeys(seeds)
    for s in dict.fromkeys(seeds):
        want.update(dict.fromkeys(graph.subgraph(edges, s, 1, 200)[1]))
    assert retrieval.expand_related(seeds, edges, 1) == list(want)[:30]


def test_relationship_report_falls_back(spark):
    entities = spark.createDataFrame([(1, "Lead", True), (2, "Ally", False)], "id long, canonical_name string, is_protagonist boolean")
    aliases = spark.createDataFrame([("hero", 2)], "alias string, entity_id long")
    edges = spark.createDataFrame([(1, 2, "trusts", 3), (2, 9, "fears", 4)], "from_entity long, to_entity long, type string, chapter long")
    kind = "name string, relation string, hostile boolean, affection long, hatred long"
    none = spark.createDataFrame([], kind)
    lines = lambda e, legacy, **more: sorted(tuple(r) for r in graph.relationship_report(e, aliases, edges, legacy, **more).collect())
    assert lines(entities, none) == [("Ally", "9", "fears", False), ("Lead", "Ally", "trusts", False)]
    nobody = entities.withColumn("is_protagonist", F.lit(False))
    assert lines(nobody, none, name="hero", depth=1) == [("Ally", "9", "fears", False), ("Lead", "Ally", "trusts", False)]
    new = spark.createDataFrame([("A", "friend", False, None, None), ("B", "rival", True, None, None), ("C", None, None, 5, 5)], kind)
    assert lines(nobody, new, lead="L") == [("L", "A", "friend", False), ("L", "B", "rival", True)]
    old = spark.createDataFrame([("A", None, None, 5, 0), ("B", None, None, 2, 7), ("C", None, None, None, None)], kind)
    assert lines(nobody, old, lead="L") == [("L", "A", "affection 5", False), ("L", "B", "affection 2", False), ("L", "B", "hatred 7", True)]


# --- ranges


def cover(first, last):
    """The numbers of a range's nodes, from the definition."""
    low, high, level, out = first, last + 1, 0, []
    while low < high:
        if low & 1:
            out.append((level, low))
            low += 1
        if high & 1:
            high -= 1
            out.append((level, high))
        low, high, level = low >> 1, high >> 1, level + 1
    return sorted(out)


def test_nodes_of_ranges(spark):
    rng = random.Random(1)
    ranges = [(0, 0), (1, 0), (5, 4), (-7, 9), (-(1 << 40), 1 << 40), (0, (1 << 61)), (7, 7), (8, 15)] + [(a, a + rng.randrange(10 ** rng.randrange(1, 12))) for a in (rng.randrange(-(10**9), 10**9) for _ in range(60))]
    df = spark.createDataFrame([*ranges, (None, 3), (3, None)], "first long, last long").withColumn("n", joins.dyadic("first", "last"))
    for r in df.collect():
        if r.first is None or r.last is None:
            assert r.n == []
            continue
        got = sorted((x.level, x.node) for x in r.n)
        assert got == cover(r.first, r.last)
        assert len(got) <= 2 * max(1, (max(r.last - r.first, 0) + 1).bit_length())


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10**6))
def test_containing_range(spark, seed):
    rng = random.Random(seed)
    wide = [(k, rng.randrange(-500, 500), rng.choice([0, 1, 5, 100, 10**9])) for k in range(30)]
    ranges = [(k, a, a + w) for k, a, w in wide] + [(99, 50, 10), (98, None, 5)]
    points = [rng.randrange(-600, 600) for _ in range(40)] + [None, 7, 7]
    got = joins.containing_range(spark.createDataFrame([(p,) for p in points], "chapter long"), spark.createDataFrame(ranges, "volume long, first long, last long"), "chapter", "first", "last", "volume")
    want = []
    for p in points:
        holds = [(-a, k) for k, a, b in ranges if None not in (p, a, b) and a <= p <= b]
        if holds:
            want.append((p, min(holds)[1]))
    assert sorted((r.chapter, r.volume) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("block", [1, 7, 60, 10**6])
def test_ranges_by_blocks(spark, block, monkeypatch):
    """Wide, nested, equal and single-number ranges, many with one end, cut at blocks of a few rows; points
    with many rows."""
    monkeypatch.setattr(joins, "BLOCK_ROWS", block, raising=False)
    monkeypatch.setattr(joins, "SMALL_ROWS", 10)
    monkeypatch.setattr(joins, "HOT_ROWS", 2)
    rng = random.Random(block)
    ends = [(a, a + rng.choice([0, 1, 5, 100, 10**9])) for a in (rng.randrange(-300, 300) for _ in range(120))]
    ends += [(k, 200 - k) for k in range(0, 80, 3)] + [(40, 40 + k) for k in range(30)] + [(77, 77)] * 10 + [(3, -3), (None, 5), (5, None), (-(1 << 62), 1 << 62), (150, (1 << 63) - 1)]
    ranges = [(None if k == 50 else f"v{rng.randrange(40):02d}", a, b) for k, (a, b) in enumerate(ends)]
    points = [rng.randrange(-400, 400) for _ in range(150)] + [None, 77, 77, 77, 1 << 61, (1 << 63) - 1]
    got = joins.containing_range(spark.createDataFrame([(p, k) for k, p in enumerate(points)], "chapter long, n int"), spark.createDataFrame(ranges, "volume string, first long, last long"), "chapter", "first", "last", "volume")
    want = set()
    for n, p in enumerate(points):
        holds = [(-a, v is not None, v or "") for v, a, b in ranges if None not in (p, a, b) and a <= p <= b]
        if holds:
            a, known, v = min(holds)
            want.add((p, n, v if known else None, -a))
    assert got.columns == ["chapter", "n", "volume", "first", "last"]
    rows = got.collect()
    assert all(r.first <= r.chapter <= r.last for r in rows) and len(rows) == len(want)
    assert {(r.chapter, r.n, r.volume, r.first) for r in rows} == want


def shuffled_rows(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(s := stages.apply(k)).stageId(): s.shuffleWriteRecords() for k in range(stages.size())}


def test_wide_ranges_shuffle_few_rows(spark, monkeypatch):
    """What is shuffled grows with points and ranges, not with the levels of the widest range."""
    monkeypatch.setattr(joins, "BLOCK_ROWS", 500, raising=False)
    monkeypatch.setattr(joins, "SMALL_ROWS", 10)
    points = spark.range(0, 6000, 3, 4).select(F.col("id").alias("chapter"))
    ranges = spark.range(0, 2000, 1, 4).select(F.col("id").alias("volume"), (F.col("id") * 3).alias("first"), (F.col("id") * 3 + F.expr("case when id % 9 = 0 then 1000000000 when id % 2 = 0 then 400 else 2 end")).alias("last"))
    before, broadcast = shuffled_rows(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = joins.containing_range(points, ranges, "chapter", "first", "last", "volume").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert {(r.chapter, r.volume) for r in got} == {(3 * k, k) for k in range(2000)}
    assert 0 < sum(n for k, n in shuffled_rows(spark).items() if k not in before) <= 12 * 4000


def test_hot_lookup(spark):
    rows = spark.createDataFrame([(k % 3 if k < 90 else k, k) for k in range(200)], "key long, n long")
    table = spark.createDataFrame([(k, f"v{k}") for k in range(150)], "key long, v string")
    want = sorted(map(tuple, rows.join(table, "key").collect()))
    for small, hot in ((1000, 1000), (10, 1000), (10, 20)):
        got = joins.join_lookup(rows, table, ["key"], small, hot)
        assert sorted(map(tuple, got.collect())) == want


# --- pages


def ordered(rows):
    null_first = lambda x: (x is not None, x or 0)
    return sorted(sorted(rows, key=lambda r: null_first(r[1])), key=lambda r: (r[0] is None, -(r[0] or 0)))


def paged(spark, range_rows=40):
    rng = random.Random(6)
    rows = [(rng.choice([None, 1.5, 2.5, 3.5, 9.0]), k if k else None, f"x{k}") for k in range(333)]
    df = spark.createDataFrame(rows, "score double, id long, note string").repartition(4)
    return pages(df, "score desc", "id", range_rows=range_rows), ordered(rows)


def test_every_page_and_every_key(spark):
    stored, rows = paged(spark)
    assert stored.total == 333 and stored.count(50) == 7 and len(stored.parts) > 2
    for number in (0, 1, 3, 7, 8):
        start = (max(1, number) - 1) * 50
        assert list(map(tuple, stored.page(number, 50).collect())) == rows[start : start + 50]
    for k in (0, 41, 120, 331, 332):
        assert list(map(tuple, stored.after(rows[k][:2], 60).collect())) == rows[k + 1 : k + 61]
    # A key that isn't there.
    assert list(map(tuple, stored.after((2.0, 5), 3).collect())) == [r for r in rows if r[0] is None or r[0] < 2.0][:3]


def test_a_page_reads_its_range(spark):
    stored, _ = paged(spark)
    plan = stored.page(4, 10)._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "PartitionFilters: [__part" in plan
    assert pages(spark.createDataFrame([], "score double"), "score").page(1, 5).collect() == []


# --- hot groups


def test_tied_rows_of_a_hot_group_are_spread(spark):
    rows = spark.createDataFrame([("hot" if k % 3 else f"g{k}", 1, k) for k in range(3000)], "g string, score int, id long")
    got = lookup.per_group_top(rows, "g", 4, "score desc")
    assert got.filter("g = 'hot'").count() == 4 and got.count() == 1000 + 4
    last = windows.retain_last(rows, 3, "g", ["score", "id"])
    assert sorted(r.id for r in last.filter("g = 'hot'").collect()) == [2996, 2998, 2999]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_rules_of_groups_and_of_none(spark):
    rules = spark.createDataFrame([("a", k % 7, 9 - k % 7) for k in range(40)] + [("b", 1, 5), (None, 2, 1), (None, 2, 3)], "pack string, id long, priority int")
    got = {(r.pack, r.id, r.priority, r.place, r.enough) for r in context.pick_rules(rules, 2, 3, "pack").collect()}
    assert got == {("a", 6, 3, 1, True), ("a", 5, 4, 2, True), ("a", 4, 5, 3, True), ("b", 1, 5, 1, False), (None, 2, 1, 1, False)}
    plain = [(r.id, r.place, r.enough) for r in context.pick_rules(rules, 7, 2).orderBy("place").collect()]
    assert plain == [(2, 1, True), (6, 2, True)]


# --- versions


def test_versions_are_taken_once(spark):
    series = storage.Versions(spark, storage.new_folder(spark))
    assert series.last() == (0, None)
    won = []
    run = [threading.Thread(target=lambda k=k: won.append(k) if series.add(0, f"text {k}") else None) for k in range(6)]
    for t in run:
        t.start()
    for t in run:
        t.join()
    assert len(won) == 1 and series.last() == (1, f"text {won[0]}")
    # A pointer that was cut off is skipped, but its number is taken.
    where, fs = storage._at(spark, f"{series.path}/{2:012d}")
    out = fs.create(where, True)
    out.write(b"half")
    out.close()
    assert series.last() == (2, f"text {won[0]}") and not series.add(1, "x") and series.add(2, "whole") and series.last() == (3, "whole")


def test_snapshots(spark):
    path, pack = storage.new_folder(spark), spark.range(3)
    assert snapshots.load_snapshot(spark, path, "v1", 1) is None and snapshots.list_snapshots(spark, path) == [] and not snapshots.delete_snapshot(spark, path, 1)
    snapshots.save_snapshot(pack, path, "v1", 1)
    early = snapshots.load_snapshot(spark, path, "v1", 1)
    snapshots.save_snapshot(spark.range(5), path, "v1", 1)
    snapshots.save_snapshot(spark.range(7), path, "v2", 10)
    # Who has loaded a copy keeps it.
    assert early.count() == 3 and snapshots.load_snapshot(spark, path, "v1", 1).count() == 5
    with pytest.raises(snapshots.VersionMismatch):
        snapshots.load_snapshot(spark, path, "v1", 10)
    assert snapshots.list_snapshots(spark, path) == [(1, "v1"), (10, "v2")]
    assert snapshots.delete_snapshot(spark, path, 10) and not snapshots.delete_snapshot(spark, path, 10)
    assert snapshots.list_snapshots(spark, path) == [(1, "v1")] and snapshots.load_snapshot(spark, path, "v2", 10) is None
    assert snapshots.vacuum(spark, path) == 2 and snapshots.load_snapshot(spark, path, "v1", 1).count() == 5


def test_two_writers_of_a_snapshot(spark, monkeypatch):
    path, real, met = storage.new_folder(spark), storage.Versions.add, []

    def late(self, after, text):
        if not met:
            met.append(True)
            snapshots.save_snapshot(spark.range(9), path, "v1", 1)
        return real(self, after, text)

    monkeypatch.setattr(storage.Versions, "add", late)
    snapshots.save_snapshot(spark.range(2), path, "v1", 1)
    # Both are published, the one that was overtaken after the other.
    assert snapshots.load_snapshot(spark, path, "v1", 1).count() == 2 and len(storage.names_in(spark, f"{path}/pointers/1")) == 2


def test_tables_go_back(spark):
    path = storage.new_folder(spark)
    assert tables.load_table(spark, path) is None and not tables.restore_table(spark, path)
    with pytest.raises(LookupError):
        tables.migrate_table(spark, path, lambda df: df)
    tables.save_table(spark.range(4), path)
    assert not tables.restore_table(spark, path)
    tables.migrate_table(spark, path, lambda df: df.withColumn("x", F.col("id") * 2))
    assert tables.load_table(spark, path).columns == ["id", "x"]
    assert tables.restore_table(spark, path) and tables.load_table(spark, path).columns == ["id"]
    got = tables.conform(spark.createDataFrame([(1, "2", 3.0)], "ID int, x string, more double"), "id long, x int, y array<string>").first()
    assert tuple(got) == (1, 2, None)
