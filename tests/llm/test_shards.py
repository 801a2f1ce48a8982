"""Sharding of hot, tiny and repeated groups."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

from skeinlake.llm import sharding


def check(rows, shards=8, slack=0):
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    total = sum(sizes.values())
    assert all(abs(sizes[s] - total / shards) <= 2 * slack for s in range(shards))


def test_groups_below_the_hot_share_stay_together(spark):
    """512 groups of 20 equal texts, each half the hot share, with the number of ranges as shipped."""
    docs = spark.range(512 * 20).selectExpr("id as doc_id", "concat('group ', id % 512, repeat('x', 90)) as text")
    got = sharding.shard(docs).collect()
    homes = defaultdict(set)
    for r in got:
        homes[r.g].add(r.shard)
    assert len(homes) == 512 and all(len(v) == 1 for v in homes.values())
    check(got, slack=20 * 101)


def test_equal_rows_spread_over_cells(spark):
    """A million rows without id and text among others: no cell holds more than its share, every row keeps a slot."""
    docs = spark.range(1_000_000).selectExpr("cast(null as bigint) as doc_id", "cast(null as string) as text").union(spark.range(20_000).selectExpr("id", "concat('text ', id)"))
    rows = sharding.materialize(sharding.keyed(docs))
    n = rows.count()
    limit = sharding.OVERFULL * (n // sharding.LEAST_RANGES)
    total = rows.selectExpr("sum(size)").first()[0]
    cells = sharding.with_cell(sharding.with_range(rows, sharding.splitters(rows, sharding.LEAST_RANGES, total)), limit)
    sizes = [r["count"] for r in cells.groupBy("range", "part").count().collect()]
    assert sum(sizes) == n and max(sizes) < 1.3 * limit
    got = sharding.places(rows, 8).groupBy("shard").agg({"slot": "max", "*": "count", "size": "sum"}).collect()
    assert sum(r["count(1)"] for r in got) == n and all(r["max(slot)"] == r["count(1)"] - 1 for r in got)
    assert all(abs(r["sum(size)"] - total / 8) < 30 for r in got)


@pytest.mark.parametrize("most", [4, 1 << 14])
def test_many_tiny_equal_texts_stay_together_in_many_cells(spark, monkeypatch, most):
    """A third of the rows are empty, too light to be divided among shards but too many for one cell."""
    monkeypatch.setattr(sharding, "LEAST_RANGES", min(32, most))
    monkeypatch.setattr(sharding, "MOST_RANGES", most)
    rows = [(i, "") for i in range(3000)] + [(9000 + i, f"{i} " + "long text " * 300) for i in range(6000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len({r.shard for r in got if r.size == 1}) == 1 and len(got) == 9000
    check(got, slack=3010)


def test_written_shards_keep_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, None, 1), (None, "a", 2), (None, "a", 2), (5, "b", 3), (5, "b", 4), (6, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long")
    sharding.write_shards(docs, f"file://{tmp_path}/out", 3)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(map(str, back.select("doc_id", "text", "row").collect())) == sorted(map(str, docs.collect()))
    slots = defaultdict(list)
    for r in back.collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
