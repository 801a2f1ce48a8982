"""What only larger tables hold or show: short turns, sizes of what is sent, written and held."""

from __future__ import annotations

import re
import time

import __spark_entry__ as entry
from pyspark.sql import Row
from pyspark.sql import functions as F

from skeinlake.functions.scalars import tokenize
from skeinlake.operators import graph as G
from skeinlake.operators import names as N
from skeinlake.operators import pages as P
from skeinlake.operators import vectors as V
from skeinlake.operators.index import WordIndex, word_counts
from skeinlake.operators.storage import new_folder
from skeinlake.streaming import stateful as T


def test_answers_of_turns_with_few_words(spark, tmp_path):
    """A turn may have fewer words than an answer has issues."""
    rows = [(1, 0, "user", "one"), (1, 1, "assistant", ""), (1, 4, "user", "A b"), (2, 0, "user", "a b c d")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in entry.queries()["nested_answers_K10"](spark, str(tmp_path)).collect()}
    want = set()
    for conv, turn, role, w in ((1, 0, "user", ["one", "none", "none"]), (1, 1, "assistant", ["none"] * 3), (2, 0, "user", ["a", "b", "c"])):
        want |= {(conv, turn, role, turn, "high", w[0]), (conv, turn, role, turn, None, w[1]), (conv, turn, role, turn + 1, "high", w[2])}
    assert got == want
    assert [tuple(r) for r in entry.queries()["malformed_answers_K10"](spark, str(tmp_path)).collect()] == [(1, 4)]


def test_words_of_a_long_text_are_counted_by_runs(spark):
    """Twenty thousand different words: comparing each with each takes minutes."""
    long = " ".join("".join("abcdefghij"[int(d)] for d in str(k % 20_000)) for k in range(40_000))
    texts = spark.createDataFrame([(1, long), (2, "b a b"), (3, ""), (4, None)], "id long, text string")
    began = time.perf_counter()
    got = {r.id: {w.term: w.n for w in r.words} if r.words is not None else None for r in texts.select("id", word_counts(tokenize(F.col("text"))).alias("words")).collect()}
    assert time.perf_counter() - began < 20
    assert len(got[1]) == 20_000 and set(got[1].values()) == {2} and got[2] == {"a": 1, "b": 2} and got[3] == {} and not got[4]


def test_postings_are_made_where_their_documents_are(spark):
    """Neither texts nor postings are shuffled: all blocks of a cell come from the task that has its documents."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = WordIndex(spark, new_folder(spark), cell_docs=8)
        words = ["".join("abcdefghij"[int(d)] for d in str(k)) for k in range(97)]
        index.apply(spark.createDataFrame([(k, " ".join(words[(k * j) % 97] for j in range(1, 2 + k % 40))) for k in range(200)], "chunk_id long, content string"))
        index.apply(spark.createDataFrame([(k, "b c" if k % 2 else None) for k in range(50)], "chunk_id long, content string"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    blocks = index._read(index.state()[1], "blocks").withColumn("file", F.input_file_name())
    assert {r.n for r in blocks.groupBy("seg", "cell").agg(F.count_distinct("file").alias("n")).collect()} == {1}
    assert blocks.groupBy("seg", "cell", "term").count().filter("count > 1").isEmpty() and blocks.agg(F.max("n")).first()[0] <= 8
    assert blocks.filter("seg = 0").select(F.explode("postings.id")).distinct().count() == 200


def test_pages_keep_a_bounded_number_of_ranges(spark, monkeypatch):
    """However short the ranges are asked to be, the driver's lines are bounded; pages stay the same."""
    monkeypatch.setattr(P, "MOST_RANGES", 4)
    rows = [(float(k % 37), k) for k in range(500)]
    stored = P.pages(spark.createDataFrame(rows, "score double, id long").repartition(3), "score desc", "id", range_rows=5)
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert len(stored.parts) <= 4 and stored.total == 500
    for number in (1, 2, 7, 13, 14, 25, 26):
        assert list(map(tuple, stored.page(number, 20).collect())) == want[(number - 1) * 20 : number * 20]


def test_pairs_are_written_out_behind_the_last_shuffle(spark):
    edges = spark.createDataFrame([(k, 1000 + k % 3) for k in range(200)], "from_entity long, to_entity long")
    seeds = spark.createDataFrame([(k,) for k in range(150)], "id long")
    pairs = G.reached_pairs(G.reach(edges, seeds, 2), seeds)
    want = {(s, s, 0) for s in range(150)} | {(s, 1000 + s % 3, 1) for s in range(150)} | {(s, k, 2) for s in range(150) for k in range(200) if k != s and k % 3 == s % 3}
    assert sorted(tuple(r) for r in pairs.collect()) == sorted(want)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")


def test_what_is_reached_is_not_shuffled(spark, monkeypatch):
    """Few rows of a frontier reach much: they go to the edges, and what is reached stays where it is found."""
    edges = spark.createDataFrame([(k, 1000 + k % 3 + j) for k in range(200) for j in (0, 2)], "from_entity long, to_entity long")
    seeds = spark.createDataFrame([(k,) for k in range(0, 200, 2)], "id long")
    found = G.reach(edges, seeds, 2, many_edges=50)
    pairs = G.reached_pairs(found, seeds)
    rows = sorted(map(tuple, pairs.collect()))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert "keys=[b#" in plan and not re.search(r"Exchange hashpartitioning\(b#\d+L?, word", plan) and "SortMergeJoin" not in plan
    monkeypatch.setattr(G, "SENT_ROWS", 0)
    monkeypatch.setattr(G, "SENT_WORDS", 0)
    assert rows == sorted(map(tuple, G.reached_pairs(G.reach(edges, seeds, 2, many_edges=50), seeds).collect())) and {r[2] for r in rows} == {0, 1, 2}


def test_what_is_asked_of_all_cells_comes_in_small_batches(spark, monkeypatch):
    """A vector asks for many cells: none of the batches that a task hands on holds them all."""
    monkeypatch.setattr(V, "BATCH_ROWS", 7)
    monkeypatch.setattr(V, "BATCH_QUERIES", 5)
    rows = [(k, [float((k * 7 + d * 3) % 11 - 5) for d in range(4)]) for k in range(120)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    found, _ = V.nearest(V.build_index(vectors, "id", "v", cells=12), vectors.filter("id % 10 = 0"), 3, "id", "v")
    assert {r.n for r in found.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {3} and found.count() == 36


def test_names_of_a_batch_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "BATCH_TEXTS", 3)
    texts = spark.createDataFrame([(k, "ab" * k) for k in range(20)], "id long, text string").coalesce(1)
    got = N.names_in_texts(texts, spark.createDataFrame([("ab",), ("ba",)], "name string"), "id", "text")
    assert {tuple(r) for r in got.collect()} == {(k, "ab", k, 0) for k in range(1, 20)} | {(k, "ba", k - 1, 1) for k in range(2, 20)}


def test_state_is_asked_for_only_where_it_is_needed():
    """A round trip for each call: a key's first events read one value, later ones no log unless they are late."""
    calls = []

    class Value:
        held = None

        def exists(self):
            calls.append("exists")
            return self.held is not None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            self.held = value

    class Log(dict):
        def containsKey(self, key):
            calls.append("contains")
            return key in self

        def getValue(self, key):
            calls.append("value")
            return self[key]

        def updateValue(self, key, value):
            self[key] = value

        def iterator(self):
            calls.append("iterator")
            return iter(self.items())

    ledger = T.Ledger()
    ledger.state, ledger.last, ledger.log = Value(), Value(), Log()

    def send(*rows):
        calls.clear()
        return [tuple(r) for r in ledger.handleInputRows((1,), iter([Row(chapter=c, kind=k, id=i, amount=a) for c, k, i, a in rows]), None)]

    assert send((1, "created", 0, 100.0), (3, "payment", 2, 10.0)) == [(1, 90.0, 1)] and calls == ["get"]
    assert send((4, "interest", 1, 0.5)) == [(1, 135.0, 2)] and calls == ["get", "get"]
    assert send((2, "interest", 1, 0.5), (3, "payment", 2, 20.0)) == [(1, 195.0, 3)] and calls == ["get", "iterator"]


def test_a_bucket_of_keys_takes_a_few_calls_on_the_state():
    """Not some for each key: a trigger reads and writes the states of all keys at once, the log only if one is late."""
    import pandas as pd

    calls = []

    class Value:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    class Log(list):
        def get(self):
            calls.append("log")
            return iter(self)

        def appendValue(self, value):
            calls.append("append")
            self.append(value)

    class Now:
        def getCurrentProcessingTimeInMs(self):
            return 0

    ledger = T.Bucketed(T.Ledger(), "debt", part_events=300)
    ledger.held, ledger.log = Value(), Log()

    def send(rows):
        calls.clear()
        frame = pd.DataFrame(rows, columns=["bucket", "debt", "chapter", "kind", "id", "amount"])
        got = pd.concat(ledger.handleInputRows((7,), iter([frame[:100], frame[100:]]), Now()))
        return {r.id: (r.balance, r.n_events) for r in got.itertuples()}

    keys = range(200)
    assert send([(7, k, 5, "created", 0, 100.0) for k in keys] + [(7, k, 3, "payment", 2, 10.0) for k in keys]) == {k: (90.0, 1) for k in keys}
    assert calls == ["get", "append", "append", "update"]
    assert send([(7, k, 4, "interest", 1, 0.5) for k in keys]) == {k: (135.0, 2) for k in keys} and calls == ["get", "append", "update"]
    late = send([(7, k, 2, "interest", 1, 0.5) for k in range(50)] + [(7, k, 3, "payment", 2, 20.0) for k in range(50)])
    assert late == {k: (195.0, 3) for k in range(50)} and calls == ["get", "log", "append", "update"]


def test_blocks_of_names_are_stored_once(spark, monkeypatch):
    """A block reads its own names, not all of them again."""
    counted = []
    real = N.new_folder
    monkeypatch.setattr(N, "new_folder", lambda s: counted.append(1) or real(s))
    names = spark.createDataFrame([(f"n{k:03d}",) for k in range(60)], "name string")
    blocks = list(N.name_blocks(names, "name", 40))
    assert sorted(n for b, _ in blocks for n in b) == [f"n{k:03d}" for k in range(60)] and len(blocks) == 6 and [last for _, last in blocks] == [False] * 5 + [True] and len(counted) == 1
