"""The scenarios of FIXTURES.md as small inputs with expectations worked out by hand, and edge cases that the driver's
tables don't have."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from skeinlake import schemas
from skeinlake.functions import scalars as S
from skeinlake.operators import aggregates, context, graph, health, joins, ledger, lookup, retrieval, snapshots, support, upsert, windows
from skeinlake.sources import files
from skeinlake.streaming import ingest as stream


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def col(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


# --- 1, 2: retrieval and tokens

CHUNKS = [("ch1_s1", "萧炎在天云宗修炼斗气"), ("ch1_s2", "药老传授炼药技巧")]


def test_bm25_scores(spark):
    docs = spark.createDataFrame(CHUNKS, "chunk_id string, content string")
    got = retrieval.bm25(docs, "萧炎修炼", 5).collect()
    assert [r.chunk_id for r in got] == ["ch1_s1", "ch1_s2"]
    assert [round(r.score, 6) for r in got] == [0.327792, 0.037984]
    post, stats = retrieval.postings(docs)
    assert stats.agg(F.avg("doc_length")).first()[0] == 9.0
    indexed = retrieval.bm25_indexed(post, stats, "萧炎修炼", 5).collect()
    assert [(r.chunk_id, round(r.score, 9)) for r in indexed] == [(r.chunk_id, round(r.score, 9)) for r in got]


def test_bm25_edges(spark):
    docs = spark.createDataFrame([("a", ""), ("b", None), ("c", "word")], "chunk_id string, content string")
    assert values(retrieval.bm25(docs, "word", 5), "chunk_id") == [("c",)]
    assert retrieval.bm25(docs, "123 !?", 5).count() == 0
    assert retrieval.bm25(docs.limit(0), "word", 5).count() == 0
    assert values(retrieval.bm25(docs, "word", 5, keep=F.col("chunk_id") != "c"), "chunk_id") == []


def test_bm25_statistics_include_what_is_filtered(spark):
    docs = spark.createDataFrame([("a", 1, "red fox"), ("b", 2, "red hen"), ("c", 3, "blue hen")], "chunk_id string, chapter int, content string")
    got = retrieval.bm25(docs, "red", 5, keep=F.col("chapter") <= 1).collect()
    tf, idf = 0.5, math.log((3 - 2 + 0.5) / (2 + 0.5) + 1)
    assert [r.chunk_id for r in got] == ["a"]
    assert got[0].score == pytest.approx(idf * tf * 2.5 / (tf + 1.5))


def test_tokenizer(spark):
    assert one(spark, S.tokenize(F.lit("萧炎hello世界world"))) == ["萧", "炎", "世", "界", "hello", "world"]
    assert one(spark, S.tokenize(F.lit("Lé 12 カナ"))) == ["l"]


# --- 3 to 7: vectors, filters, fallbacks


def test_cosine_edges(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, S.cosine(arr(0, 0), arr(1, 0))) == 0.0
    assert one(spark, S.cosine(arr(3, 4), arr(3))) == pytest.approx(9 / 15)


def hybrid_inputs(spark):
    docs = spark.createDataFrame([("c1", 1, "red fox"), ("c2", 2, "red hen"), ("c3", 3, "green hen")], "chunk_id string, chapter int, content string")
    vecs = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.0, 1.0]), ("c3", None)], "chunk_id string, embedding array<float>")
    return docs, vecs


def test_hybrid_paths(spark):
    docs, vecs = hybrid_inputs(spark)
    got = retrieval.hybrid(docs, vecs, "hen", [1.0, 0.0], n=3).collect()
    assert {r.chunk_id for r in got} == {"c1", "c2", "c3"}
    assert {r.chunk_id: r.source for r in got} == {"c1": "vector", "c2": "vector", "c3": "bm25"}
    assert values(retrieval.hybrid(docs, vecs, "hen", None, n=3), "source") == [("bm25",)] * 2
    assert retrieval.hybrid(docs, vecs, "hen", None, n=3, full_scan=False).count() == 0
    assert retrieval.hybrid(docs, vecs, "hen", [1.0, 0.0], n=3, full_scan=False, recent="chapter").count() == 3
    rr = retrieval.hybrid(docs, vecs, "hen", [1.0, 0.0], n=2, rerank=files.lexical_reranker("hen", docs))
    assert values(rr, "chunk_id", "score", "source") == [("c2", 1.0, "rerank"), ("c3", 1.0, "rerank")]


def test_rrf_by_hand(spark):
    a = spark.createDataFrame([("x", 9.0), ("y", 8.0)], "chunk_id string, score double")
    b = spark.createDataFrame([("y", 3.0), ("z", 2.0)], "chunk_id string, score double")
    got = {r.chunk_id: r.rrf for r in retrieval.rrf({"vector": a, "bm25": b}, 9).collect()}
    assert got == {"x": 1 / 61, "y": 1 / 62 + 1 / 61, "z": 1 / 62}


def test_failed_embeddings_are_null(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "id int, content string")

    def service():
        return lambda texts: [None if t == "bad" else [1.0, 0.0] for t in texts]

    got = {r.id: r.embedding for r in files.embed(docs, service, ["id"]).collect()}
    assert got == {1: [1.0, 0.0], 2: None, 3: [1.0, 0.0]}

    def broken():
        def call(texts):
            raise OSError("401")

        return call

    assert {r.embedding for r in files.embed(docs, broken, ["id"], tries=2, wait=0.0).collect()} == {None}


def test_retries_back_off():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert files.with_retries(call, 3, 1.0, waits.append) == "ok" and waits == [1.0, 2.0]
    assert files.with_retries(lambda: 1 / 0, 2, 1.0, lambda _: None) is None


def test_parents_come_before_their_first_child(spark):
    hits = spark.createDataFrame([("s3", "p1", 0), ("s1", "p2", 1), ("s2", "p1", 2), ("s9", "gone", 3)], "chunk_id string, parent_chunk_id string, rank int")
    parents = spark.createDataFrame([("p1",), ("p2",)], "chunk_id string")
    got = joins.parents_first(hits, parents).orderBy("position")
    assert [r.chunk_id for r in got.collect()] == ["p1", "s3", "p2", "s1", "s2", "s9"]


def test_recent_limits(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "chunk_id string, chapter int, scene_index int")
    assert values(lookup.top(rows, 1, "chapter desc"), "chunk_id") == [("b",)]
    assert values(lookup.top(lookup.between(rows, "chapter", None, 1), 5, "chapter desc"), "chunk_id") == [("a",)]
    assert lookup.top(rows, -3, "chapter desc").count() == 0


def test_routing():
    words = {"relationship": ["关系"], "scene": ["场景"]}
    got = retrieval.route("萧炎 与 药老 的关系 12-5", words)
    assert got["intent"] == "relationship" and got["needs_graph"] and got["time_scope"] == (5, 12)
    assert retrieval.plan_steps(got, {}) == ["graph_hybrid", "hybrid"]
    assert retrieval.choose_strategy("auto", got, False) == "hybrid" and retrieval.choose_strategy("odd", got, True) == "hybrid"
    assert retrieval.split_query("a,b；c") == ["a", "b", "c"]
    assert retrieval.time_scope("none") is None


# --- 8 to 10: graphs

EVENT = "id long, from_entity string, to_entity string, type string, action string, chapter long"
SNAP = "from_entity string, to_entity string, type string, chapter long"


def test_edges_as_of(spark):
    events = spark.createDataFrame([(1, "a", "b", "ally", "create", 1), (2, "a", "b", "ally", "remove", 2)], EVENT)
    snap = spark.createDataFrame([("a", "b", "ally", 1)], SNAP)
    assert graph.edges_as_of(events, snap.limit(0), 1).count() == 1
    assert graph.edges_as_of(events, snap.limit(0), 3).count() == 0
    assert graph.edges_as_of(events, snap, 3).count() == 0  # removed keys don't come back
    got = graph.edges_as_of(events.limit(0), spark.createDataFrame([("a", "b", "ally", 3)], SNAP), 5)
    assert values(got, "action") == [("snapshot",)]


def test_last_event_of_a_chapter_wins(spark):
    events = spark.createDataFrame([(1, "a", "b", "t", "remove", 2), (2, "a", "b", "t", "create", 2)], EVENT)
    got = joins.latest_as_of(events, graph.EDGE, "chapter", ["chapter", "id"])
    assert values(got, "id", "action") == [(2, "create")]


def test_subgraph(spark):
    edges = spark.createDataFrame([("x", "y", "t", 3), ("y", "l", "t", 5), ("q", "r", "t", 9)], SNAP)
    got, nodes = graph.subgraph(edges, "x", 2)
    assert [(a, b, h) for a, b, _, _, h in got] == [("x", "y", 1), ("y", "l", 2)] and nodes == ["x", "y", "l"]
    assert len(graph.subgraph(edges, "x", 2, 1)[0]) == 1 and len(graph.subgraph(edges, "x", 0)[0]) == 1
    assert "n_x" in graph.mermaid(got)


def plain_subgraph(edges, center, depth, cap):
    """Edge by edge over a list sorted by chapter descending, then key."""
    edges = sorted(edges, key=lambda e: (-e[3], e[0], e[1], e[2]))
    seen, nodes, frontier, out = set(), [center], {center}, []
    for _ in range(depth):
        grown = set()
        for e in edges:
            if len(out) >= cap:
                break
            if e[:3] not in seen and (e[0] in frontier or e[1] in frontier):
                seen.add(e[:3])
                out.append(e[:3])
                grown |= {x for x in e[:2] if x not in nodes}
                nodes += [x for x in dict.fromkeys(e[:2]) if x not in nodes]
        frontier = grown
    return out


@pytest.mark.parametrize("seed", range(6))
def test_subgraph_against_plain(spark, seed):
    rng = random.Random(seed)
    rows = list({(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}", rng.choice("st")): rng.randrange(5) for _ in range(18)}.items())
    rows = [(*k, c) for k, c in rows if k[0] != k[1]]
    cap = rng.choice([3, 6, 50])
    got, _ = graph.subgraph(spark.createDataFrame(rows, SNAP), "n0", 3, cap)
    assert [g[:3] for g in got] == plain_subgraph(rows, "n0", 3, cap)


def test_neighbours_and_protagonist(spark):
    edges = spark.createDataFrame([("a", "b", "t", 1), ("b", "c", "t", 1), ("c", "d", "t", 1)], SNAP)
    got = graph.neighbours(edges, spark.createDataFrame([("a",)], "id string"), 2)
    assert sorted(values(got, "id", "hop")) == [("a", 0), ("b", 1), ("c", 2)]
    people = spark.createDataFrame([("p", False), ("q", True)], "id string, is_protagonist boolean")
    names = spark.createDataFrame([("Hero", "p", "character")], "alias string, entity_id string, entity_type string")
    assert graph.protagonist(people, names) == "q"
    assert graph.protagonist(people.filter("not is_protagonist"), names, "Hero") == "p"
    assert graph.protagonist(people.limit(0), names, "Nobody") is None
    assert retrieval.normalize_ids(["Hero", "q", "x"], people, names) == ["p", "q"]
    assert retrieval.seed_entities("where is Hero now", people, names) == ["p"]


# --- 11 to 13: ledger

DEBT = "id long, debt_type string, original_amount double, current_amount double, interest_rate double, source_chapter long, due_chapter long, override_contract_id long, status string"
DEBT_EVENT = "debt_id long, event_type string, amount double, chapter long"


def test_accrual_is_idempotent(spark):
    debts = spark.createDataFrame([(1, "d", 1.0, 1.0, 0.1, 1, 2, 7, "active"), (2, "d", 2.0, 2.0, 0.2, 1, 2, 8, "active")], DEBT)
    log = spark.createDataFrame([], DEBT_EVENT)
    debts, first = ledger.accrue(debts, log, 2)
    assert sorted(values(debts, "current_amount")) == [(1.1,), (2.4,)] and first.count() == 2
    log = log.unionByName(first)
    again, none = ledger.accrue(debts, log, 2)
    assert none.count() == 0 and sorted(values(again, "current_amount")) == [(1.1,), (2.4,)]
    debts, second = ledger.accrue(debts, log, 3)
    assert sorted(values(debts, "current_amount", "status")) == [(1.2100000000000002, "overdue"), (2.88, "overdue")]
    assert second.filter("event_type = 'overdue'").count() == 2
    assert second.filter("event_type = 'interest_accrued'").agg(F.round(F.sum("amount"), 6)).first()[0] == 0.59


def test_payments(spark):
    debts = spark.createDataFrame([(1, "d", 1.0, 1.2100000000000002, 0.1, 1, 2, 7, "overdue"), (2, "d", 2.0, 2.88, 0.2, 1, 2, 7, "overdue")], DEBT)
    pay = lambda d, i, a: ledger.pay(d, spark.createDataFrame([(i, a, 4)], "debt_id long, amount double, chapter long"))
    same, none, _ = pay(debts, 1, 0.0)
    assert none.count() == 0 and sorted(same.collect()) == sorted(debts.collect())
    debts, events, done = pay(debts, 1, 0.5)
    assert values(events, "event_type") == [("partial_payment",)] and debts.filter("id = 1").first().current_amount == 0.7100000000000002
    debts, _, done = pay(debts, 1, 100.0)
    assert done.count() == 0
    debts, events, done = pay(debts, 2, 100.0)
    assert values(events, "event_type", "amount") == [("full_payment", 100.0)] and values(done, "override_contract_id") == [(7,)]


def test_replay_equals_a_loop(spark):
    rng = random.Random(1)
    debts = [(i, "d", 100.0 + i, 0.0, rng.choice([0.05, 0.1]), 1, 5, None, "active") for i in range(6)]
    log = [(i, ch, k, 1 if k == "interest" else 2, rng.choice([3.0, 40.0])) for i in range(5) for ch in range(1, 8) for k in ("interest", "payment") if rng.random() < 0.7]
    got = ledger.replay(spark.createDataFrame(debts, DEBT), spark.createDataFrame(log, "debt_id long, chapter long, kind string, id long, amount double")).collect()
    for r in got:
        balance, rate = debts[r.id][2], debts[r.id][4]
        for _, _, kind, _, amount in sorted(e for e in log if e[0] == r.id):
            balance = balance + balance * rate if kind == "interest" else max(0.0, balance - amount)
        assert r.balance == balance


def test_contract_freeze(spark):
    rows = [("c", 1, "pending", 5), ("c", 2, "pending", 5), ("c", 3, "fulfilled", 5), ("c", 4, "pending", 9), ("e", 1, "pending", 3)]
    log = spark.createDataFrame(rows, "k string, n int, status string, due int")
    got = upsert.frozen_upserts(log, ["k"], ["n"], "status", ["fulfilled", "cancelled"])
    assert sorted(map(tuple, got.collect())) == [("c", 3, "fulfilled", 5), ("e", 1, "pending", 3)]


# --- 14 to 17: trends


def test_patterns_and_hooks_limit_differently(spark):
    rows = spark.createDataFrame([(1, "h", ["A", "B"]), (2, "", ["B"]), (3, None, None)], "chapter long, hook_type string, coolpoint_patterns array<string>")
    assert sorted(values(aggregates.pattern_usage(rows, 9), "pattern", "uses")) == [("A", 1), ("B", 2)]
    assert values(aggregates.pattern_usage(rows, 2), "pattern", "uses") == [("B", 1)]
    assert values(aggregates.hook_usage(rows, 1), "hook_type", "uses") == [("h", 1)]


def test_debt_summary(spark):
    debts = spark.createDataFrame([("active", 1.0), ("overdue", 2.0), ("paid", 9.0)], "status string, current_amount double")
    contracts = spark.createDataFrame([("pending",)], "status string")
    r = aggregates.debt_summary(debts, contracts).first()
    assert (r.active_debts, r.overdue_debts, r.total, r.pending_contracts) == (1, 1, 3.0, 1)
    assert aggregates.balance(debts).first()[0] == 3.0 and aggregates.balance(debts.limit(0)).first()[0] == 0.0
    assert aggregates.debt_summary(debts.limit(0), contracts).first().total == 0.0


def test_review_trend(spark):
    dims = [dict(zip("abcdef", x, strict=True)) for x in ((7, 8, 7, 8, 8, 8), (7, 7, 7, 7, 8, 8))]
    rows = [(1, 10, 48.0, {k: float(v) for k, v in dims[0].items()}, {"critical": 0, "high": 1, "medium": 2, "low": 0}), (11, 20, 42.0, {k: float(v) for k, v in dims[1].items()}, {"critical": 1, "high": 0, "medium": 1, "low": 2})]
    df = spark.createDataFrame(rows, "start_chapter long, end_chapter long, overall_score double, dimension_scores map<string,double>, severity_counts map<string,long>")
    r = aggregates.review_trend(df, 5).first()
    assert (r.n, r.overall_avg) == (2, 45.0)
    assert dict(values(aggregates.dimension_trend(df, 5), "dimension", "average")) == {"a": 7.0, "b": 7.5, "c": 7.0, "d": 7.5, "e": 8.0, "f": 8.0}
    assert dict(values(aggregates.severity_trend(df, 5), "severity", "total")) == {"critical": 1, "high": 1, "medium": 3, "low": 2}
    assert aggregates.review_trend(df.limit(0), 5).first().overall_avg == 0.0


def test_checklist_trend(spark):
    df = spark.createDataFrame([(1, 78.5, 0.6667, 4, 3), (2, 86.0, 0.8333, 4, 4)], "chapter long, score double, completion_rate double, required_items long, completed_required long")
    r = aggregates.checklist_trend(df, 5).first()
    assert (r.n, r.score_avg, r.completion_avg, r.required_avg) == (2, 82.25, 0.75, 0.875)
    free = spark.createDataFrame([(1, 1.0, 1.0, 0, 0)], df.schema)
    assert aggregates.checklist_trend(free, 5).first().required_avg == 1.0


# --- 18 to 24: health, ranking, parsing


def test_threads(spark):
    rows = [("a", "open", "core", 20, 100), ("b", "open", "sub", 50, 150), ("c", "open", "decor", None, None), ("d", "resolved", "core", 1, 2), ("e", None, "sub", 110, 105)]
    got = {r.content: r for r in health.threads(spark.createDataFrame(rows, "content string, status string, tier string, planted_chapter long, target_chapter long"), 120).collect()}
    assert set(got) == {"a", "b", "c", "e"}
    assert (got["a"].elapsed, got["a"].overtime, got["a"].urgency) == (100, "expired", 3.75)
    assert got["b"].urgency == 1.4 and got["b"].urgency_status == "warning"
    assert got["c"].overtime == "insufficient" and got["c"].urgency is None
    assert got["e"].urgency == 4.0


def test_pacing(spark):
    rows = [(0, 4000, 2, "index"), (1, 3000, 1, "index"), (2, 5000, 2, "document")]
    r = health.pacing(spark.createDataFrame(rows, "position long, words long, points long, source string")).first()
    assert (r.points, r.words_per_point, r.missing, r.dominant_source, r.rating) == (5, 2400.0, 0, "index", "low")
    r = health.pacing(spark.createDataFrame([(0, 100, None, None)], "position long, words long, points long, source string")).first()
    assert (r.points, r.words_per_point, r.rating, r.missing) == (0, None, "insufficient", 1)


def test_positions_equal_a_global_rank(spark):
    ids = sorted(random.Random(0).sample(range(100_000), 700))
    got = health.positions(spark.createDataFrame([(i,) for i in ids], "id long").repartition(5), ["id"])
    assert {r.id: r.position for r in got.collect()} == {x: i for i, x in enumerate(ids)}


def test_rank_appearances(spark):
    df = spark.createDataFrame([("a", 9, 1), ("b", 8, 8), ("c", 9, 3)], "id string, last_chapter long, total long")
    got = context.rank_appearances(df, 10).collect()
    assert [r.id for r in got] == ["c", "b", "a"] and [round(r.score, 4) for r in got] == [0.5234, 0.5082, 0.4367]


def test_numbers_in_strings(spark):
    got = col(spark, ["12", "ch-18", "0", "no number", None]).select(S.positive_int(F.col("x"))).collect()
    assert [r[0] for r in got] == [12, 18, None, None, None]
    assert one(spark, S.first_positive(F.lit("x"), F.lit("第15章"), F.lit("200"))) == 15
    ends = col(spark, ["20-22", "[10,12]", "Review_Ch5-6.md", "none"]).select(S.review_end(F.col("x"))).collect()
    assert [r[0] for r in ends] == [22, 12, 6, 0]
    old = health.old_reviews(spark.createDataFrame([("20-22",), ("[10,12]",), ("Review_Ch5-6.md",)], "chapters string"), 30, 5)
    assert old.count() == 3


def test_style_candidates(spark):
    scenes = spark.createDataFrame([("战" * 250, 70.0), ("战" * 250, 85.0), ("短", 99.0)], "content string, score double")
    got = context.style_candidates(scenes).collect()
    assert [r.score for r in got] == [0.85]
    assert one(spark, S.first_class(F.lit("一场战斗"), {"battle": ["战"], "tension": ["危"]}, "description")) == "battle"


# --- text functions


def test_markdown_functions(spark):
    text = "# Title\nintro\n\n## 剧情摘要\nfirst line\nsecond\n## Other\n- **爽点**: two\n- a\n* b\n"
    assert one(spark, S.section(F.lit(text), "剧情摘要")) == "first line\nsecond"
    assert one(spark, S.section(F.lit(text), "absent")) == ""
    assert one(spark, S.stats_field(F.lit(text), "爽点")) == "two"
    assert one(spark, S.bullets(F.lit(text), 2)) == ["**爽点**: two", "a"]
    assert one(spark, S.split_tokens(F.lit("A+b / a、C"))) == ["A", "b", "C"]
    assert one(spark, S.volume_of(F.lit(51))) == 2 and one(spark, S.volume_of(F.lit(0))) is None
    assert one(spark, S.range_of(F.lit("9-3"))) is None
    assert one(spark, S.split_patterns(F.lit(" a, b;a ,, "))) == ["a", "b"] and one(spark, S.count_patterns(F.lit(" , "))) is None
    assert len(one(spark, S.compact(F.lit("x" * 500), 200))) <= 200 and one(spark, S.compact(F.lit("abc"), 200)) == "abc"
    assert one(spark, S.merge_maps(F.create_map(F.lit("a"), F.lit("1")), F.lit(None).cast("map<string,string>"))) == {"a": "1"}


def test_markdown_corpus(spark, tmp_path):
    (tmp_path / "第1章.md").write_text("# One\n```\ncode\n```\nRed met Blue.\n---\n- **Points**: 3\n", encoding="utf-8")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "chapter-2.md").write_text("plain", encoding="utf-8")
    (tmp_path / "notes.txt").write_text("no", encoding="utf-8")
    names = spark.createDataFrame([("Red",), ("Green",)], "name string")
    got = {r.chapter: r for r in files.chapters(files.markdown(spark, f"file://{tmp_path}"), "Points", names).collect()}
    assert set(got) == {1, 2} and got[1].title == "One" and got[1].stat == "3" and got[1].characters == ["Red"]
    assert got[2].word_count == 5 and got[2].title is None
    rows = files.markdown(spark, f"file://{tmp_path}")
    assert values(support.named_files(rows, "chapter"), "file") == [("chapter-2.md",)]
    single = spark.createDataFrame([(1, "own")], "chapter long, text string")
    volume = spark.createDataFrame([("# 第1章\nx\n# 第2章\n" + "y" * 2000,)], "text string")
    outlines = dict(values(files.outlines(single, volume), "chapter", "outline"))
    assert outlines[1] == "own" and len(outlines[2]) == 1503 and outlines[2].endswith("...")


def test_documents_and_payloads(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"a": 1, "b": [1, 2]}')
    (tmp_path / "bad.json").write_text("{broken")
    kind = schemas.T.StructType.fromDDL("a int, b array<int>")
    assert files.json_document(spark, f"file://{tmp_path}/good.json", kind).first().b == [1, 2]
    assert files.json_document(spark, f"file://{tmp_path}/bad.json", kind).first().a is None
    raw = spark.createDataFrame([(json.dumps({"chapter": 3, "title": "t"}),), ("nonsense",), ('{"title": "x"}',)], "value string")
    fine, bad = files.payloads(raw)
    assert values(fine, "chapter") == [(3,)] and fine.first().scenes == []
    assert sorted(values(bad, "reason")) == [("malformed",), ("no chapter",)]
    assert files.table(spark, f"file://{tmp_path}", "chapters").count() == 0
    assert files.columns_missing(raw, schemas.record_type("chapters"))[0] == "chapter"
    assert all(schemas.record_type(n).fields for n in schemas.SCHEMAS)


# --- mutations


def payload(chapter, **more):
    return json.dumps(
        {
            "chapter": chapter,
            "entities_appeared": [{"id": "a", "type": "character", "mentions": ["A"], "confidence": 0.9}, {"id": "NEW", "type": "character"}],
            "entities_new": [{"suggested_id": "n", "name": "Nora", "type": "character", "tier": "core"}],
            "state_changes": [{"entity_id": "a", "field": "mood", "old": None, "new": "glad"}],
            "relationships_new": [{"from": "a", "to": "n", "type": "friend"}],
            "scenes": [{"index": 1, "summary": "s"}],
            **more,
        }
    )


def test_ingest_batch_equals_stream(spark, tmp_path):
    lines = [payload(1), payload(2), "broken"]
    fine, _ = files.payloads(spark.createDataFrame([(x,) for x in lines], "value string"))
    tables = upsert.ingest(fine)
    assert tables["appearances"].count() == 4 and tables["aliases"].count() == 1
    assert values(tables["chapters"], "characters") == [(["a"],), (["a"],)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_text("\n".join(lines))
    raw = spark.readStream.text(f"file://{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        stream.ingest_stream(raw, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    for name, frame in tables.items():
        assert spark.read.parquet(f"file://{tmp_path}/out/{name}").count() == frame.count()
    assert spark.read.parquet(f"file://{tmp_path}/out/rejected").count() == 1


def test_ledger_stream_equals_fold(spark, tmp_path):
    rows = [(1, 1, 1, "created", 100.0), (1, 2, 2, "interest", 0.1), (1, 3, 3, "payment", 30.0), (2, 1, 4, "created", 5.0), (2, 2, 5, "payment", 9.0)]
    spark.createDataFrame(rows, "debt_id long, chapter long, id long, kind string, amount double").coalesce(1).write.parquet(f"file://{tmp_path}/log")
    src = spark.readStream.schema("debt_id long, chapter long, id long, kind string, amount double").parquet(f"file://{tmp_path}/log")
    got = stream.run_to_table(stream.ledger_stream(src), "balances", f"file://{tmp_path}/cp", "update")
    assert {r.debt_id: r.balance for r in got.collect()} == {1: 100.0 + 100.0 * 0.1 - 30.0, 2: 0.0}


def test_streamed_windows_equal_batch(spark, data_dir, tmp_path):
    events = spark.read.parquet(f"{data_dir}/events.parquet")
    want = sorted(map(tuple, stream.tumbling(events, "ts", "1 day", ["event_type"]).collect()))
    events.write.parquet(f"file://{tmp_path}/events")
    src = stream.stream_table(spark, f"file://{tmp_path}/events", events.schema)
    got = stream.run_to_table(stream.tumbling(src, "ts", "1 day", ["event_type"]), "days", f"file://{tmp_path}/cp")
    assert sorted(map(tuple, got.collect())) == want


def test_notifications(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x")
    src = spark.readStream.text(f"file://{tmp_path}/in").select(F.col("_metadata.file_name").alias("path"))
    sent = []
    stream.notify(src, sent.extend, f"file://{tmp_path}/cp").awaitTermination()
    assert sent == ["a.txt"]


def test_latest_and_first_wins_ties(spark):
    log = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 2, "c"), (None, 1, "z")], "k string, n int, v string")
    assert sorted(values(upsert.latest_wins(log, ["k"], ["n"]), "k", "v"), key=str) == [("k", "c"), (None, "z")]
    assert sorted(values(upsert.first_wins(log, ["k"], ["n"]), "k", "v"), key=str) == [("k", "a"), (None, "z")]
    assert upsert.latest_wins(log, ["k"], ["n"], keep_first=["v"]).filter("k = 'k'").first() == ("k", 2, "a")
    assert upsert.latest_wins(log.limit(0), ["k"], ["n"]).count() == 0


def test_entity_upsert_keeps_first_appearance(spark):
    cols = "id string, tier string, first_appearance long, last_appearance long, current map<string,string>"
    old = spark.createDataFrame([("a", "core", 1, 9, {"x": "1", "y": "2"})], cols)
    new = spark.createDataFrame([("a", "decor", 5, 7, {"y": "3"}), ("b", "sub", 7, 7, None)], cols)
    got = {r.id: r for r in upsert.upsert_entities(old, new, ["tier"]).collect()}
    assert (got["a"].tier, got["a"].first_appearance, got["a"].last_appearance, got["a"].current) == ("core", 1, 7, {"x": "1", "y": "3"})
    assert got["b"].tier == "sub"
    assert upsert.upsert_entities(old, new, ["tier"], True).filter("id = 'a'").first().tier == "decor"


def test_event_cleaning(spark):
    kind = "from_entity string, to_entity string, type string, action string, polarity long, strength double, confidence double, chapter long"
    rows = [(" a ", "b", "enemy", "odd", None, 7.0, None, 1), ("a", "b", "friend", "create", 5, 0.0, 0.0, 1), ("", "b", "x", "create", 0, 1.0, 1.0, 1), ("a", "b", "x", "create", 0, 1.0, 1.0, 0)]
    got = upsert.clean_relationship_events(spark.createDataFrame(rows, kind), ["enemy"], ["friend"]).collect()
    assert [(r.from_entity, r.action, r.polarity, r.strength, r.confidence) for r in got] == [("a", "update", -1, 1.0, 1.0), ("a", "create", 1, 0.0, 0.0)]


def test_migration_and_snapshots(spark, tmp_path):
    doc = spark.createDataFrame([({"character": {"a": ("Ann", "core", 1, 2, ["A", "B"]), "z": (None, None, None, None, None)}},)], "entities map<string,map<string,struct<name:string,tier:string,first_appearance:long,last_appearance:long,aliases:array<string>>>>")
    got = support.migrate_document(doc)
    assert got["entities"].count() == 2 and got["aliases"].count() == 2 and values(got["skipped"], "id") == [("z",)]
    pack = spark.createDataFrame([(1, "x")], "a int, b string")
    assert snapshots.load_snapshot(spark, f"file://{tmp_path}", "v1", 3) is None
    snapshots.save_snapshot(pack, f"file://{tmp_path}", "v1", 3)
    assert snapshots.load_snapshot(spark, f"file://{tmp_path}", "v1", 3).count() == 1
    with pytest.raises(snapshots.VersionMismatch):
        snapshots.load_snapshot(spark, f"file://{tmp_path}", "v2", 3)


def test_task_machine(spark):
    rows = [("t", 1, "start", None), ("t", 2, "step", "a"), ("t", 3, "done", "b"), ("t", 4, "step", "b"), ("t", 5, "done", "b"), ("t", 6, "start", None), ("t", 7, "complete", None), ("u", 1, "done", "a")]
    got = {r.task: r for r in support.task_state(spark.createDataFrame(rows, "task string, n int, event string, step string")).collect()}
    assert (got["t"].status, got["t"].retries, got["t"].failed, got["t"].done) == ("completed", 1, 1, "b")
    assert got["u"].status == "none"


# --- runs, ranges, groups


def plain_run(flags):
    best = now = 0
    for f in flags:
        now = now + 1 if f else 0
        best = max(best, now)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_longest_runs_over_blocks(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for k in range(8):
        flags = [rng.random() < 0.6 for _ in range(rng.randint(1, 40))]
        cuts = sorted(rng.sample(range(60), 3))
        rows += [(k, sum(i >= c for c in cuts), i, f) for i, f in enumerate(flags)]
        want[k] = (len(flags), plain_run(flags), plain_run([not f for f in flags]))
    got = windows.longest_runs(spark.createDataFrame(rows, "k int, b int, n int, f boolean"), "k", "b", ["n"], F.col("f"))
    assert {r.k: (r.n, r.longest_run, r.longest_gap) for r in got.collect()} == want


def test_containing_range(spark):
    ranges = spark.createDataFrame([(1, 1, 100), (2, 50, 60), (3, 50, 400)], "volume long, first long, last long")
    points = spark.createDataFrame([(5,), (55,), (300,), (900,)], "chapter long")
    got = joins.containing_range(points, ranges, "chapter", "first", "last", "volume")
    assert sorted(values(got, "chapter", "volume")) == [(5, 1), (55, 2), (300, 3)]


def test_group_top_and_checks(spark):
    rows = spark.createDataFrame([("hot", i, float(i % 50)) for i in range(500)] + [("cold", 1000, 1.0)], "g string, id long, score double")
    got = values(lookup.per_group_top(rows, "g", 2, "score desc", "id"), "g", "id")
    assert sorted(got) == [("cold", 1000), ("hot", 49), ("hot", 99)]
    checks = {k: one(spark, c) for k, c in health.opening_checks(F.lit("a sword and a duel"), {"fight": (["sword", "duel"], 2), "calm": (["tea"], 1)}).items()}
    assert checks == {"fight": True, "calm": False}
    assert health.archive_due(10, 20) and not health.archive_due(10, 21) and health.archive_due(1_000_000, 3)
    assert context.stage(30) == "early" and context.stage(31) == "mid" and context.stage(120) == "late"
    flags = health.risk_flags(spark.createDataFrame([(80.0, 0, 5, 90.0, 0.9), (90.0, 0, 0, 90.0, 0.9)], "overall_avg double, critical int, high int, checklist_avg double, completion double")).collect()
    assert [r.flags for r in flags] == [["many_high"], ["stable"]]


def test_invalid_items(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    facts = spark.createDataFrame([("a", "confirmed"), ("a", "pending"), ("b", "pending")], "source_id string, status string")
    assert sorted(values(joins.drop_invalid(items, facts, "k"), "k", "pending")) == [("b", True), ("c", False)]
    decisions = spark.createDataFrame([("a", "dismiss", 1), ("b", "confirm", 1), ("b", "odd", 2)], "id string, action string, at int")
    kept = upsert.resolve_facts(facts.withColumnRenamed("source_id", "id"), decisions)
    assert values(kept, "id", "status") == [("b", "confirmed")]
