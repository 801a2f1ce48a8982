"""The token rollup over a long history, with two writers, and with repeated and null ids."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from skeinlake.llm import token_rollup

SCHEMA = "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long"


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_compacted_history_equals_replay(spark, tmp_path):
    rng, state = random.Random(8), {}
    rollup = token_rollup.TokenRollup(spark, f"file://{tmp_path}", compact=2)
    for b in range(5):
        batch = [(rng.choice(["insert", "delete"]), i, rng.choice("ab"), "en", "t", rng.randrange(9)) for i in rng.sample(range(8), 5)]
        assert rollup.commit(f"b{b}", spark.createDataFrame(batch, SCHEMA))
        for op, i, source, lang, v, n in batch:
            state.pop(i, None)
            if op == "insert":
                state[i] = (source, lang, v, n)
        want = defaultdict(lambda: (0, 0))
        for source, lang, v, n in state.values():
            d, t = want[source, lang, v]
            want[source, lang, v] = (d + 1, t + n)
        assert totals(rollup) == want
        assert {r.doc_id: r.n_tokens for r in rollup.state().collect()} == {i: s[3] for i, s in state.items()}
    last, later = rollup._since(rollup.commits())
    assert last.seq == 4 and [m.seq for m in later] == [5]


def test_two_writers_of_one_number(spark, tmp_path, monkeypatch):
    """Another batch is committed while this one is written: this one is compared anew and both count once."""
    rollup = token_rollup.TokenRollup(spark, f"file://{tmp_path}")
    plain, calls = token_rollup.TokenRollup._write, []

    def slow(self, new, done, seq, folder):
        plain(self, new, done, seq, folder)
        calls.append(seq)
        if len(calls) == 1:
            other = token_rollup.TokenRollup(spark, f"file://{tmp_path}")
            assert other.commit("other", spark.createDataFrame([("insert", 1, "b", "en", "t", 5)], SCHEMA))

    monkeypatch.setattr(token_rollup.TokenRollup, "_write", slow)
    assert rollup.commit("mine", spark.createDataFrame([("insert", 1, "a", "en", "t", 7), ("insert", 2, "a", "en", "t", 1)], SCHEMA))
    assert totals(rollup) == {("a", "en", "t"): (2, 8)}
    assert sorted(m.seq for m in rollup.commits().values()) == [1, 2] and calls == [1, 1, 2]


def test_an_empty_marker_is_an_error(spark, tmp_path):
    rollup = token_rollup.TokenRollup(spark, f"file://{tmp_path}")
    assert rollup.commit("x", spark.createDataFrame([("insert", 1, "a", "en", "t", 5)], SCHEMA))
    (tmp_path / "commits" / "000000000002").write_text("")
    with pytest.raises(RuntimeError):
        rollup.totals()


def test_query_and_sql_agree_on_repeated_and_null_ids(spark, tmp_path):
    import duckdb

    docs = [(1, "a b.", "en", "s"), (1, "a b.", "en", "s"), (None, "x y", "en", "s"), (2, None, None, None), (3, "c", "de", "s"), (4, "d, e", "en", "z")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    labels = [(3, 1, 1), (4, 0, 0), (4, 0, 0), (9, 0, 1), (None, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"file://{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    cols = ["source", "lang", "tokenizer", "n_docs", "n_tokens"]
    want = con.execute(f"select {', '.join(cols)} from ({token_rollup.OP5_SQL})").fetchall()
    got = token_rollup.op5_query(spark, f"file://{tmp_path}").select(*cols).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
