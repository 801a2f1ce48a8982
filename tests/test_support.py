"""Step traces, timing and checker roll-ups by hand."""

from __future__ import annotations

from skeinlake.operators import reports, support


def test_step_trace(spark):
    rows = [("t", 1, "step", "a"), ("t", 2, "done", "a"), ("t", 3, "step", "c"), ("u", 1, "step", "b"), ("u", 2, "step", "odd"), ("u", 3, "done", "a"), ("u", 4, "step", "c")]
    events = spark.createDataFrame(rows, "task string, n int, event string, step string")
    got = {(r.task, r.n): (r.expected_owner, r.missing, r.violation) for r in support.step_trace(events, ["a", "b", "c"], {"a": "x", "c": "y"}).collect()}
    assert got == {("t", 1): ("x", [], False), ("t", 3): ("y", ["b"], True), ("u", 1): (None, ["a"], True), ("u", 2): (None, [], False), ("u", 4): ("y", ["b"], True)}


def test_step_timing(spark):
    log = spark.createDataFrame([("a", 20_000), ("b", 9_000), ("c", 500), ("d", 400), ("a", 200)], "step string, ms long")
    got = reports.step_timing(log).orderBy("ms", ascending=False).collect()
    assert [(r.step, r.ms, r.alarm) for r in got] == [("a", 20_200, True), ("b", 9_000, True), ("c", 500, True)] and got[0].ratio == 0.6711
    assert not reports.step_timing(log.filter("step <> 'b'")).first().alarm and reports.step_timing(log.limit(0)).count() == 0


def test_checker_rollup(spark):
    rows = [("x", 80.0, 1, 2, True), ("y", 90.0, 0, 3, False)]
    df = spark.createDataFrame(rows, "checker string, score double, critical int, high int, passed boolean")
    assert tuple(reports.checker_rollup(df).first()) == (2, 85.0, 1, 5, False)
    assert tuple(reports.checker_rollup(df.limit(0)).first()) == (0, 0.0, 0, 0, True)
