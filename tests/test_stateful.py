"""Tasks and ledgers over streams with restarts: late events, repeats, abandoned tasks and their re-entry."""

from __future__ import annotations

import random

from skeinlake.operators import support
from skeinlake.operators.storage import new_folder
from skeinlake.streaming import stateful as T

EVENTS = "task long, n long, event string, step string"


def plain_states(spark, rows):
    return {tuple(r) for r in support.task_state(spark.createDataFrame(rows, EVENTS)).collect()}


def test_late_events_fold_in_their_place(spark):
    rng = random.Random(3)
    rows = []
    for task in range(12):
        rows.append((task, 0, "start", None))
        for n in range(1, 15):
            rows.append((task, n, rng.choice(["step", "done", "step", "done", "start", "fail", "complete"]), rng.choice("ab")))
    dealt = [[r for r in rows if (r[0] * 7 + r[1] * 3) % 3 == k] for k in range(3)]
    turns = [spark.createDataFrame(part, EVENTS) for part in dealt]
    got = T.run_in_turns(spark, turns, "task", T.Tasks, new_folder(spark))
    assert {tuple(r) for r in got.collect()} == plain_states(spark, rows)


def test_repeated_events_and_silent_tasks(spark):
    """A task that stays silent is abandoned when the next batch comes; a start goes on as a retry."""
    frame = lambda rows: spark.createDataFrame(rows, EVENTS)
    turns = [
        frame([(1, 0, "start", None), (1, 1, "step", "a"), (1, 1, "step", "a"), (2, 0, "start", None), (2, 1, "complete", None)]),
        frame([(3, 0, "start", None)]),
        frame([(1, 2, "start", None), (1, 3, "step", "b"), (1, 4, "done", "b")]),
    ]
    folder = new_folder(spark)
    got = T.run_in_turns(spark, turns, "task", lambda: T.Tasks(abandoned_ms=1500), folder, pause=2.0)
    rows = {r.task: tuple(r)[1:] for r in got.collect()}
    assert rows[1] == ("running", None, 1, 0, "b") and rows[2][0] == "completed" and rows[3][0] == "abandoned"
    seen = {(r.task, r.status) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert (1, "abandoned") in seen and (2, "abandoned") not in seen
