"""State machines and ledgers over streams of events, with state that outlives restarts. (Y-33, L-04)

Each key has its folded state and, for a while, the log of its events as map state: an event that comes after later ones
of its key makes the fold start again from the log, so what holds at the end doesn't depend on which trigger brought what.
Logs are kept for a time to live and never come into one row. A task that is running but sends nothing for some time is
marked as abandoned by a timer.

Each call on the state is a round trip between Python and Spark, several for each key and trigger. So the runs over streams
keep the keys in buckets (``Bucketed``): a trigger has a few calls a bucket, however many keys it brings. What it costs is
that a late event reads the log of its bucket, part by part.
"""

from __future__ import annotations

import pickle
import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..shipping import ship_code

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long logs are kept, and after how long a silent running task is abandoned.
LOG_TTL_MS, ABANDONED_MS = 7 * 86_400_000, 86_400_000
#: Buckets that keys are dealt to, and events in a part of a bucket's log. A stream keeps the number it began with.
BUCKETS, PART_EVENTS = 1 << 11, 1 << 13
BUCKET = "bucket"


class Folded(StatefulProcessor):
    """Folds a key's events in their own order. What a fold is made of is in the subclasses: ``zero``, ``advance`` and
    ``result`` of a state that is a tuple; ``place`` and ``event`` of a row; ``patience`` and ``silent`` if time changes it."""

    state_schema: str
    place_schema: str
    event_schema: str

    def __init__(self, ttl_ms: int = LOG_TTL_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)
        self.last = handle.getValueState("last", self.place_schema)
        self.log = handle.getMapState("log", self.place_schema, self.event_schema, self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new: dict[tuple, tuple] = {}
        for row in rows:
            # Of several events at one place the last by its content holds, whichever came first.
            place, event = self.place(row), self.event(row)
            new[place] = max(event, new.get(place, event), key=str)
        # Each call on the state is a round trip, so the log is read only for events that belong before the last one.
        last = self.last.get()
        last = tuple(last) if last is not None else None
        if last is not None and min(new) <= last:
            state, events = self.zero(), {tuple(p): tuple(e) for p, e in self.log.iterator()}
            new = {p: max(e, events.get(p, e), key=str) for p, e in new.items()}
            events |= new
        else:
            state, events = tuple(self.state.get()) if last is not None else self.zero(), new
        for place, event in new.items():
            self.log.updateValue(place, event)
        for place in sorted(events):
            state = self.advance(state, events[place])
        self.state.update(state)
        if last is None or max(new) > last:
            self.last.update(max(new))
        self.after(state, timerValues)
        yield self.result(key, state)

    def columns(self, frame: pd.DataFrame) -> tuple[Iterable[tuple], Iterable[tuple]]:
        """``place`` and ``event`` of all rows of a frame."""
        rows = list(frame.itertuples(index=False))
        return map(self.place, rows), map(self.event, rows)

    def after(self, state: tuple, timerValues) -> None:
        """What else is to be done with a new state."""

    def patience(self, state: tuple) -> int | None:
        """After how many milliseconds without events ``silent`` changes the state, None if it doesn't."""
        return None

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return iter(())

    def close(self) -> None:
        pass


class Tasks(Folded):
    """The state of a task, as ``support.task_state`` folds it; running ones that stay silent become ``abandoned``, from
    which a start goes on as a retry."""

    state_schema = "status string, step string, retries int, failed int, done array<string>"
    place_schema = "n long"
    event_schema = "event string, step string"
    out = "task long, status string, step string, retries int, failed int, done string"

    def __init__(self, ttl_ms: int = LOG_TTL_MS, abandoned_ms: int = ABANDONED_MS):
        super().__init__(ttl_ms)
        self.abandoned_ms = abandoned_ms

    def zero(self) -> tuple:
        return "none", None, 0, 0, []

    def place(self, row: Row) -> tuple:
        return (int(row.n),)

    def event(self, row: Row) -> tuple:
        return row.event, row.step

    def advance(self, state: tuple, event: tuple) -> tuple:
        (status, now, retries, failed, done), (kind, step) = state, event
        done = list(done or [])
        if kind == "start":
            return "running", None, retries + (status in ("running", "abandoned")), failed, done
        if status != "running":
            return status, now, retries, failed, done
        if kind == "step":
            return status, step, retries, failed + (now is not None), done
        if kind == "done" and now == step:
            return status, None, retries, failed, [*done, step]
        if kind in ("fail", "complete"):
            return {"fail": "failed", "complete": "completed"}[kind], None, retries, failed + (kind == "fail" and now is not None), done
        return status, now, retries, failed, done

    def result(self, key: tuple, state: tuple) -> Row:
        status, step, retries, failed, done = state
        return Row(task=key[0], status=status, step=step, retries=int(retries), failed=int(failed), done=",".join(done or []))

    def patience(self, state: tuple) -> int | None:
        return self.abandoned_ms if state[0] == "running" else None

    def silent(self, state: tuple) -> tuple:
        return ("abandoned", *state[1:])

    def after(self, state: tuple, timerValues) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if state[0] == "running":
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.abandoned_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = tuple(self.state.get()) if self.state.exists() else self.zero()
        if state[0] == "running":
            state = self.silent(state)
            self.state.update(state)
            yield self.result(key, state)


class Ledger(Folded):
    """The balance of a debt, as ``ledger.replay`` folds it: its principal, then interest and payments by chapter, kind and
    id. A principal that comes late is where the fold starts again."""

    state_schema = "balance double, n long"
    place_schema = "chapter long, kind string, id long"
    event_schema = "kind string, amount double"
    out = "id long, balance double, n_events int"
    #: Before all chapters.
    FIRST = -(1 << 62)

    def zero(self) -> tuple:
        return 0.0, 0

    def place(self, row: Row) -> tuple:
        return (self.FIRST if row.kind == "created" else int(row.chapter)), row.kind, int(row.id)

    def event(self, row: Row) -> tuple:
        return row.kind, float(row.amount)

    def columns(self, frame: pd.DataFrame) -> tuple[Iterable[tuple], Iterable[tuple]]:
        kinds = frame["kind"].tolist()
        chapters = frame["chapter"].where(frame["kind"] != "created", self.FIRST).astype("int64").tolist()
        return zip(chapters, kinds, frame["id"].tolist(), strict=True), zip(kinds, frame["amount"].tolist(), strict=True)

    def advance(self, state: tuple, event: tuple) -> tuple:
        (balance, n), (kind, amount) = state, event
        if kind == "created":
            return float(amount), int(n)
        return (balance + balance * amount if kind == "interest" else max(0.0, balance - amount)), int(n) + 1

    def result(self, key: tuple, state: tuple) -> Row:
        return Row(id=key[0], balance=float(state[0]), n_events=int(state[1]))


class Bucketed(StatefulProcessor):
    """The fold of another processor over all keys of a bucket: their states are one value, and what a trigger brings is
    appended to the bucket's log in parts of bounded size. One timer a bucket stands for the key that is due first. Rows
    come as data frames, which Spark hands over by the column."""

    def __init__(self, fold: Folded, key: str, part_events: int = PART_EVENTS):
        self.fold, self.key, self.part_events = fold, key, part_events

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "states binary")
        self.log = handle.getListState("log", "events binary", self.fold.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fold, new = self.fold, {}
        for frame in rows:
            for k, place, event in zip(frame[self.key].tolist(), *fold.columns(frame.drop(columns=BUCKET, errors="ignore")), strict=True):
                events = new.setdefault(k, {})
                events[place] = max(event, events[place], key=str) if place in events else event
        held = self._held()  # key -> (state, last place, when it is due)
        late = {k for k, events in new.items() if k in held and min(events) <= held[k][1]}
        logged = self._logged(late) if late else {}
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        for k, events in new.items():
            state, last, _ = held.get(k) or (fold.zero(), max(events), None)
            if k in late:
                was = logged.get(k, {})
                new[k] = {p: max(e, was[p], key=str) if p in was else e for p, e in events.items()}
                state, events = fold.zero(), was | new[k]
            for place in sorted(events):
                state = fold.advance(state, events[place])
            wait = fold.patience(state)
            held[k] = state, max(last, max(events)), None if wait is None else now + wait
            out.append(fold.result((k,), state))
        fresh = [(k, p, e) for k, events in new.items() for p, e in events.items()]
        for at in range(0, len(fresh), self.part_events):
            self.log.appendValue((pickle.dumps(fresh[at : at + self.part_events]),))
        self._keep(held)
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, now, out = self._held(), timerValues.getCurrentProcessingTimeInMs(), []
        for k, (state, last, due) in held.items():
            if due is not None and due <= now:
                held[k] = self.fold.silent(state), last, None
                out.append(self.fold.result((k,), held[k][0]))
        self._keep(held)
        yield self._frame(out)

    def close(self) -> None:
        pass

    def _frame(self, rows: list[Row]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in self.fold.out.split(",")])

    def _held(self) -> dict:
        held = self.held.get()
        return pickle.loads(held[0]) if held is not None else {}

    def _keep(self, held: dict) -> None:
        self.held.update((pickle.dumps(held),))
        if type(self.fold).patience is Folded.patience:
            return
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if due := [d for _, _, d in held.values() if d is not None]:
            self.handle.registerTimer(min(due))

    def _logged(self, keys: set) -> dict[object, dict[tuple, tuple]]:
        """The events of some keys. Of those at one place the last holds: it was compared with the ones before."""
        found: dict[object, dict[tuple, tuple]] = {}
        for (part,) in self.log.get():
            for k, place, event in pickle.loads(part):
                if k in keys:
                    found.setdefault(k, {})[place] = event
        return found


def folded(events: DataFrame, key: str, processor: Folded, buckets: int | None = BUCKETS) -> DataFrame:
    """A row of the processor's ``out`` for each key that a trigger brings events of, or whose timer expires. Without
    buckets each key has a state of its own."""
    ship_code(events.sparkSession)
    if buckets is None:
        return events.groupBy(key).transformWithState(processor, processor.out, "Update", "ProcessingTime")
    dealt = events.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)))
    return dealt.groupBy(BUCKET).transformWithStateInPandas(Bucketed(processor, key), processor.out, "Update", "ProcessingTime")


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB, which map state, timers and times to
    live need; the caller's settings stay as they are.

    Without batches that bring no data, as with them a run over what is there never ends: processing time always passes.
    Timers go off in the next batch that has data of any key.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.checkpoint.dir"):
        if (value := spark.conf.get(name, None)) is not None and spark.conf.isModifiable(name):
            own.conf.set(name, value)
    return own


def run_folded(spark: SparkSession, source: str, schema, key: str, processor: Folded, target: str, checkpoint: str) -> StreamingQuery:
    """Start a run over what is new in the Parquet folder ``source``; a batch's rows replace themselves if it runs again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    events = spark.readStream.schema(schema).parquet(source)
    return folded(events, key, processor).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_in_turns(spark: SparkSession, turns: Iterable[DataFrame], key: str, make: Callable[[], Folded], folder: str, pause: float = 0.0) -> DataFrame:
    """Add each frame of events to a folder and run the stream over it, stopped and started again in between; the last row
    of each key."""
    own = stateful_session(spark)
    for k, events in enumerate(turns):
        if k:
            time.sleep(pause)
        events.write.mode("append").parquet(f"{folder}/in")
        run_folded(own, f"{folder}/in", events.schema, key, make(), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    rows = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    columns = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(columns[0]).agg(F.max_by(F.struct(*columns[1:]), "batch").alias("r")).select(columns[0], "r.*")
