"""Structured Streaming: idempotent ingestion, stateful folds, change notification, windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.upsert import ingest
from ..shipping import ship_code
from ..sources.files import payloads


def stream_table(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest_stream(raw: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Chapter payloads (column value) into one append table per section, each batch in folders of its own id, so a
    batch run again replaces itself. Rejected records go to a table of theirs. (B-26, Y-09)"""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        fine, bad = payloads(batch)
        for name, frame in {**ingest(fine), "rejected": bad}.items():
            frame.write.mode("overwrite").parquet(f"{target}/{name}/batch={batch_id}")
        batch.unpersist()

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def notify(changes: DataFrame, send: Callable[[list], None], checkpoint: str, most: int = 64) -> StreamingQuery:
    """Calls ``send`` with the sorted names of changed files, at most ``most`` in a call, until a batch's names are all
    sent; a batch that runs again sends them again. (Y-36)"""

    def push(batch: DataFrame, _: int) -> None:
        held: list = []
        for row in batch.select("path").distinct().orderBy("path").toLocalIterator():
            held.append(row[0])
            if len(held) == most:
                send(held)
                held = []
        if held:
            send(held)

    return changes.writeStream.foreachBatch(push).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _instant(events: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a time-zone timestamp; the tables' local ones are read as UTC."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(events: DataFrame, ts: str, size: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Counts per window and key. (an extension: the reference has no event-time windows)"""
    got = _instant(events, ts).withWatermark(ts, late) if events.isStreaming else _instant(events, ts)
    return got.groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), *keys, "n")


def sliding(events: DataFrame, ts: str, size: str, slide: str, keys: list[str], late: str = "1 day") -> DataFrame:
    got = _instant(events, ts).withWatermark(ts, late) if events.isStreaming else _instant(events, ts)
    return got.groupBy(F.window(ts, size, slide).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Sessions per key, ended by a gap."""
    got = _instant(events, ts).withWatermark(ts, late) if events.isStreaming else _instant(events, ts)
    return got.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), *keys, "n")


def ledger_stream(events: DataFrame) -> DataFrame:
    """Balances from a stream of ledger events: (debt_id, balance, n) per update. (L-04)

    State per debt is one number; events of a batch are folded in (chapter, kind, id) order, those that come in a later
    batch after them. ``stateful.Ledger`` folds such events in their place.
    ``events`` has debt_id, chapter, id, kind, amount (of a payment, or the rate of an interest, or the principal of a
    creation).
    """
    ship_code(events.sparkSession)
    out = "debt_id long, balance double, n long"
    state = "balance double, n long"

    def fold(key, frames, handle):
        import pandas as pd

        balance, n = handle.get if handle.exists else (0.0, 0)
        rows = pd.concat(list(frames)).sort_values(["chapter", "kind", "id"])
        for kind, amount in zip(rows["kind"], rows["amount"], strict=True):
            balance = amount if kind == "created" else balance + balance * amount if kind == "interest" else max(0.0, balance - amount)
            n += 1
        handle.update((float(balance), int(n)))
        yield pd.DataFrame({"debt_id": [key[0]], "balance": [float(balance)], "n": [int(n)]})

    return events.groupBy("debt_id").applyInPandasWithState(fold, out, state, "update", "NoTimeout")


def run_to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run what is there through a streaming frame into an in-memory table and return it. For tests and small results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
