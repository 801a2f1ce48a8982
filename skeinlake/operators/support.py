"""Supporting operators: task state, exports, world settings, paths, caches of assembled context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def task_state(events: DataFrame) -> DataFrame:
    """State of each task from its log: (task, status, step, retries, done). (Y-33)

    ``events`` has task, n (order), event (start, step, done, fail, complete) and step. Starting a task that runs counts
    a retry; a new step fails the one before; only the current step can be done. Folded over the sorted log of a task.
    """
    logs = events.groupBy("task").agg(F.sort_array(F.collect_list(F.struct("n", "event", "step"))).alias("log"))
    zero = F.struct(
        F.lit("none").alias("status"), F.lit(None).cast("string").alias("step"), F.lit(0).alias("retries"), F.lit(0).alias("failed"), F.array().cast("array<string>").alias("done")
    )

    def step(a: Column, e: Column) -> Column:
        kind = e["event"]
        running = a["status"] == "running"
        mine = (kind == "done") & running & (a["step"] == e["step"])
        status = F.when(kind == "start", "running").when(running & (kind == "fail"), "failed").when(running & (kind == "complete"), "completed").otherwise(a["status"])
        now = F.when(running & (kind == "step"), e["step"]).when(mine | kind.isin("start", "complete", "fail"), F.lit(None).cast("string")).otherwise(a["step"])
        lost = running & a["step"].isNotNull() & kind.isin("step", "fail")
        return F.struct(
            status.alias("status"),
            now.alias("step"),
            (a["retries"] + F.when(running & (kind == "start"), 1).otherwise(0)).alias("retries"),
            (a["failed"] + F.when(lost, 1).otherwise(0)).alias("failed"),
            F.when(mine, F.concat(a["done"], F.array(e["step"]))).otherwise(a["done"]).alias("done"),
        )

    got = logs.select("task", F.aggregate("log", zero, step).alias("s"))
    return got.select("task", "s.status", "s.step", "s.retries", "s.failed", F.array_join("s.done", ",").alias("done"))


def step_trace(events: DataFrame, order: list[str], owners: dict[str, str]) -> DataFrame:
    """(task, n, step, expected_owner, missing, violation) of each started step: who should run it, and the steps before
    it in ``order`` that the task hasn't done yet. (Y-33, K-15)

    ``events`` are those of ``task_state``. What a task has done is aggregated per step, of which there are few, so no
    task's log is collected; a step that isn't in ``order`` has nothing before it.
    """
    table = events.sparkSession.createDataFrame([(s, p) for k, s in enumerate(order) for p in order[:k]], "step string, before string")
    done = events.filter("event = 'done'").groupBy("task", F.col("step").alias("before")).agg(F.min("n").alias("done_at"))
    started = events.filter("event = 'step'").select("task", "n", "step")
    need = started.join(F.broadcast(table), "step").join(done, ["task", "before"], "left")
    open_ = need.filter(F.col("done_at").isNull() | (F.col("done_at") > F.col("n"))).groupBy("task", "n").agg(F.sort_array(F.collect_set("before")).alias("missing"))
    owner = F.lit(None).cast("string")
    for step, who in owners.items():
        owner = F.when(F.col("step") == step, F.lit(who)).otherwise(owner)
    got = started.join(open_, ["task", "n"], "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))
    return got.select("task", "n", "step", owner.alias("expected_owner"), "missing", (F.size("missing") > 0).alias("violation"))


def recovery(tasks: DataFrame, table: DataFrame) -> DataFrame:
    """Options for interrupted tasks from a decision table by step. (Y-34, K-15)"""
    return tasks.join(table, "step", "left")


def slim(col: Column, n: int, field: str = "name") -> Column:
    """The names of the first ``n`` items of a list. (Y-18)"""
    return F.slice(F.transform(col, lambda x: x[field]), 1, n)


def progress(log: DataFrame) -> DataFrame:
    """Greatest chapter and sum of words written. (Y-17, B-26, B-32)"""
    return log.agg(F.coalesce(F.max("chapter"), F.lit(0)).alias("current_chapter"), F.coalesce(F.sum("words"), F.lit(0)).alias("total_words"))


def migrate_document(doc: DataFrame) -> dict[str, DataFrame]:
    """Tables from a nested document with maps of entities (type -> id -> record). (B-27, Y-14)"""
    flat = doc.select(F.explode("entities").alias("type", "by_id")).select("type", F.explode("by_id").alias("id", "r"))
    return {
        "entities": flat.select("id", "type", F.col("r.name").alias("canonical_name"), "r.tier", "r.first_appearance", "r.last_appearance"),
        "aliases": flat.select(F.explode("r.aliases").alias("alias"), F.col("id").alias("entity_id"), F.col("type").alias("entity_type")).distinct(),
        "skipped": flat.filter("r.name is null").select("id", "type"),
    }


def export_for_context(entities: DataFrame, now: int, n: int = 50) -> DataFrame:
    """A compact projection of the entities seen last. (Y-15)"""
    return entities.filter(F.coalesce(F.col("last_appearance"), F.lit(0)) <= now).orderBy(F.desc_nulls_last("last_appearance"), "id").limit(n).select("id", "type", "canonical_name", "tier", "last_appearance")


def named_files(files: DataFrame, keyword: str) -> DataFrame:
    """The file of that name, else the first by name that contains it. (Y-21)"""
    stem = F.regexp_replace("file", r"\.[^.]+$", "")
    hit = files.filter(stem.contains(keyword))
    return hit.orderBy((stem == keyword).desc(), "file").limit(1)
