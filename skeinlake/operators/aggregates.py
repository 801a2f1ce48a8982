"""Aggregates and trend statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import top


def recent_by_entity(appearances: DataFrame, n: int, entity: str = "entity_id", at: str = "chapter") -> DataFrame:
    """Last appearance and number of appearances, the latest first. (E-01)"""
    got = appearances.groupBy(entity).agg(F.max(at).alias("last_chapter"), F.count("*").alias("total"))
    return top(got, n, "last_chapter desc", entity)


def balance(debts: DataFrame) -> DataFrame:
    """Sum of open amounts, 0 if there is none. (E-02)"""
    return debts.filter(F.col("status").isin("active", "overdue")).agg(F.coalesce(F.sum("current_amount"), F.lit(0.0)).alias("balance"))


def debt_summary(debts: DataFrame, contracts: DataFrame) -> DataFrame:
    """Counts and sums per status in one pass, pending contracts and the total. (E-03)"""
    on = lambda s: F.col("status") == s
    d = debts.agg(
        F.count_if(on("active")).alias("active_debts"),
        F.count_if(on("overdue")).alias("overdue_debts"),
        F.coalesce(F.sum(F.when(on("active"), F.col("current_amount"))), F.lit(0.0)).alias("active_total"),
        F.coalesce(F.sum(F.when(on("overdue"), F.col("current_amount"))), F.lit(0.0)).alias("overdue_total"),
    )
    c = contracts.agg(F.count_if(on("pending")).alias("pending_contracts"))
    return one_row([d, c]).withColumn("total", F.col("active_total") + F.col("overdue_total"))


def one_row(frames: list[DataFrame]) -> DataFrame:
    """Frames of one row each, side by side, joined on a constant key. (E-04)"""
    keyed = [f.withColumn("__one", F.lit(1)) for f in frames]
    return reduce(lambda a, b: a.join(F.broadcast(b), "__one"), keyed).drop("__one")


def count_per(df: DataFrame, group: str, name: str = "n", missing: str | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """Rows per group, null under a name of its own, and further aggregates by name. (E-06, E-12, E-15, E-16)"""
    key = F.coalesce(F.col(group).cast("string"), F.lit(missing)).alias(group) if missing else F.col(group)
    return df.groupBy(key).agg(F.count("*").alias(name), *[c.alias(n) for n, c in (more or {}).items()])


def pattern_usage(reading: DataFrame, n: int, patterns: str = "coolpoint_patterns") -> DataFrame:
    """Uses of each pattern in the last ``n`` chapters: the rows are limited first, then exploded. (E-07)"""
    return top(reading, n, "chapter desc").select(F.explode(patterns).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("uses"))


def hook_usage(reading: DataFrame, n: int) -> DataFrame:
    """Hook types of the last ``n`` chapters that have one: filtered first, then limited. (E-08)"""
    some = reading.filter(F.col("hook_type").isNotNull() & (F.col("hook_type") != ""))
    return count_per(top(some, n, "chapter desc"), "hook_type", "uses")


def review_trend(reviews: DataFrame, n: int) -> DataFrame:
    """Over the last ``n`` reviews: number and mean overall score to 2 places. (E-09)"""
    last = top(reviews, n, "end_chapter desc", "start_chapter desc")
    return last.agg(F.count("*").alias("n"), F.coalesce(F.round(F.avg("overall_score"), 2), F.lit(0.0)).alias("overall_avg"))


def dimension_trend(reviews: DataFrame, n: int) -> DataFrame:
    """Mean of each dimension over the last ``n`` reviews that have it, to 2 places. (E-09)"""
    last = top(reviews, n, "end_chapter desc", "start_chapter desc").select(F.explode("dimension_scores").alias("dimension", "v"))
    return last.filter("v is not null").groupBy("dimension").agg(F.round(F.avg("v"), 2).alias("average"))


def severity_trend(reviews: DataFrame, n: int) -> DataFrame:
    """Sum of each severity's count over the last ``n`` reviews. (E-09)"""
    last = top(reviews, n, "end_chapter desc", "start_chapter desc").select(F.explode("severity_counts").alias("severity", "v"))
    return last.groupBy("severity").agg(F.sum("v").alias("total"))


def checklist_trend(scores: DataFrame, n: int) -> DataFrame:
    """Over the last ``n`` checklists: mean score (2 places), completion and required rates (4); a checklist that
    requires nothing has the required rate 1. (E-10)"""
    last = top(scores, n, "chapter desc")
    rate = F.when(F.col("required_items") > 0, F.col("completed_required") / F.col("required_items")).otherwise(F.lit(1.0))
    return last.agg(
        F.count("*").alias("n"),
        F.coalesce(F.round(F.avg("score"), 2), F.lit(0.0)).alias("score_avg"),
        F.coalesce(F.round(F.avg("completion_rate"), 4), F.lit(0.0)).alias("completion_avg"),
        F.coalesce(F.round(F.avg(rate), 4), F.lit(0.0)).alias("required_avg"),
    )


def shares(df: DataFrame, label: str, known: list[str], group: list[str] | None = None) -> DataFrame:
    """Percentage of each known label among all rows (of a group); unknown ones count in the total only. (E-13)"""
    cols = [(F.count_if(F.col(label) == k) * 100.0 / F.count("*")).alias(f"pct_{k}") for k in known]
    return df.groupBy(*(group or [])).agg(F.count("*").alias("n"), *cols)


def index_stats(tables: dict[str, list[Column]], frames: dict[str, DataFrame]) -> DataFrame:
    """Scalar aggregates over several tables as one row. (E-04, E-05)"""
    return one_row([frames[name].agg(*cols) for name, cols in tables.items()])


def alias_index(aliases: DataFrame, alias: str | None = None) -> DataFrame:
    """(alias, type, id), each once; with one alias, its sorted list of (type, id) as a single row. (E-17)

    The nested form of all aliases would hold a common alias' entities in one row, so it is made on request only.
    """
    if alias is None:
        return aliases.select("alias", F.col("entity_type").alias("type"), F.col("entity_id").alias("id")).distinct()
    aliases = aliases.filter(F.col("alias") == alias)
    return aliases.groupBy("alias").agg(F.sort_array(F.collect_set(F.struct(F.col("entity_type").alias("type"), F.col("entity_id").alias("id")))).alias("entities"))


def entity_export(entities: DataFrame) -> DataFrame:
    """(type, id, record): the records of each type by id. (E-18)"""
    record = F.struct(*[c for c in entities.columns if c not in ("id", "type")])
    return entities.select("type", "id", record.alias("record"))


def write_entity_export(entities: DataFrame, path: str) -> None:
    """The export as JSON lines, one folder a type; a type is written by as many tasks as hold its records. (E-18)"""
    entity_export(entities).write.mode("overwrite").partitionBy("type").json(path)


def passed_share(checks: DataFrame, passed: str = "passed") -> DataFrame:
    """Percentage of checks passed, 0 without checks. (E-19)"""
    return checks.agg(F.coalesce(F.avg(F.col(passed).cast("int")) * 100, F.lit(0.0)).alias("score"))
