"""Context assembly: ranking of summaries, appearances and alerts, budgets, checklist scores, strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import compact, confidence_band, frequency, has_any, length_score, recency
from .lookup import per_group_top

#: Share of recency, share of the second measure, bonus.
W_RECENCY, W_SECOND, W_BONUS = 0.7, 0.3, 0.2


def combine(parts: dict[str, tuple[Column, float]], debug: bool = False) -> list[Column]:
    """The weighted sum as ``score``; with ``debug`` each part to 6 places as well. (Y-39)"""
    total = F.lit(0.0)
    for value, weight in parts.values():
        total = total + value * F.lit(float(weight))
    out = [total.alias("score")]
    return out + [F.round(v, 6).alias(f"score_{k}") for k, (v, _) in parts.items()] if debug else out


def rank_summaries(df: DataFrame, now: int, hints: list[str], text: str = "summary", at: str = "chapter", debug: bool = False) -> DataFrame:
    """Summaries by recency, length and whether they hint at a hook. (X-02, X-05 without hints)"""
    bonus = F.when(has_any(F.col(text), hints), 1.0).otherwise(0.0)
    parts = {"recency": (recency(F.col(at), F.lit(now)), W_RECENCY), "length": (length_score(F.col(text)), W_SECOND), "hook": (bonus, W_BONUS)}
    return df.select("*", *combine(parts, debug)).orderBy(F.desc("score"), F.desc(at))


def rank_meta(df: DataFrame, now: int, hook: str = "hook", at: str = "chapter") -> DataFrame:
    """Chapter records by recency, length of their hook, and whether there is one. (X-03)"""
    some = F.coalesce(F.length(F.trim(F.col(hook))), F.lit(0)) > 0
    parts = {"recency": (recency(F.col(at), F.lit(now)), W_RECENCY), "length": (length_score(F.col(hook)), W_SECOND), "hook": (F.when(some, 1.0).otherwise(0.0), W_BONUS)}
    return df.select("*", *combine(parts)).orderBy(F.desc("score"), F.desc(at))


def rank_appearances(df: DataFrame, now: int, last: str = "last_chapter", total: str = "total", flagged: Column | None = None) -> DataFrame:
    """Entities by recency and frequency, less for flagged ones. (X-04)"""
    penalty = F.when(flagged if flagged is not None else F.lit(False), 1.0).otherwise(0.0)
    parts = {"recency": (recency(F.col(last), F.lit(now)), W_RECENCY), "frequency": (frequency(F.col(total)), W_SECOND), "flag": (penalty, -0.15)}
    return df.select("*", *combine(parts)).orderBy(F.desc("score"), F.desc(last))


def rank_alerts(df: DataFrame, now: int, words: list[str], text: str = "message", at: str = "chapter", severity: str = "severity") -> DataFrame:
    """Alerts by recency, severity and keywords. (X-06)"""
    bad = F.when(F.lower(severity).isin("critical", "high"), 0.3).otherwise(0.0)
    word = F.when(has_any(F.coalesce(F.col(text), F.lit("")), words), 0.3).otherwise(0.0)
    return df.withColumn("score", recency(F.col(at), F.lit(now)) + bad + word).orderBy(F.desc("score"), F.desc(at))


def stage(chapter: int, early: int = 30, late: int = 120) -> str:
    """early, mid or late. (X-07)"""
    return "early" if chapter <= early else "late" if chapter >= late else "mid"


def budgets(sections: DataFrame, weights: dict[str, float], most: int, extras: list[str], extra_budget: int = 800, text: str = "content", name: str = "section") -> DataFrame:
    """Sections cut to their share of ``most`` characters; extras to a fixed budget; others whole. (X-08, F-20)"""
    budget, out = F.lit(None).cast("int"), F.col(text)
    for s, w in weights.items():
        n = int(most * w)
        budget = F.when(F.col(name) == s, n).otherwise(budget)
        out = F.when(F.col(name) == s, compact(F.col(text), n)).otherwise(out)
    if extras:
        budget = F.when(F.col(name).isin(extras), extra_budget).otherwise(budget)
        out = F.when(F.col(name).isin(extras), compact(F.col(text), extra_budget)).otherwise(out)
    return sections.select("*", budget.alias("budget"), out.alias("text"))


def checklist_score(items: DataFrame, group: str = "chapter", trend: float | None = None) -> DataFrame:
    """Score of a checklist per group: half weighted, three tenths required, two tenths counted completion, in percent,
    moved by a tenth of its distance from the trend (at most 10), within 0..100. Columns: required, weight, done.
    (X-10)"""
    done, req = F.col("done"), F.col("required")
    agg = items.groupBy(group).agg(
        F.count("*").alias("total_items"),
        F.count_if(req).alias("required_items"),
        F.count_if(done).alias("completed_items"),
        F.count_if(done & req).alias("completed_required"),
        F.sum("weight").alias("total_weight"),
        F.coalesce(F.sum(F.when(done, F.col("weight"))), F.lit(0.0)).alias("completed_weight"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(1.0))
    raw = 100.0 * (0.5 * share("completed_weight", "total_weight") + 0.3 * share("completed_required", "required_items") + 0.2 * share("completed_items", "total_items"))
    if trend is not None:
        raw = raw + F.greatest(F.lit(-10.0), F.least(F.lit(10.0), (raw - trend) * 0.1))
    return agg.withColumns({"completion_rate": F.round(share("completed_items", "total_items"), 4), "score": F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 2)})


def dominant(df: DataFrame, label: str, at: str = "chapter") -> DataFrame:
    """The most frequent label, the one seen first on ties. (X-11)"""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"), F.min(at).alias("at"))
    return counts.agg(F.max_by(label, F.struct("n", -F.col("at"))).alias(label), F.max("n").alias("n"))


def pick_rules(rules: DataFrame, least: int, most: int, group: str | None = None, rank: str = "priority", rule: str = "id") -> DataFrame:
    """At most ``most`` distinct rules by priority; groups with fewer than ``least`` have ``enough`` false. (X-12)

    Rules are counted by an aggregation and the first few of each task come together, not all rules of a group.
    """
    from pyspark.sql import Window

    key = group or "__all"
    rows = rules if group else rules.withColumn(key, F.lit(0))
    once = rows.groupBy(key, rule).agg(F.min(rank).alias(rank))
    counts = once.groupBy(F.col(key).alias("__key")).agg((F.count("*") >= least).alias("enough"))
    best = per_group_top(once, key, most, rank, rule).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(rank, rule)))
    got = best.join(counts, F.col(key).eqNullSafe(F.col("__key")))
    return got.select(*([group] if group else []), rule, rank, "place", "enough")


def style_candidates(scenes: DataFrame, least_score: float = 80, least_chars: int = 200, most_chars: int = 2000, score: str = "score", text: str = "content") -> DataFrame:
    """Scenes long enough of chapters good enough, cut to a length, their score as a share. (X-13)"""
    good = scenes.filter((F.col(score) >= least_score) & (F.char_length(text) >= least_chars))
    return good.withColumns({text: F.left(text, F.lit(most_chars)), score: F.col(score) / 100})


def route_uncertain(mentions: DataFrame, high: float = 0.8, mid: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(warnings, pending): adopted with a remark at ``mid`` or more, left to a person below. (X-14)"""
    got = mentions.withColumn("band", confidence_band(F.col("confidence"), high, mid))
    return got.filter(F.col("band") != "manual"), got.filter(F.coalesce(F.col("band"), F.lit("manual")) == "manual")


def urgent(threads: DataFrame, above: float, n: int) -> DataFrame:
    """The most urgent open threads. (X-16)"""
    return threads.filter(F.col("urgency") > above).orderBy(F.desc("urgency"), "content").limit(n)
