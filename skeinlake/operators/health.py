"""Health of a long serial: absence, open threads, balance of strands, pacing, quality risks, archiving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import count_of, has_any, review_end
from .storage import materialize


def absence(col: Column) -> Column:
    """active at 0, normal below 30, mild below 100, else severe. (K-01, Y-31)"""
    return F.when(col <= 0, "active").when(col < 30, "normal").when(col < 100, "mild").otherwise("severe")


def characters(entities: DataFrame, seen: DataFrame, now: int) -> DataFrame:
    """Last appearance by index or corpus, absence and its status per entity. (K-01)"""
    last = seen.groupBy(F.col("entity_id").alias("id")).agg(F.max("chapter").alias("__c"))
    got = entities.join(last, "id", "left").withColumn("last", F.greatest(F.coalesce("last_appearance", F.lit(0)), F.coalesce("__c", F.lit(0))))
    away = F.greatest(F.lit(0), F.lit(now) - F.col("last"))
    return got.select("id", "last", away.alias("absent_for"), absence(away).alias("status"))


#: Weight of a thread's tier.
TIER_WEIGHT = {"core": 3.0, "sub": 2.0, "decor": 1.0}


def threads(items: DataFrame, now: int) -> DataFrame:
    """Open threads with elapsed and remaining chapters, overtime and urgency (K-02, T-12, Y-31). Rows that lack a
    chapter have no urgency; sort with urgency descending, nulls last."""
    rows = items.filter(F.coalesce(F.col("status"), F.lit("open")) != "resolved")
    weight = F.lit(1.0)
    for tier, w in TIER_WEIGHT.items():
        weight = F.when(F.col("tier") == tier, F.lit(w)).otherwise(weight)
    planted, target = F.col("planted_chapter"), F.col("target_chapter")
    elapsed = F.when(planted.isNotNull(), F.greatest(F.lit(0), F.lit(now) - planted))
    left = target - F.lit(now)
    overtime = F.when(left.isNull(), "insufficient").when(left < 0, "expired").when(left < 50, "urgent").when(left < 150, "mild").otherwise("normal")
    urgency = F.when(elapsed.isNotNull() & target.isNotNull(), F.when(target > planted, F.round(elapsed / (target - planted) * weight, 2)).otherwise(F.round(weight * 2, 2)))
    level = F.when(urgency.isNull(), "insufficient").when(urgency >= 2, "critical").when(urgency >= 1, "warning").otherwise("normal")
    return rows.select("*", elapsed.alias("elapsed"), left.alias("remaining"), overtime.alias("overtime"), urgency.alias("urgency"), level.alias("urgency_status"))


def strand_violations(stats: DataFrame, streak: int = 5, gap_second: int = 10, gap_third: int = 15) -> DataFrame:
    """What breaks the balance of three strands; columns streak, gap_second, gap_third and pct_1..pct_3. Bands:
    55-65, 20-30, 10-20 percent. (K-03)"""
    def band(col: str, low: float, high: float) -> Column:
        return F.when((F.col(col) < low) | (F.col(col) > high), F.lit(col))

    return stats.withColumn(
        "violations",
        F.array_compact(
            F.array(
                F.when(F.col("streak") > streak, F.lit("streak")),
                F.when(F.col("gap_second") > gap_second, F.lit("gap_second")),
                F.when(F.col("gap_third") > gap_third, F.lit("gap_third")),
                band("pct_1", 55, 65),
                band("pct_2", 20, 30),
                band("pct_3", 10, 20),
            )
        ),
    )


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``position`` (0-based, over all rows) in a total order without one global window.

    Rows are cut into ranges at sampled boundaries, so dense and sparse stretches of the order make ranges alike; the
    driver keeps one number a range, from which its positions start.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    ranges = materialize(ranges.withColumn("__r", F.monotonically_increasing_id()))
    start, starts = 0, []
    for r in ranges.groupBy("__p").agg(F.count("*").alias("n"), F.min("__r").alias("first")).orderBy("__p").collect():
        starts.append((r["__p"], start - r.first))
        start += r.n
    table = F.broadcast(df.sparkSession.createDataFrame(starts, "__p int, __s long"))
    return ranges.join(table, "__p").withColumn("position", F.col("__r") + F.col("__s")).drop("__p", "__r", "__s")


def pacing(chapters: DataFrame, size: int = 100) -> DataFrame:
    """Per segment of ``size`` chapters by list position: words, points, words per point, coverage, dominant source of
    points and a rating. Columns: position, words, points (null: unknown), source. (K-04, E-14, Y-30)"""
    seg = F.floor(F.col("position") / size).alias("segment")
    got = chapters.groupBy(seg).agg(
        F.count("*").alias("chapters"),
        F.sum("words").alias("words"),
        F.coalesce(F.sum("points"), F.lit(0)).alias("points"),
        F.count_if(F.col("points").isNull()).alias("missing"),
    )
    tally = chapters.filter("points is not null").groupBy(seg, "source").agg(F.count("*").alias("n"), F.min("position").alias("at"))
    main = tally.groupBy("segment").agg(F.max_by("source", F.struct("n", -F.col("at"))).alias("dominant_source"))
    ratio = F.when(F.col("points") > 0, F.col("words") / F.col("points"))
    rating = F.when(ratio.isNull(), "insufficient").when(ratio < 1000, "excellent").when(ratio < 1500, "good").when(ratio < 2000, "fair").otherwise("low")
    return got.join(main, "segment", "left").select("*", ratio.alias("words_per_point"), rating.alias("rating"))


def risk_flags(row: DataFrame) -> DataFrame:
    """Flags of a quality report; columns overall_avg, critical, high, checklist_avg, completion. (K-07)"""
    flags = F.array_compact(
        F.array(
            F.when(F.col("overall_avg") < 75, F.lit("low_overall")),
            F.when(F.col("critical") > 0, F.lit("critical")).when(F.col("high") >= 5, F.lit("many_high")),
            F.when(F.col("checklist_avg") < 80, F.lit("low_checklist")),
            F.when(F.col("completion") < 0.7, F.lit("low_completion")),
        )
    )
    return row.withColumn("flags", F.when(F.size(flags) == 0, F.array(F.lit("stable"))).otherwise(flags))


def opening_checks(text: Column, checks: dict[str, tuple[list[str], int]]) -> dict[str, Column]:
    """Check name -> whether at least so many of its keywords occur. (K-09)"""
    out = {}
    for name, (words, least) in checks.items():
        n = F.lit(0)
        for w in words:
            n = n + text.contains(w).cast("int")
        out[name] = n >= least
    return out


def parse_tags(col: Column, tags: list[str]) -> Column:
    """The text of each tag in an answer as a struct; null where it is missing. (K-10)"""
    def one(t: str) -> Column:
        got = F.regexp_extract(col, rf"(?s)<{t}>\s*(.*?)\s*</{t}>", 1)
        return F.when(got != "", got).alias(t)

    return F.struct(*[one(t) for t in tags])


def archive_due(size_bytes: int, chapter: int, limit: int = 1_000_000, every: int = 10) -> bool:
    """Whether maintenance runs. (K-11)"""
    return size_bytes >= limit or (chapter > 0 and chapter % every == 0)


def inactive(entities: DataFrame, now: int, after: int = 50) -> DataFrame:
    """Entities beyond the core that were seen once but not for ``after`` chapters. (K-12)"""
    return entities.filter((F.col("tier") != "core") & (F.col("last_appearance") > 0) & (F.lit(now) - F.col("last_appearance") >= after))


def resolved_threads(items: DataFrame, now: int, after: int = 20) -> DataFrame:
    """Threads resolved at least ``after`` chapters ago. (K-13)"""
    return items.filter((F.col("status") == "resolved") & (F.lit(now) - F.coalesce(F.col("resolved_chapter"), F.lit(0)) >= after))


def old_reviews(reviews: DataFrame, now: int, after: int = 50, col: str = "chapters") -> DataFrame:
    """Reviews whose last chapter is ``after`` chapters ago; unreadable ones count as old. (K-14, F-27)"""
    got = reviews.withColumn("end_chapter", review_end(F.col(col)))
    return got.filter(F.lit(now) - F.col("end_chapter") >= after)


def missing_steps(required: Column, done: Column) -> Column:
    """Steps that must precede and aren't done. (K-15)"""
    return F.array_except(required, done)


def monotony(df: DataFrame, label: str, limit: float = 0.8) -> DataFrame:
    """Share of the most frequent label, and whether it passes the limit."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg((F.max("n") / F.sum("n")).alias("top_share")).withColumn("monotone", F.col("top_share") > limit)


def points_by_keywords(text: Column, words: list[str]) -> Column:
    """Occurrences of any of the keywords; null where there is none."""
    n = F.lit(0)
    for w in words:
        n = n + count_of(text, w)
    return F.when(has_any(text, words), n)
