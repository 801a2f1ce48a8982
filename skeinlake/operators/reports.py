"""Compositions: contract and debt writes, strand history, quality and status reports, packs, maintenance runs, guidance.

Reports are structured frames; rendering to text is a thin step over at most a few hundred rows on the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import aggregates as A
from . import context as X
from . import health as K
from .lookup import top
from .upsert import split_archive
from .windows import run_since_switch, window_slice


def fulfill(contracts: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Listed contracts become fulfilled with a time, whatever they were. (B-13)"""
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    got = contracts.join(hit, "id", "left")
    return got.withColumns({"status": F.when(F.col("__hit"), "fulfilled").otherwise(F.col("status")), "fulfilled_at": F.when(F.col("__hit"), at).otherwise(F.col("fulfilled_at"))}).select(*contracts.columns)


def create_debts(new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(debts, created events): balances start at the original amount; contract 0 is none. (B-14, L-03)"""
    debts = new.withColumns({"current_amount": F.col("original_amount"), "status": F.lit("active"), "override_contract_id": F.when(F.col("override_contract_id") != 0, F.col("override_contract_id"))})
    return debts, debts.select(F.col("id").alias("debt_id"), F.lit("created").alias("event_type"), F.col("original_amount").alias("amount"), F.col("source_chapter").alias("chapter"))


def strand_tracker(history: DataFrame, key: str, at: str = "chapter", label: str = "dominant", keep: int = 50, block: int = 10_000) -> DataFrame:
    """The last ``keep`` entries of each history with the run length since the last switch. (B-31, W-07, W-08)

    Histories are worked off in blocks of ``block`` chapters: each block keeps its last entries, then the key does.
    """
    from .windows import retain_last

    b = F.floor(F.col(at) / block)
    runs = run_since_switch(history, key, [at], label, b).withColumn("__b", b)
    last = Window.partitionBy(key, "__b").orderBy(F.desc(at))
    runs = runs.withColumn("__r", F.row_number().over(last)).filter(F.col("__r") <= keep).drop("__r", "__b")
    return retain_last(runs, keep, key, [at])


def meta_entry(entries: Column, chapter: int) -> Column:
    """The record of a chapter in a map keyed 0001, 1, or any string of that number. (F-13)"""
    same = F.map_values(F.map_filter(entries, lambda k, _: k.try_cast("long") == chapter))
    return F.coalesce(F.try_element_at(entries, F.lit(f"{chapter:04d}")), F.try_element_at(entries, F.lit(str(chapter))), F.get(same, F.lit(0)))


def basic_stats(chapters: DataFrame, target_words: int) -> DataFrame:
    """Chapters, words, words per chapter and completion in percent. (K-05)"""
    got = chapters.agg(F.count("*").alias("chapters"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"))
    return got.select("*", F.when(F.col("chapters") > 0, F.round(F.col("words") / F.col("chapters"), 2)).otherwise(0.0).alias("words_per_chapter"), F.round(F.col("words") * 100.0 / max(1, target_words), 2).alias("completion"))


def quality_report(reviews: DataFrame, checklists: DataFrame, n: int) -> dict[str, DataFrame]:
    """Trends of the last ``n`` reviews and checklists, their rows in ascending order, and risk flags. (K-08, K-07)"""
    review, check = A.review_trend(reviews, n), A.checklist_trend(checklists, n)
    sev = A.severity_trend(reviews, n).agg(*[F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("total"))), F.lit(0)).alias(s) for s in ("critical", "high")])
    row = A.one_row([review.select("overall_avg"), check.select(F.col("score_avg").alias("checklist_avg"), F.col("completion_avg").alias("completion")), sev])
    return {
        "reviews": top(reviews, n, "end_chapter desc", "start_chapter desc").orderBy("end_chapter", "start_chapter"),
        "checklists": top(checklists, n, "chapter desc").orderBy("chapter"),
        "review_trend": review,
        "checklist_trend": check,
        "dimensions": A.dimension_trend(reviews, n),
        "risks": K.risk_flags(row),
    }


def step_timing(log: DataFrame, n: int = 3, alarm_ms: int = 30_000) -> DataFrame:
    """The ``n`` slowest steps (columns step, ms) with their share of all time, and whether the total passes the alarm.
    (§2.15)"""
    per = log.groupBy("step").agg(F.sum("ms").alias("ms"))
    total = per.agg(F.coalesce(F.sum("ms"), F.lit(0)).alias("total_ms"))
    worst = top(per, n, "ms desc", "step")
    return A.one_row([total, total.select((F.col("total_ms") > alarm_ms).alias("alarm"))]).join(worst, F.lit(True)).select("step", "ms", F.round(F.col("ms") / F.greatest("total_ms", F.lit(1)), 4).alias("ratio"), "total_ms", "alarm")


def checker_rollup(records: DataFrame) -> DataFrame:
    """Checker records (checker, score, critical, high, passed) as one row: mean score to 2 places, totals of the severe
    findings, whether all passed. (§2.15)"""
    return records.agg(
        F.count("*").alias("checkers"),
        F.coalesce(F.round(F.avg("score"), 2), F.lit(0.0)).alias("overall_score"),
        F.coalesce(F.sum("critical"), F.lit(0)).alias("critical"),
        F.coalesce(F.sum("high"), F.lit(0)).alias("high"),
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"),
    )


def status_report(parts: dict[str, DataFrame], focus: str = "all") -> dict[str, DataFrame]:
    """The sections a report of that focus has; an unknown focus has all. (K-06)"""
    return {focus: parts[focus]} if focus in parts else dict(parts)


def bar(words_per_point: float | None) -> str:
    """A bar of 1 to 12 marks, longer for fewer words per point. (Y-32)"""
    return "" if words_per_point is None else "#" * max(1, min(12, int(12 - words_per_point / 2000 * 12)))


def render(parts: dict[str, DataFrame], rows: int = 10) -> str:
    """Markdown of the first rows of each section. (B-36, Y-32)"""
    out = []
    for name, frame in parts.items():
        out += [f"## {name}", "", "| " + " | ".join(frame.columns) + " |", "|" + " --- |" * len(frame.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in frame.limit(rows).collect()] + [""]
    return "\n".join(out)


def rank_pack(pack: dict[str, DataFrame], now: int, hints: list[str]) -> dict[str, DataFrame]:
    """Each section of a context pack in its own ranking; sections without one stay. (X-01)"""
    how = {
        "summaries": lambda d: X.rank_summaries(d, now, hints),
        "meta": lambda d: X.rank_meta(d, now),
        "appearances": lambda d: X.rank_appearances(d, now),
        "skeleton": lambda d: X.rank_summaries(d, now, []),
        "alerts": lambda d: X.rank_alerts(d, now, hints),
    }
    return {k: how[k](d) if k in how else d for k, d in pack.items()}


def reader_signal(reading: DataFrame, reviews: DataFrame, n: int = 5, low: float = 75.0) -> dict[str, DataFrame]:
    """Recent records, uses of patterns and hooks, review trend and the ranges that scored low. (X-09)"""
    return {
        "recent": top(reading, n, "chapter desc"),
        "patterns": A.pattern_usage(reading, n),
        "hooks": A.hook_usage(reading, n),
        "reviews": A.review_trend(reviews, n),
        "low": top(reviews, n, "end_chapter desc", "start_chapter desc").filter(F.col("overall_score") < low).select("start_chapter", "end_chapter", "overall_score"),
    }


def copy_fields(target: DataFrame, source: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """Fields of one store copied to another where they are set: {target column: source column}. (X-17)"""
    src = source.select(key, *[F.col(s).alias(f"__{t}") for t, s in fields.items()])
    got = target.join(src, key, "left").withColumns({t: F.coalesce(f"__{t}", t) for t in fields})
    return got.select(*target.columns)


def auto_archive(size_bytes: int, now: int, entities: DataFrame, items: DataFrame, reviews: DataFrame, force: bool = False) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(kept, archived) of each list if maintenance is due, else nothing. (Y-20, K-11 to K-14, B-29)

    Archived entities are those not archived before, so they don't qualify again.
    """
    if not (force or K.archive_due(size_bytes, now)):
        return {}
    tier, last = F.col("tier"), F.col("last_appearance")
    idle = ~F.coalesce("is_archived", F.lit(False)) & (tier != "core") & (last > 0) & (F.lit(now) - last >= 50)
    done = (F.col("status") == "resolved") & (F.lit(now) - F.coalesce("resolved_chapter", F.lit(0)) >= 20)
    from ..functions.scalars import review_end

    return {"entities": split_archive(entities, idle), "threads": split_archive(items, done), "reviews": split_archive(reviews, F.lit(now) - review_end(F.col("chapters")) >= 50)}


def genre_profile(genres: DataFrame, files: DataFrame, aliases: dict[str, str], tokens: int = 2, refs: int = 8) -> DataFrame:
    """Per genre string: its tokens, and the section and references of each token's profile file. (Y-22, F-21..F-24)

    ``genres`` has genre; ``files`` has name and text.
    """
    from ..functions.scalars import bullets, split_tokens, translate_token

    flat = genres.select("genre", F.posexplode(split_tokens(F.col("genre"), limit=tokens)).alias("at", "token")).withColumn("token", translate_token(F.col("token"), aliases))
    return flat.join(files, flat["token"] == files["name"], "left").select("genre", "at", "token", F.left("text", F.lit(1500)).alias("excerpt"), bullets(F.coalesce("text", F.lit("")), refs).alias("refs"))


def guidance(rules: DataFrame, flags: Column, least: int = 3, most: int = 6) -> DataFrame:
    """Rules whose condition is among the flags, at most ``most`` by priority. (Y-23, Y-27, X-12)"""
    hit = rules.filter(F.col("when").isNull() | F.array_contains(flags, F.col("when")))
    return X.pick_rules(hit, least, most)


def recent_meta(entries: DataFrame, now: int, width: int = 3) -> DataFrame:
    """Records of the chapters before this one, keyed by text of either form. (Y-24, W-05)

    ``entries`` has key and the record's columns.
    """
    return window_slice(entries.withColumn("chapter", F.col("key").try_cast("long")).filter("chapter is not null"), now, width).orderBy("chapter")


def enabled_for(genre: str, whitelist: list[str]) -> bool:
    """Whether a method is on for a genre: listed without regard to case, or all are. (Y-26)"""
    listed = {w.strip().lower() for w in whitelist}
    return bool(listed & {"*", "all"}) or genre.strip().lower() in listed


def file_title(name: Column, heading: Column) -> Column:
    """The heading without its chapter mark, else what follows the number in the file name. (Y-29)"""
    own = F.trim(F.regexp_replace(F.coalesce(heading, F.lit("")), r"^#+\s*(第?\s*\d+\s*[章话回]?|[Cc]hapter\s+\d+)\s*[:：.\-]?\s*", ""))
    rest = F.trim(F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), r"^\D*\d+\D?\s*[-_ ]*", ""))
    return F.when(own != "", own).when(rest != "", rest)


def safe_name(title: str, most: int = 60) -> str:
    """A title as part of a file name. (Y-29)"""
    return re.sub(r'[\\/:*?"<>|\s]+', "_", title).strip("_.")[:most]


def opening_texts(chapters: DataFrame, n: int = 3, most: int = 6000) -> DataFrame:
    """The first chapters, their length without white space, and their text cut for a prompt. (Y-37)"""
    return top(chapters, n, "chapter").select("chapter", F.char_length(F.regexp_replace("text", r"\s+", "")).alias("chars"), F.left("text", F.lit(most)).alias("prompt_text"))


def json_argument(value: str) -> object:
    """A JSON argument, read from a file if it starts with @. (Y-40)"""
    import json

    if value.startswith("@"):
        with open(value[1:], encoding="utf-8") as f:
            return json.load(f)
    return json.loads(value)
