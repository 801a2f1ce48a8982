"""Mutations on append-only tables: latest-wins views, insert-if-absent, partition replacement, merges and freezes.

Parquet has no update in place. A table is its log of writes; a view folds the log per key. Folds are aggregations with
a partial step before the shuffle (``max_by`` over the write order), so that a key with most of the rows reaches its task
as one row for each task before. As rows are structs, Spark sorts each task's rows by key for them, before and after the
shuffle; a window would sort all rows of a key in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import merge_maps


def _names(cols: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in cols]


def _order(df: DataFrame, order: list[str], rest: list[str]) -> Column:
    """The write order, ties told apart by a hash of the row, so equal inputs give equal views."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    plain = [F.to_json(F.col(f"`{c}`")) if isinstance(kinds[c], T.MapType) else F.col(f"`{c}`") for c in rest]
    nested = [c for c in rest if isinstance(kinds[c], T.ArrayType | T.StructType) and "map<" in kinds[c].simpleString()]
    plain = [F.to_json(F.col(f"`{c}`")) if c in nested else p for c, p in zip(rest, plain, strict=True)]
    return F.struct(*_names(order), F.xxhash64(*plain) if plain else F.lit(0))


def latest_wins(log: DataFrame, keys: list[str], order: list[str], keep_first: list[str] | None = None) -> DataFrame:
    """The last write of each key as a whole row; columns in ``keep_first`` stay as first written.

    Replacing writes, keyed upserts and assignments (B-01, B-03, B-10, B-15, B-16, B-17, B-32, W-03). Rows that tie in
    ``order`` resolve by a hash of the remaining columns, so the view is deterministic.
    """
    rest = [c for c in log.columns if c not in keys]
    when = _order(log, order, rest)
    aggs = [F.max_by(F.struct(*_names(rest)), when).alias("__last")]
    aggs += [F.min_by(F.col(c), when).alias(f"__first_{c}") for c in keep_first or []]
    got = log.groupBy(*keys).agg(*aggs)
    pick = [F.col(f"__first_{c}").alias(c) if c in (keep_first or []) else F.col(f"__last.`{c}`").alias(c) for c in rest]
    return got.select(*keys, *pick).select(*log.columns)


def first_wins(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first write of each key (insert or ignore; B-03 with the flag, B-08, B-23, D-09)."""
    rest = [c for c in log.columns if c not in keys]
    when = _order(log, order, rest)
    got = log.groupBy(*keys).agg(F.min_by(F.struct(*_names(rest)), when).alias("__first"))
    return got.select(*keys, *[F.col(f"__first.`{c}`").alias(c) for c in rest]).select(*log.columns)


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Existing rows, and the new ones whose key isn't there yet, each key once: its first row by ``order``, ties and no
    order resolved by a hash of the row. (B-23, D-09, U-04, Y-10)"""
    fresh = first_wins(new.join(existing.select(*keys).distinct(), keys, "left_anti"), keys, order or [])
    return existing.unionByName(fresh, allowMissingColumns=True)


def remove_keys(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't listed. (B-08 removal, B-19 dismissal, B-29, Y-19)"""
    return existing.join(gone.select(*keys).distinct(), keys, "left_anti")


def replace_partitions(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Every partition that occurs in ``new`` is replaced by it. (B-02)"""
    return remove_keys(existing, new, [key]).unionByName(new, allowMissingColumns=True)


def monotone(log: DataFrame, keys: list[str], col: str, low: str | None = None) -> DataFrame:
    """Greatest (and, as ``low``, smallest) value of a column per key. (B-25, Y-12, Y-17)"""
    aggs = [F.max(col).alias(col)] + ([F.min(col).alias(low)] if low else [])
    return log.groupBy(*keys).agg(*aggs)


def upsert_entities(existing: DataFrame, updates: DataFrame, metadata: list[str], overwrite_metadata: bool = False) -> DataFrame:
    """Entity upsert (B-05, B-06, Y-11): new ids are inserted; known ones get their ``current`` map merged (new keys
    win) and ``last_appearance`` assigned, which may go back; ``first_appearance`` stays; metadata only on request."""
    e, u = existing.alias("e"), updates.alias("u")
    known = F.col("e.id").isNotNull()
    given = F.col("u.id").isNotNull()
    out = [F.coalesce("e.id", "u.id").alias("id")]
    for c in existing.columns:
        if c == "id":
            continue
        old, new = F.col(f"e.`{c}`"), F.col(f"u.`{c}`")
        if c == "current":
            value = F.when(known & given, merge_maps(old, new)).otherwise(F.coalesce(old, new))
        elif c == "last_appearance":
            value = F.when(given, new).otherwise(old)
        elif c in metadata and overwrite_metadata:
            value = F.when(given, new).otherwise(old)
        else:
            value = F.when(known, old).otherwise(new)
        out.append(value.alias(c))
    return e.join(u, F.col("e.id") == F.col("u.id"), "full_outer").select(*out)


def archive(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """Soft delete. (B-07)"""
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    return entities.join(hit, "id", "left").withColumn("is_archived", F.coalesce("__hit", "is_archived", F.lit(False))).drop("__hit").select(*entities.columns)


def clean_relationship_events(events: DataFrame, negative: list[str], positive: list[str]) -> DataFrame:
    """Validation of edge events (B-11): trimmed ends and type, which are required, as is a chapter above 0; unknown
    actions become update; polarity within -1..1, inferred from the type where it is null; strength and confidence
    within 0..1. Zero strength and confidence are kept: the defaults 0.5 and 1.0 stand for missing values only."""
    from ..functions.scalars import polarity

    def within(c: Column, low: float, high: float) -> Column:
        return F.least(F.greatest(c, F.lit(low)), F.lit(high))

    got = events.withColumns({c: F.trim(c) for c in ("from_entity", "to_entity", "type")})
    got = got.filter((F.col("from_entity") != "") & (F.col("to_entity") != "") & (F.col("type") != "") & (F.col("chapter") > 0))
    return got.withColumns(
        {
            "action": F.when(F.col("action").isin("create", "update", "remove"), F.col("action")).otherwise("update"),
            "polarity": within(F.coalesce("polarity", polarity(F.col("type"), negative, positive)), -1, 1).cast("long"),
            "strength": within(F.coalesce("strength", F.lit(0.5)), 0.0, 1.0),
            "confidence": within(F.coalesce("confidence", F.lit(1.0)), 0.0, 1.0),
        }
    )


def frozen_upserts(log: DataFrame, keys: list[str], order: list[str], status: str, terminal: list[str]) -> DataFrame:
    """Keyed upsert in which the first row with a terminal status is the last that counts (B-12).

    A fold without sorting: the order of the first terminal row per key, then the last write up to it.
    """
    when = F.struct(*_names(order))
    first_end = log.groupBy(*keys).agg(F.min(F.when(F.col(status).isin(terminal), when)).alias("__end"))
    open_rows = log.join(first_end, keys).filter(F.col("__end").isNull() | (when <= F.col("__end"))).drop("__end")
    return latest_wins(open_rows, keys, order)


def resolve_facts(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Confirmed facts change their status, dismissed ones go; the last decision on a fact holds. (B-18, B-19)"""
    last = latest_wins(decisions.filter(F.col("action").isin("confirm", "dismiss")).select("id", "action", "at"), ["id"], ["at"])
    got = facts.join(last, "id", "left").filter(F.coalesce(F.col("action") != "dismiss", F.lit(True)))
    return got.withColumn("status", F.when(F.col("action") == "confirm", F.lit("confirmed")).otherwise(F.col("status"))).select(*facts.columns)


def migrate_columns(old: DataFrame, target, defaults: dict[str, Column]) -> DataFrame:
    """Rows under a new schema: shared columns are copied, the others get their default or null. (B-28)"""
    have = set(old.columns)
    return old.select(*[(F.col(f.name) if f.name in have else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in target.fields])


def split_archive(df: DataFrame, when: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, archived) by a predicate; null keeps. (B-29)"""
    hit = F.coalesce(when, F.lit(False))
    return df.filter(~hit), df.filter(hit)


def add_threads(existing: DataFrame, new: DataFrame, horizon: int = 100) -> DataFrame:
    """New plot threads by content, due ``horizon`` chapters after planting, tier sub where none is given. (B-30)"""
    fresh = new.withColumns({"target_chapter": F.coalesce("target_chapter", F.col("planted_chapter") + horizon), "tier": F.coalesce("tier", F.lit("sub")), "status": F.lit("open")})
    return insert_if_absent(existing, fresh, ["content"])


def ingest(payloads: DataFrame) -> dict[str, DataFrame]:
    """The append sets of chapter payloads (B-04, B-09, B-24, Y-13): chapters, scenes, appearances, entities, aliases,
    state changes and relationship events. Entities named NEW have no appearance; one without mentions is mentioned by
    its name."""
    p = payloads
    seen = p.select("chapter", F.explode("entities_appeared").alias("e")).filter("e.id is not null and e.id <> 'NEW'")
    born = p.select("chapter", F.explode("entities_new").alias("e"))
    cast = F.transform(F.filter("entities_appeared", lambda e: (e["type"] == "character") & (e["id"] != "NEW")), lambda e: e["id"])
    return {
        "chapters": p.select("chapter", "title", "location", "word_count", cast.alias("characters"), "summary"),
        "scenes": p.select("chapter", F.explode("scenes").alias("s")).select("chapter", F.col("s.index").alias("scene_index"), "s.start_line", "s.end_line", "s.location", "s.summary", "s.characters"),
        "appearances": seen.select(F.col("e.id").alias("entity_id"), "chapter", "e.mentions", F.coalesce("e.confidence", F.lit(1.0)).alias("confidence")).unionByName(
            born.select(F.col("e.suggested_id").alias("entity_id"), "chapter", F.array("e.name").alias("mentions"), F.lit(1.0).alias("confidence"))
        ),
        "entities": born.select(F.col("e.suggested_id").alias("id"), "e.type", F.col("e.name").alias("canonical_name"), "e.tier", F.col("chapter").alias("first_appearance"), F.col("chapter").alias("last_appearance")),
        "aliases": born.select(F.col("e.name").alias("alias"), F.col("e.suggested_id").alias("entity_id"), F.col("e.type").alias("entity_type")).distinct(),
        "state_changes": p.select("chapter", F.explode("state_changes").alias("c")).select("c.entity_id", "c.field", F.col("c.old").alias("old_value"), F.col("c.new").alias("new_value"), "c.reason", "chapter"),
        "relationship_events": p.select("chapter", F.explode("relationships_new").alias("r")).select(
            F.col("r.from").alias("from_entity"), F.col("r.to").alias("to_entity"), "r.type", "r.description", F.coalesce("r.chapter", "chapter").alias("chapter")
        ),
    }


def append_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
