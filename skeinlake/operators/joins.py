"""Joins: what the reference workload looks up one by one, as joins whose strategy Spark picks by size."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship_code
from .storage import materialize


def by_alias(entities: DataFrame, aliases: DataFrame, alias: str | None = None) -> DataFrame:
    """Entities under an alias (all aliases if None), with the alias' type. (D-01, X-15)"""
    if alias is not None:
        aliases = aliases.filter(F.col("alias") == alias)
    return aliases.join(entities, (aliases["entity_id"] == entities["id"]) & (aliases["entity_type"] == entities["type"])).drop("entity_id")


def with_aliases(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entities with the sorted set of their aliases, empty where there is none. (D-04, E-17)"""
    sets = aliases.groupBy(F.col("entity_id").alias("id")).agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    return entities.join(sets, "id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def hydrate(rows: DataFrame, entities: DataFrame, defaults: dict[str, Column], how: str = "left", key: str = "id") -> DataFrame:
    """Every row with the columns of the entity that ``key`` names, defaults where it is unknown; with an inner join, only
    rows of known ones. (D-03, D-05, D-17)"""
    got = rows.join(entities.withColumnRenamed("id", key), key, how)
    return got.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def names_of(rows: DataFrame, key: str, ids_col: str, entities: DataFrame) -> DataFrame:
    """Arrays of ids as arrays of names in the same order; unknown ids stay as they are. (D-06)"""
    flat = rows.select(key, F.posexplode(ids_col).alias("at", "id"))
    named = flat.join(entities.select("id", "canonical_name"), "id", "left")
    lists = named.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("canonical_name", "id").alias("n")))).alias("x"))
    return rows.join(lists, key, "left").withColumn("names", F.coalesce(F.transform("x", lambda x: x["n"]), F.array().cast("array<string>"))).drop("x")


def drop_invalid(items: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Items without a confirmed fact against them; ``pending`` marks those with an open one. (D-07, C-21)

    One pass over the facts: per id, whether any is confirmed and any is pending.
    """
    marks = facts.groupBy(F.col("source_id").alias(key)).agg(F.bool_or(F.col("status") == "confirmed").alias("__bad"), F.bool_or(F.col("status") == "pending").alias("pending"))
    got = items.join(marks, key, "left").filter(~F.coalesce("__bad", F.lit(False))).drop("__bad")
    return got.withColumn("pending", F.coalesce("pending", F.lit(False)))


def settled_contracts(debts: DataFrame) -> DataFrame:
    """Contracts none of whose debts is active or overdue. (D-08)"""
    some = debts.filter(F.col("override_contract_id").isNotNull())
    return some.groupBy("override_contract_id").agg(F.bool_and(~F.col("status").isin("active", "overdue")).alias("done")).filter("done").select("override_contract_id")


def parents_first(children: DataFrame, parents: DataFrame, child_id: str = "chunk_id", parent_of: str = "parent_chunk_id", rank: str = "rank") -> DataFrame:
    """Ranked hits with each known parent put once, before its first child. (D-10, R-12, Y-04)

    ``children`` has id, parent id and rank; the result has id, kind and position.
    """
    first = children.filter(F.col(parent_of).isNotNull()).groupBy(F.col(parent_of).alias(child_id)).agg(F.min(rank).alias("at"))
    known = first.join(parents.select(child_id).distinct(), child_id).join(children.select(child_id), child_id, "left_anti")
    both = known.select(child_id, "at", F.lit(0).alias("k"), F.lit("parent").alias("kind")).unionByName(children.select(child_id, F.col(rank).alias("at"), F.lit(1).alias("k"), F.lit("hit").alias("kind")))
    # Hits are a top-k list, so the single window partition is bounded by k.
    return both.select(child_id, "kind", F.row_number().over(Window.orderBy("at", "k")).alias("position"))


def term_hits(chunks: DataFrame, terms: dict[str, list[str]], text: str = "content") -> Column:
    """Number of distinct terms contained in the text, summed over entities; terms are a given query set. (D-11, D-12)"""
    out = F.lit(0)
    for words in terms.values():
        for w in sorted({w for w in words if w}):
            out = out + F.col(text).contains(w).cast("int")
    return out


def latest_as_of(events: DataFrame, keys: list[str], at: str, order: list[str], now: int | None = None) -> DataFrame:
    """The last event of each key at or before a moment (D-14, W-03): partial aggregation, no sort."""
    if now is not None:
        events = events.filter(F.col(at) <= now)
    rest = [c for c in events.columns if c not in keys]
    got = events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__e"))
    return got.select(*keys, *[f"__e.{c}" for c in rest]).select(*events.columns)


def fill_from_snapshot(latest: DataFrame, snapshot: DataFrame, keys: list[str], at: str = "chapter", now: int | None = None) -> DataFrame:
    """Events win; the snapshot fills keys that have none at all, so removed keys don't come back. (D-13)"""
    if now is not None:
        snapshot = snapshot.filter(F.col(at) <= now)
    absent = snapshot.join(latest.select(*keys).distinct(), keys, "left_anti").withColumn("action", F.lit("snapshot"))
    return latest.unionByName(absent, allowMissingColumns=True).filter("action <> 'remove'")


#: Rows of a lookup table that may be broadcast, and rows of a key from which on its row is broadcast anyway.
SMALL_ROWS, HOT_ROWS = 1_000_000, 1_000_000


def join_lookup(rows: DataFrame, table: DataFrame, keys: list[str], small: int | None = None, hot: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Inner join with a table that has one row for each key, read several times: make it cheap to read.

    A table of few rows is broadcast after a count. Beyond that both sides are shuffled, but for keys with more than
    ``hot`` rows, of which there are fewer than rows / ``hot``: their lines are broadcast, so their rows stay apart.
    ``counts`` are the numbers of rows of each key, as ``count``, where they are at hand.
    """
    small, hot = SMALL_ROWS if small is None else small, HOT_ROWS if hot is None else hot
    if table.count() <= small:
        return rows.join(F.broadcast(table), keys)
    many = (rows.groupBy(*keys).count() if counts is None else counts).filter(F.col("count") > hot).select(*keys)
    many = materialize(many)
    cold = rows.join(F.broadcast(many), keys, "left_anti").join(table, keys)
    return cold.unionByName(rows.join(F.broadcast(table.join(F.broadcast(many), keys, "left_semi")), keys))


def dyadic(first: str, last: str) -> Column:
    """The nodes (level, node) of a binary tree over the whole numbers that make up [first, last]: at most two a level, so
    2 log n rows whatever the width; none for a reversed range or a null end. A node covers 2^level numbers from
    node * 2^level. Ends are taken below 2^62."""
    low, high = f"-shiftright(-cast({first} as bigint), i)", f"shiftright(cast({last} as bigint) + 1, i)"
    node = "named_struct('level', i, 'node', {})"
    left = f"case when {low} < {high} and ({low}) & 1 = 1 then {node.format(low)} end"
    right = f"case when {low} < {high} and ({high}) & 1 = 1 then {node.format(high + ' - 1')} end"
    return F.expr(f"array_compact(flatten(transform(sequence(0, 62), i -> array({left}, {right}))))")


#: Distinct points and ends of ranges in a block of ``containing_range``.
BLOCK_ROWS = 250_000


def _cuts(ends: DataFrame) -> list[float]:
    """Where blocks of about ``BLOCK_ROWS`` rows begin. They only set how even the blocks are; a number with the rows of
    several blocks begins one."""
    blocks = -(-ends.count() // BLOCK_ROWS)
    if blocks < 2:
        return []
    return sorted(set(ends.approxQuantile(ends.columns[0], [k / blocks for k in range(1, blocks)], 0.1 / blocks)))


def _blocks(df: DataFrame, cuts: list[float], cols: dict[str, str]) -> DataFrame:
    """The block number of each column in ``cols``, under a new name; it never falls as the column grows."""
    if not cuts:
        return df.withColumns({name: F.lit(0) for name in cols.values()})
    splits = [-math.inf, *cuts, math.inf]
    got = Bucketizer(splitsArray=[splits] * len(cols), inputCols=list(cols), outputCols=list(cols.values())).transform(df)
    return got.withColumns({name: F.col(name).cast("int") for name in cols.values()})


def _pieces(ranges: DataFrame, cuts: list[float], first: str, last: str, tie: str) -> DataFrame:
    """Ranges cut at blocks, with the number each has in its block's order of worth: (block, lo, hi, range, rank). A null end
    is that of the block.

    A range has a piece in the block it starts in and in the block it ends in. Of those that go over a whole block only
    the best is kept, found over nodes of a binary tree of blocks. So a block has as many pieces as ranges end in it, one more
    at most, and pieces with equal ends are one.
    """
    best = F.min_by("__r", F.struct(-F.col(f"__r.{first}"), F.col(f"__r.{tie}"))).alias("__r")
    lo, hi = F.col(first).cast("long"), F.col(last).cast("long")
    ends = ranges.select(F.struct(*ranges.columns).alias("__r"), lo.alias("__lo"), hi.alias("__hi")).filter("__lo <= __hi")
    ends = _blocks(ends, cuts, {"__lo": "__from", "__hi": "__to"})
    piece = "named_struct('__block', {}, '__lo', {}, '__hi', {})"
    inner, head, tail = piece.format("__from", "__lo", "__hi"), piece.format("__from", "__lo", "cast(null as bigint)"), piece.format("__to", "cast(null as bigint)", "__hi")
    cut = ends.select("__r", F.explode(F.expr(f"if(__from = __to, array({inner}), array({head}, {tail}))")).alias("__n")).select("__n.*", "__r")
    nodes = ends.filter("__to - __from > 1").select("__r", F.explode(dyadic("__from + 1", "__to - 1")).alias("__n"))
    over = nodes.groupBy("__n.level", "__n.node").agg(best)
    blocks = F.expr("explode(transform(sequence(shiftleft(node, level), shiftleft(node + 1, level) - 1), b -> int(b)))")
    whole = over.select(blocks.alias("__block"), F.lit(None).cast("long").alias("__lo"), F.lit(None).cast("long").alias("__hi"), "__r")
    order = Window.partitionBy("__block").orderBy(F.col(f"__r.{first}"), F.desc_nulls_last(f"__r.{tie}"))
    return cut.unionByName(whole).groupBy("__block", "__lo", "__hi").agg(best).withColumn("__rank", F.row_number().over(order))


def _best_of_block(values: pa.Table, pieces: pa.Table) -> pa.Table:
    """(at, range) of a block's points that a piece holds.

    Pieces become pairs of overlapping runs of points, 2^level long; from the longest down, the best rank of a run is handed
    on to its halves.
    """
    pieces = pieces.sort_by("__rank")
    at = np.sort(values["__at"].to_numpy())
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    low = np.searchsorted(at, pieces["__lo"].fill_null(least).to_numpy())
    high = np.searchsorted(at, pieces["__hi"].fill_null(most).to_numpy(), side="right")
    rank = np.flatnonzero(high > low)
    low, high = low[rank], high[rank]
    level = np.log2(high - low).astype(int)
    best = np.full(len(at), -1)
    for k in range(level.max(initial=-1), -1, -1):
        half = best.copy()
        half[1 << k :] = np.maximum(half[1 << k :], best[: -(1 << k)])
        best, mine = half, level == k
        np.maximum.at(best, low[mine], rank[mine])
        np.maximum.at(best, high[mine] - (1 << k), rank[mine])
    held = best >= 0
    return pa.table({"__at": at[held], "__r": pieces["__r"].take(pa.array(best[held]))})


def containing_range(points: DataFrame, ranges: DataFrame, at: str, first: str, last: str, tie: str) -> DataFrame:
    """The range that holds each point: the greatest start, then the smallest tie-breaker (D-15). Points and ends are
    whole numbers.

    Every point row is kept for itself, also if others equal it; a point that no range holds has no row, as the lookup
    finds nothing for it. Points and ranges meet in blocks of bounded size: a distinct point comes to its block once and
    a range to two blocks at most, however wide or many the ranges are. Ranges are read several times: make them cheap to
    read.
    """
    ship_code(points.sparkSession)
    values = materialize(points.select(F.col(at).cast("long").alias("__at")).filter("__at is not null").groupBy("__at").count())
    both = ranges.select(F.explode(F.array(F.col(first).cast("long"), F.col(last).cast("long"))).alias("__at")).filter("__at is not null")
    cuts = _cuts(values.select("__at").unionByName(both))
    pieces = _pieces(ranges, cuts, first, last, tie)
    dealt = _blocks(values.select("__at"), cuts, {"__at": "__block"})
    out = T.StructType([T.StructField("__at", T.LongType()), T.StructField("__r", pieces.schema["__r"].dataType)])
    own = dealt.groupBy("__block").cogroup(pieces.groupBy("__block")).applyInArrow(_best_of_block, out)
    got = join_lookup(points.withColumn("__at", F.col(at).cast("long")), materialize(own), ["__at"], counts=values)
    return got.select(*points.columns, *[f"__r.{c}" for c in ranges.columns])


def expand_frontier(edges: DataFrame, frontier: DataFrame, a: str = "from_entity", b: str = "to_entity") -> DataFrame:
    """Edges with an end in the frontier; each edge once. (D-16)"""
    f = frontier.select(F.col(frontier.columns[0]).alias("__n")).distinct()
    hit = edges.join(f, F.col(a) == F.col("__n"), "left_semi").unionByName(edges.join(f, F.col(b) == F.col("__n"), "left_semi"))
    return hit.distinct()
