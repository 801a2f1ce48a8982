"""Routing of many queries at once: a table of query texts in, intents, scopes and steps out, as Column expressions.

``operators.retrieval`` has the same for one query at a time; the two agree on every text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a run of ideographs that may be a name.
NAME_RUN = "[\\u4e00-\\u9fff]{2,6}"


def intent(query: Column, words: dict[str, list[str]], default: str = "plot") -> Column:
    """The first intent one of whose words the query holds. (R-13)"""
    out = F.lit(default)
    for name, marks in reversed(list(words.items())):
        holds = F.lit(False)
        for w in marks:
            holds = holds | query.contains(w)
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def entity_runs(query: Column, stop: frozenset[str] = frozenset(), most: int = 4) -> Column:
    """Up to four distinct entity candidates in order. (Y-08)"""
    runs = F.regexp_extract_all(query, F.lit(NAME_RUN), F.lit(0))
    if stop:
        runs = F.filter(runs, lambda x: ~x.isin(sorted(stop)))
    return F.slice(F.array_distinct(runs), 1, most)


def time_scope(query: Column, marker: str = "") -> Column:
    """(first, last) chapter: a range, turned round if reversed, or one chapter; null without a number. (R-14)"""
    pair, single = rf"([0-9]+)\s*[-~–到]\s*([0-9]+){marker}", rf"([0-9]+){marker}"
    number = lambda pattern, k: F.regexp_extract(query, pattern, k).try_cast("long")
    a, b, one = number(pair, 1), number(pair, 2), number(single, 1)
    both = F.struct(F.least(a, b).alias("first"), F.greatest(a, b).alias("last"))
    return F.when(query.rlike(pair), both).when(query.rlike(single), F.struct(one.alias("first"), one.alias("last")))


def route(query: Column, words: dict[str, list[str]], needs_graph: tuple[str, ...] = ("relationship",), stop: frozenset[str] = frozenset(), marker: str = "") -> Column:
    """A struct of intent, entities, time_scope and needs_graph. (R-13, Y-08)"""
    kind = intent(query, words)
    return F.struct(kind.alias("intent"), entity_runs(query, stop).alias("entities"), time_scope(query, marker).alias("time_scope"), kind.isin(*needs_graph).alias("needs_graph"))


def steps(routed: Column, strategies: dict[str, str]) -> Column:
    """The steps of a routed query, an array of (name, strategy). (R-15)"""
    step = lambda name, how: F.struct(F.lit(name).alias("name"), (F.lit(how) if isinstance(how, str) else how).alias("strategy"))
    own = F.lit("hybrid")
    for kind, how in strategies.items():
        own = F.when(routed["intent"] == kind, F.lit(how)).otherwise(own)
    graph = F.array(step("relationship_graph", "graph_lookup"), step("relationship_evidence", "graph_hybrid"))
    alone = F.array(step("graph_enhanced_retrieval", "graph_hybrid"))
    return F.when(routed["intent"] == "relationship", graph).when(routed["needs_graph"] & (F.size(routed["entities"]) > 0), alone).otherwise(F.array(step("default_retrieval", own)))


def split_query(query: Column, separators: str = ",;，；、") -> Column:
    """The trimmed parts between any of the separator characters, without empty ones. (R-16)"""
    return F.filter(F.transform(F.split(query, f"[{re.escape(separators)}]"), lambda x: F.btrim(x)), lambda x: x != "")


def stage(chapter: Column, early: int = 30, late: int = 120) -> Column:
    """early, mid or late. (X-07)"""
    return F.when(chapter <= early, "early").when(chapter >= late, "late").otherwise("mid")


def archive_due(size_bytes: Column, chapter: Column, limit: int = 1_000_000, every: int = 10) -> Column:
    """Whether maintenance runs. (K-11)"""
    return (size_bytes >= limit) | ((chapter > 0) & (chapter % every == 0))


def bar(words_per_point: Column) -> Column:
    """A bar of 1 to 12 marks, longer for fewer words per point; empty for null. (Y-32)"""
    marks = F.greatest(F.lit(1), F.least(F.lit(12), (12 - words_per_point / 2000 * 12).cast("int")))
    return F.when(words_per_point.isNull(), "").otherwise(F.repeat(F.lit("#"), marks))


def enabled_for(genre: Column, whitelist: Column) -> Column:
    """Whether a method is on for a genre: listed without regard to case, or all are. (Y-26)"""
    listed = F.transform(whitelist, lambda w: F.lower(F.btrim(w)))
    return F.arrays_overlap(listed, F.array(F.lit("*"), F.lit("all"))) | F.array_contains(listed, F.lower(F.btrim(genre)))


def json_argument(value: Column, path: str, kind: str = "string") -> Column:
    """A field of a JSON argument, null where it is missing or the argument isn't JSON. (Y-40)"""
    return F.try_variant_get(F.try_parse_json(value), path, kind)
