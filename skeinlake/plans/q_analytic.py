"""Queries: joins, aggregates, runs and windows, set-like operators (families D, E, W, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import lookup as L
from ..operators import names as N
from ..operators import upsert as B
from ..operators import windows as W
from ..operators.storage import materialize
from .bindings import Bound, day, sql
from .q_lookup import simple
from .registry import query



def _days(b, kind):
    """Each user's days with an event of a kind."""
    return b.t.events.filter(F.col("event_type") == kind).select("user_id", day().cast("long").alias("d")).distinct()


# joins
simple("entities_by_alias_D01", lambda b: J.by_alias(b.entities.select("id", "type", "tier"), b.aliases, "NATION_3"), "select alias, entity_type, id, type, tier from aliases join entities on id = entity_id and type = entity_type where alias = 'NATION_3'")
simple("entities_by_any_alias_D01", lambda b: J.by_alias(b.entities.select("id", "type", "tier"), b.aliases), "select alias, entity_type, id, type, tier from aliases join entities on id = entity_id and type = entity_type")
simple(
    "scored_with_vectors_D03",
    lambda b: J.hydrate(b.t.documents.filter("lang = 'en' and n_chars > 500").select(F.col("doc_id").alias("id"), "lang", "n_chars"), b.t.embeddings.select(F.col("vec_id").alias("id"), "label"), {}, "inner").withColumnRenamed("id", "doc_id"),
    "select d.doc_id, d.lang, d.n_chars, e.label from documents d join embeddings e on e.vec_id = d.doc_id where d.lang = 'en' and d.n_chars > 500",
)
simple(
    "entities_with_aliases_D04",
    lambda b: J.with_aliases(b.entities.select("id", "tier"), b.aliases).select("id", "tier", F.array_join("aliases", ",").alias("aliases")),
    "select id, tier, coalesce((select string_agg(distinct alias, ',' order by alias) from aliases where entity_id = id), '') as aliases from entities",
)
simple(
    "node_details_D05",
    lambda b: J.hydrate(b.t.events.select(F.col("user_id").alias("id")).distinct(), b.entities.select("id", "tier", "last_appearance"), {"tier": F.lit("unknown"), "last_appearance": F.lit(0)}),
    "select u.id, coalesce(e.tier, 'unknown') as tier, coalesce(e.last_appearance, 0) as last_appearance from (select distinct user_id as id from events) u left join entities e on e.id = u.id",
)


@query("chapter_names_D06", sql("select x.chapter, string_agg(coalesce(e.canonical_name, cast(x.entity_id as varchar)), '|' order by x.entity_id) as names from appearances x left join entities e on e.id = x.entity_id group by x.chapter"))
def chapter_names(spark, folder):
    b = Bound(spark, folder)
    lists = b.appearances.groupBy("chapter").agg(F.transform(F.sort_array(F.collect_list("entity_id")), lambda x: x.cast("string")).alias("ids"))
    names = b.entities.select(F.col("id").cast("string").alias("id"), "canonical_name")
    return J.names_of(lists, "chapter", "ids", names).select("chapter", F.array_join("names", "|").alias("names"))


simple(
    "drop_invalid_D07",
    lambda b: J.drop_invalid(b.t.documents.select("doc_id", "lang"), b.invalid_facts, "doc_id"),
    "select d.doc_id, d.lang, exists (select 1 from invalid_facts f where f.source_id = d.doc_id and f.status = 'pending') as pending from documents d where not exists (select 1 from invalid_facts f where f.source_id = d.doc_id and f.status = 'confirmed')",
)
simple(
    "settled_contracts_D08",
    lambda b: J.settled_contracts(b.debts),
    "select distinct override_contract_id from debts d where not exists (select 1 from debts o where o.override_contract_id = d.override_contract_id and o.status in ('active', 'overdue'))",
)


@query("parents_first_D10", sql("""
with hits as (select chapter, scene_index, chapter * 1000 + scene_index as id, row_number() over (order by length(summary) desc, chapter, scene_index) as r from scenes where location = 'assistant' qualify r <= 10),
p as (select chapter * 1000 as id, min(r) as pos_at from hits group by chapter having min(scene_index) > 0)
select id, kind, row_number() over (order by pos_at, k) as position from (select id, pos_at, 0 as k, 'parent' as kind from p union all select id, r as pos_at, 1 as k, 'hit' as kind from hits)"""))
def parents_first(spark, folder):
    scenes = Bound(spark, folder).scenes
    long = scenes.filter("location = 'assistant'").orderBy(F.desc(F.length("summary")), "chapter", "scene_index").limit(10)
    ranked = W.ranks(long.select((F.col("chapter") * 1000 + F.col("scene_index")).alias("chunk_id"), (F.col("chapter") * 1000).alias("parent_chunk_id"), F.length("summary").alias("score")), "score", "chunk_id")
    parents = scenes.filter("scene_index = 0").select((F.col("chapter") * 1000).alias("chunk_id"))
    return J.parents_first(ranked, parents).withColumnRenamed("chunk_id", "id").withColumn("position", F.col("position").cast("long"))


_TERMS = {"a": ["idiot", "clown"], "b": ["the", "and"], "c": ["que", "and"]}
simple(
    "term_candidates_D11",
    lambda b: L.top(b.chapters.select("chapter", J.term_hits(None, _TERMS, "summary").cast("long").alias("hits")).filter("hits > 0"), 200, "hits desc", "chapter desc"),
    "select chapter, hits from (select chapter, "
    + " + ".join(f"cast(contains(summary, '{w}') as bigint)" for ws in _TERMS.values() for w in ws)
    + " as hits from chapters) where hits > 0 order by hits desc, chapter desc limit 200",
)
simple(
    "names_in_text_D12",
    lambda b: N.names_in_texts(b.chapters, b.t.documents.sparkSession.createDataFrame([(w,) for w in ("moron", "loser", "scum", "tion ")], "name string"), "chapter", "summary").select("chapter", "name"),
    "select chapter, name from chapters, (values ('moron'), ('loser'), ('scum'), ('tion ')) n(name) where contains(summary, name)",
)
_EDGE = ["from_entity", "to_entity", "type"]
simple(
    "edges_as_of_D14",
    lambda b: J.latest_as_of(b.relationship_events, _EDGE, "chapter", ["chapter", "id"], 15).drop("strength"),
    "select id, from_entity, to_entity, type, action, chapter from relationship_events where chapter <= 15 qualify row_number() over (partition by from_entity, to_entity, type order by chapter desc, id desc) = 1",
)
simple(
    "edges_filled_D13",
    lambda b: J.fill_from_snapshot(J.latest_as_of(b.relationship_events, _EDGE, "chapter", ["chapter", "id"], 10).select(*_EDGE, "chapter", "action"), b.links, _EDGE),
    "with l as (select from_entity, to_entity, type, chapter, action from relationship_events where chapter <= 10 qualify row_number() over (partition by from_entity, to_entity, type order by chapter desc, id desc) = 1) select * from l where action <> 'remove' union all select from_entity, to_entity, type, chapter, 'snapshot' as action from links s where not exists (select 1 from l where l.from_entity = s.from_entity and l.to_entity = s.to_entity)",
)


@query("volume_of_chapter_D15", sql("""
with v as (select o_custkey as volume, min(m) as first, max(m) as last from (select o_custkey, year(o_orderdate) * 12 + month(o_orderdate) as m from orders) group by 1),
p as (select distinct year(l_shipdate) * 12 + month(l_shipdate) as chapter from lineitem)
select chapter, volume, first, last from p join v on chapter between first and last qualify row_number() over (partition by chapter order by first desc, volume) = 1"""))
def volume_of_chapter(spark, folder):
    b = Bound(spark, folder)
    volumes = b.activity.select(F.col("id").alias("volume"), F.col("first_appearance").alias("first"), F.col("last_appearance").alias("last"))
    points = b.debt_events.select("chapter").distinct()
    return J.containing_range(points, materialize(volumes), "chapter", "first", "last", "volume")


simple(
    "graph_hop_D16",
    lambda b: J.expand_frontier(b.links, b.t.events.filter("event_type = 'purchase' and value > 99").select("user_id")),
    "select * from links where from_entity in (select user_id from events where event_type = 'purchase' and value > 99) or to_entity in (select user_id from events where event_type = 'purchase' and value > 99)",
)
simple(
    "relationships_with_names_D17",
    lambda b: J.hydrate(J.hydrate(b.links, b.entities.select("id", F.col("canonical_name").alias("from_name")), {}, key="from_entity"), b.entities.select("id", F.col("canonical_name").alias("to_name")), {}, key="to_entity"),
    "select l.*, a.canonical_name as from_name, c.canonical_name as to_name from links l left join entities a on a.id = from_entity left join entities c on c.id = to_entity",
)

# aggregates
simple("recent_appearances_E01", lambda b: A.recent_by_entity(b.appearances, 20), "select entity_id, max(chapter) as last_chapter, count(*) as total from appearances group by entity_id order by last_chapter desc, entity_id limit 20")
simple("debt_balance_E02", lambda b: A.balance(b.debts).select(F.round("balance", 2).alias("balance")), "select round(coalesce(sum(current_amount), 0.0), 2) as balance from debts where status in ('active', 'overdue')")
simple(
    "debt_summary_E03",
    lambda b: A.debt_summary(b.debts, b.contracts).select("active_debts", "overdue_debts", "pending_contracts", *[F.round(c, 2).alias(c) for c in ("active_total", "overdue_total", "total")]),
    "select count(*) filter (status = 'active') as active_debts, count(*) filter (status = 'overdue') as overdue_debts, (select count(*) filter (status = 'pending') from contracts) as pending_contracts, round(sum(current_amount) filter (status = 'active'), 2) as active_total, round(sum(current_amount) filter (status = 'overdue'), 2) as overdue_total, round(sum(current_amount) filter (status in ('active', 'overdue')), 2) as total from debts",
)


def _stats(b):
    n = F.count("*")
    return A.index_stats(
        {"chapters": [n.alias("chapters"), F.max("chapter").alias("max_chapter"), F.sum("word_count").alias("words")], "scenes": [n.alias("scenes")], "entities": [n.alias("entities"), F.count_if("is_archived").alias("archived"), F.count_distinct("type").alias("types")],
         "aliases": [n.alias("aliases")], "relationships": [n.alias("relationships")], "state_changes": [n.alias("state_changes")], "debts": [F.count_if(F.col("status") == "active").alias("active_debts")], "tool_calls": [n.alias("tool_calls"), F.count_if(~F.col("success")).alias("failed_calls")]},
        {t: getattr(b, t) for t in ("chapters", "scenes", "entities", "aliases", "relationships", "state_changes", "debts", "tool_calls")},
    )


simple(
    "index_stats_E04",
    _stats,
    "select (select count(*) from chapters) as chapters, (select max(chapter) from chapters) as max_chapter, (select cast(sum(word_count) as bigint) from chapters) as words, (select count(*) from scenes) as scenes, (select count(*) from entities) as entities, (select count(*) filter (is_archived) from entities) as archived, (select count(distinct type) from entities) as types, (select count(*) from aliases) as aliases, (select count(*) from relationships) as relationships, (select count(*) from state_changes) as state_changes, (select count(*) filter (status = 'active') from debts) as active_debts, (select count(*) from tool_calls) as tool_calls, (select count(*) filter (not success) from tool_calls) as failed_calls",
)
simple(
    "vector_stats_E05",
    lambda b: A.index_stats({"v": [F.count("*").alias("vectors"), F.max("vec_id").alias("max_id")], "t": [F.count_distinct("term").alias("terms")]}, {"v": b.t.embeddings, "t": b.t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term"))}),
    "select (select count(*) from embeddings) as vectors, (select max(vec_id) from embeddings) as max_id, (select count(distinct t) from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as t from documents)) as terms",
)
simple("style_stats_E06", lambda b: A.count_per(b.samples, "scene_type", more={"avg_score": F.round(F.avg("score"), 3)}), "select scene_type, count(*) as n, round(avg(score), 3) as avg_score from samples group by scene_type")
simple("pattern_usage_E07", lambda b: A.pattern_usage(b.reading_power, 50), "select pattern, count(*) as uses from (select unnest(coolpoint_patterns) as pattern from (select * from reading_power order by chapter desc limit 50)) group by pattern")
simple("hook_usage_E08", lambda b: A.hook_usage(b.reading_power, 50), "select hook_type, count(*) as uses from (select * from reading_power where hook_type <> '' order by chapter desc limit 50) group by hook_type")
simple("review_trend_E09", lambda b: A.review_trend(b.reviews, 12), "select count(*) as n, round(avg(overall_score), 2) as overall_avg from (select * from reviews order by end_chapter desc limit 12)")
simple("dimension_trend_E09", lambda b: A.dimension_trend(b.reviews, 12), "select name as dimension, round(avg(score), 2) as average from review_parts where end_chapter in (select end_chapter from reviews order by end_chapter desc limit 12) group by name")
simple("severity_trend_E09", lambda b: A.severity_trend(b.reviews, 12), "select name as severity, cast(sum(n) as bigint) as total from review_parts where end_chapter in (select end_chapter from reviews order by end_chapter desc limit 12) group by name")
simple(
    "checklist_trend_E10",
    lambda b: A.checklist_trend(b.checklists, 10),
    "select count(*) as n, round(avg(score), 2) as score_avg, round(avg(completion_rate), 4) as completion_avg, round(avg(case when required_items > 0 then completed_required * 1.0 / required_items else 1.0 end), 4) as required_avg from (select * from checklists order by chapter desc limit 10)",
)
simple("source_histogram_E12", lambda b: A.count_per(b.t.documents.withColumn("source", F.when(F.col("source") != "src0", F.col("source"))), "source", "n", "unknown"), "select case when source = 'src0' then 'unknown' else source end as source, count(*) as n from documents group by 1")
simple(
    "strand_shares_E13",
    lambda b: A.shares(b.t.events, "event_type", ["click", "view", "purchase"], ["user_id"]).select("user_id", "n", *[F.round(f"pct_{x}", 6).alias(f"pct_{x}") for x in ("click", "view", "purchase")]),
    "select user_id, count(*) as n, " + ", ".join(f"round(count(*) filter (event_type = '{x}') * 100.0 / count(*), 6) as pct_{x}" for x in ("click", "view", "purchase")) + " from events group by user_id",
)
simple("dashboard_totals_E15", lambda b: A.count_per(b.t.documents, "lang", "chapters", more={"words": F.sum("n_chars")}), "select lang, cast(sum(n_chars) as bigint) as words, count(*) as chapters from documents group by lang")
simple("archive_sizes_E16", lambda b: A.count_per(b.debts, "status", "n"), "select status, count(*) as n from debts group by status")
simple(
    "alias_index_E17",
    lambda b: A.alias_index(b.aliases).groupBy("alias").agg(F.sort_array(F.collect_list(F.struct("type", "id"))).alias("entities"))
    .select("alias", F.array_join(F.transform("entities", lambda e: F.concat(e["type"], F.lit(":"), e["id"].cast("string"))), ",").alias("entities")),
    "select alias, string_agg(entity_type || ':' || entity_id, ',' order by entity_type, entity_id) as entities from aliases group by alias",
)
simple("alias_rows_E17", lambda b: A.alias_index(b.aliases), "select distinct alias, entity_type as type, entity_id as id from aliases")
simple(
    "entity_export_E18",
    lambda b: A.entity_export(b.entities.select("id", "type", "canonical_name")).select("type", "id", "record.canonical_name"),
    "select type, id, canonical_name from entities",
)
simple("checks_score_E19", lambda b: A.passed_share(b.tool_calls, "success").select(F.round("score", 6).alias("score")), "select round(avg(cast(success as integer)) * 100, 6) as score from tool_calls")

# runs and windows
_runs = """with e as (select user_id, event_type = 'click' as m, row_number() over (partition by user_id order by ts, event_id) as n from events),
i as (select user_id, m, n - row_number() over (partition by user_id, m order by n) as g from e),
r as (select user_id, m, count(*) as len from i group by user_id, m, g)
select user_id, cast(sum(len) as bigint) as n, coalesce(max(len) filter (m), 0) as longest_run, coalesce(max(len) filter (not m), 0) as longest_gap from r group by user_id"""
simple("streaks_and_gaps_W01_W02", lambda b: W.longest_runs(b.t.events.withColumn("day", day()), "user_id", "day", ["ts", "event_id"], F.col("event_type") == "click"), _runs)
simple(
    "latest_per_key_W03",
    lambda b: J.latest_as_of(b.t.events.select("event_id", "ts", "user_id", "event_type"), ["user_id", "event_type"], "ts", ["ts", "event_id"]),
    "select event_id, ts, user_id, event_type from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1",
)
simple("ranks_W04", lambda b: W.ranks(L.top(b.samples.select("id", "score"), 40, "score desc", "id"), "score", "id").select("id", F.col("rank").cast("long").alias("rank")), "select id, row_number() over (order by score desc, id) - 1 as rank from samples order by score desc, id limit 40")
simple("recent_window_W05", lambda b: W.window_slice(b.chapters.drop("summary"), 60, 10), "select chapter, title, location, word_count from chapters where chapter >= 50 and chapter < 60")
simple("stride_sample_W06", lambda b: W.stride_sample(b.chapters.select("chapter", "summary"), 171).select("chapter"), "select chapter from (select chapter from chapters where chapter > 0 and chapter <= 151 and (171 - chapter) % 20 = 0 and length(trim(summary)) > 0 order by chapter desc limit 5)")
simple(
    "run_counter_W07",
    lambda b: W.run_since_switch(b.t.events.select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type", day()).select("event_id", F.col("run").cast("long").alias("run")),
    "select event_id, row_number() over (partition by user_id, event_type, g order by ts, event_id) as run from (select *, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, event_type order by ts, event_id) as g from events)",
)
simple("retain_last_W08", lambda b: W.retain_last(b.t.events.select("event_id", "user_id", "ts"), 5, "user_id", ["ts", "event_id"]), "select event_id, user_id, ts from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 5")

# set-like
simple("candidate_union_U01", lambda b: W.union_ids(b.t.embeddings.select(F.col("vec_id").alias("id")), b.invalid_facts.select("source_id")), "select vec_id as id from embeddings union select source_id from invalid_facts")
simple(
    "keep_max_U02",
    lambda b: W.keep_max(b.t.orders.select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("score")), b.t.customer.select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") * 40).alias("score")), "k"),
    "select k, max(score) as score from (select o_custkey as k, o_totalprice as score from orders union all select c_custkey, c_acctbal * 40 from customer) group by k",
)
simple(
    "ordered_distinct_U03",
    lambda b: b.chapters.select("chapter", F.array_join(F.slice(W.ordered_distinct(F.regexp_extract_all(F.lower("summary"), F.lit("[a-z]+"), F.lit(0))), 1, 8), " ").alias("words")),
    "select chapter, array_to_string(list_transform(list_sort(list_transform(list_distinct(w), lambda x: list_position(w, x))), lambda p: w[p])[1:8], ' ') as words from (select chapter, regexp_extract_all(lower(summary), '[a-z]+') as w from chapters)",
)
simple(
    "append_if_new_U04",
    lambda b: B.insert_if_absent(_days(b, "view").withColumn("old", F.lit(True)), _days(b, "click").withColumn("old", F.lit(False)), ["user_id", "d"]).filter("not old").drop("old"),
    "select distinct user_id, date_diff('day', date '2024-01-01', cast(ts as date)) + 1 as d from events e where event_type = 'click' and not exists (select 1 from events v where v.event_type = 'view' and v.user_id = e.user_id and cast(v.ts as date) = cast(e.ts as date))",
)
simple("distinct_patterns_U05", lambda b: b.reading_power.select("chapter", F.coalesce(S.count_patterns(F.array_join("coolpoint_patterns", ";")), F.lit(0)).cast("long").alias("n")), "select chapter, len(list_distinct(coolpoint_patterns)) as n from reading_power")
