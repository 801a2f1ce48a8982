"""Queries: scans, point lookups, filters, top-k (families A, C, T, Y-01 and the list endpoints)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import lookup as L
from .bindings import Bound, sql
from .registry import query


def simple(name: str, fn, body: str) -> None:
    """Register ``fn(bound)`` with its SQL over the bindings."""
    query(name, sql(body))(lambda spark, folder: fn(Bound(spark, folder)))


# scans: each source as a whole
for _t, _c in {"region": "r_regionkey, r_name", "nation": "n_nationkey, n_name, n_regionkey", "supplier": "s_suppkey, s_name, s_nationkey, s_acctbal", "part": "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice"}.items():
    simple(f"scan_{_t}_A01", lambda b, t=_t, c=_c: getattr(b.t, t).select(*c.split(", ")), f"select {_c} from {_t}")
simple("vectors_scan_A02", lambda b: b.t.embeddings.select("vec_id", "label", F.size("embedding").alias("width")), "select vec_id, label, cast(len(embedding) as integer) as width from embeddings")
simple("samples_scan_A03", lambda b: b.samples, "select * from samples")

# point lookups
simple("chapter_by_id_C01", lambda b: L.where(b.chapters, chapter=42).drop("summary"), "select chapter, title, location, word_count from chapters where chapter = 42")
simple("scenes_of_chapter_C02", lambda b: L.where(b.scenes, chapter=7).orderBy("scene_index"), "select * from scenes where chapter = 7 order by scene_index")
simple("appearances_of_chapter_C03", lambda b: L.where(b.appearances, chapter=5).orderBy(F.desc("confidence"), "entity_id"), "select * from appearances where chapter = 5")
simple("entity_by_id_C04", lambda b: L.where(b.entities, id=17), "select * from entities where id = 17")
simple("entities_by_type_C05", lambda b: L.where(b.entities, type="BUILDING", is_archived=False), "select * from entities where type = 'BUILDING' and not is_archived")
simple("entities_by_type_all_C05", lambda b: L.where(b.entities, type="BUILDING", is_archived=None), "select * from entities where type = 'BUILDING'")
simple("entities_by_tier_C06", lambda b: L.where(b.entities, tier="important", is_archived=False), "select * from entities where tier = 'important' and not is_archived")
simple(
    "core_entities_C07",
    lambda b: b.entities.filter((F.col("tier").isin("core", "important") | F.col("is_protagonist")) & ~F.col("is_archived")).orderBy(F.desc("is_protagonist"), F.col("last_appearance").desc_nulls_last(), "id"),
    "select * from entities where (tier in ('core', 'important') or is_protagonist) and not is_archived",
)
simple("protagonist_C08", lambda b: L.top(b.entities.filter("is_protagonist"), 1, "id"), "select * from entities where is_protagonist order by id limit 1")
simple("aliases_of_entity_C09", lambda b: L.where(b.aliases, entity_id=17).select("alias"), "select alias from aliases where entity_id = 17")
simple("changes_of_chapter_C10", lambda b: L.where(b.state_changes, chapter=3).orderBy("id"), "select * from state_changes where chapter = 3")
for _d, _w in {"from": "from_entity = 12", "to": "to_entity = 12", "both": "from_entity = 12 or to_entity = 12"}.items():
    simple(f"relationships_{_d}_C11", lambda b, d=_d: L.touching(b.relationships, 12, d), f"select * from relationships where {_w}")
simple("relationship_between_C12", lambda b: L.linking(b.relationships, 12, 40), "select * from relationships where (from_entity = 12 and to_entity = 40) or (from_entity = 40 and to_entity = 12)")
simple(
    "relationship_events_C13",
    lambda b: L.top(L.between(L.touching(b.relationship_events, 8, "both"), "chapter", 5, 20), 100, "chapter desc", "id desc").drop("strength"),
    "select id, from_entity, to_entity, type, action, chapter from relationship_events where (from_entity = 8 or to_entity = 8) and chapter between 5 and 20 order by chapter desc, id desc limit 100",
)
simple(
    "relationship_timeline_C14",
    lambda b: L.top(L.between(L.linking(b.relationship_events, 8, 69), "chapter", 1, 30), 100, "chapter", "id").drop("strength"),
    "select id, from_entity, to_entity, type, action, chapter from relationship_events where ((from_entity = 8 and to_entity = 69) or (from_entity = 69 and to_entity = 8)) and chapter between 1 and 30 order by chapter, id limit 100",
)
simple("pending_contracts_C15", lambda b: L.due(b.contracts, "pending", 23970), "select * from contracts where status = 'pending' and due_chapter <= 23970")
simple("pending_contracts_all_C15", lambda b: L.due(b.contracts, "pending", 0), "select * from contracts where status = 'pending'")
simple("overdue_contracts_C16", lambda b: L.due(b.contracts, "pending", 23970, strict=True), "select * from contracts where status = 'pending' and due_chapter < 23970")
simple("contracts_of_chapter_C17", lambda b: L.where(b.contracts, chapter=23960), "select * from contracts where chapter = 23960")
simple("active_debts_C18", lambda b: L.where(b.debts, status="active"), "select * from debts where status = 'active'")
simple("overdue_debts_C18", lambda b: L.overdue_debts(b.debts, 23970), "select * from debts where status = 'overdue' or (status = 'active' and due_chapter < 23970)")
simple("debt_history_C19", lambda b: L.where(b.debt_events, debt_id=33).orderBy("chapter", "n"), "select * from debt_events where debt_id = 33")
simple("reading_power_of_chapter_C20", lambda b: L.where(b.reading_power, chapter=11).select("chapter", "hook_type", "debt_balance"), "select chapter, hook_type, debt_balance from reading_power where chapter = 11")
simple("invalid_facts_C21", lambda b: L.where(b.invalid_facts, status="pending"), "select * from invalid_facts where status = 'pending'")
simple("invalid_ids_C21", lambda b: b.invalid_facts.filter("status = 'confirmed'").select("source_id").distinct(), "select distinct source_id from invalid_facts where status = 'confirmed'")
simple("samples_by_type_C22", lambda b: L.top(b.samples.filter("scene_type = 'ECONOMY' and score >= 950"), 20, "score desc", "id"), "select * from samples where scene_type = 'ECONOMY' and score >= 950 order by score desc, id limit 20")
simple("confidence_filter_C23", lambda b: L.confident(b.appearances.withColumn("confidence", F.when(F.col("mentions") > 1, F.col("confidence"))), 0.75), "select entity_id, chapter, mentions, case when mentions > 1 then confidence end as confidence from appearances where mentions <= 1 or confidence >= 0.75")
simple("state_changes_of_entity_C24", lambda b: L.where(b.state_changes, entity_id=8, field="click"), "select * from state_changes where entity_id = 8 and field = 'click'")
simple("vectors_by_ids_C26", lambda b: L.by_ids(b.t.embeddings.select("vec_id", "label"), b.invalid_facts.select("source_id"), "vec_id"), "select vec_id, label from embeddings where vec_id in (select source_id from invalid_facts)")
simple("scenes_by_location_Y01", lambda b: L.top(L.containing(b.scenes, "location", "ASSIST").drop("summary"), 20, "chapter desc", "scene_index"), "select chapter, scene_index, location from scenes where lower(location) like '%assist%' order by chapter desc, scene_index limit 20")

# top-k lists
simple("recent_chapters_T01", lambda b: L.top(b.chapters.drop("summary"), 10, "chapter desc"), "select chapter, title, location, word_count from chapters order by chapter desc limit 10")
simple("appearances_of_entity_T02", lambda b: L.top(L.where(b.appearances, entity_id=8), 50, "chapter desc"), "select * from appearances where entity_id = 8 order by chapter desc limit 50")
simple("changes_of_entity_T03", lambda b: L.top(L.where(b.state_changes, entity_id=8), 20, "chapter desc", "id desc"), "select * from state_changes where entity_id = 8 order by chapter desc, id desc limit 20")
simple("recent_changes_T04", lambda b: L.top(b.state_changes, 50, "chapter desc", "id desc"), "select * from state_changes order by chapter desc, id desc limit 50")
simple("recent_relationships_T05", lambda b: L.top(b.relationships, 30, "chapter desc", "from_entity", "to_entity", "type"), "select * from relationships order by chapter desc, from_entity, to_entity, type limit 30")
simple("recent_reading_power_T06", lambda b: L.top(b.reading_power.drop("coolpoint_patterns"), 10, "chapter desc"), "select chapter, hook_type, hook_strength, debt_balance from reading_power order by chapter desc limit 10")
simple("recent_reviews_T07", lambda b: L.top(b.reviews.select("end_chapter", "start_chapter", F.round("overall_score", 6).alias("overall_score")), 5, "end_chapter desc", "start_chapter desc"), "select end_chapter, start_chapter, round(overall_score, 6) as overall_score from reviews order by end_chapter desc, start_chapter desc limit 5")
simple("recent_checklists_T08", lambda b: L.top(b.checklists.select("chapter", "total_items", "completed_items", "completion_rate"), 10, "chapter desc"), "select chapter, total_items, completed_items, completion_rate from checklists order by chapter desc limit 10")
simple("best_samples_T09", lambda b: L.top(b.samples, 10, "score desc", "id"), "select * from samples order by score desc, id limit 10")
simple("recent_chunks_T10", lambda b: L.top(L.between(b.scenes.filter("location = 'user'"), "chapter", None, 90).drop("summary"), 25, "chapter desc", "scene_index desc"), "select chapter, scene_index, location from scenes where location = 'user' and chapter <= 90 order by chapter desc, scene_index desc limit 25")
simple("recent_chunks_none_T10", lambda b: L.top(b.scenes.drop("summary"), 0, "chapter desc"), "select chapter, scene_index, location from scenes limit 0")
simple("samples_per_type_T11", lambda b: L.per_group_top(b.samples, "scene_type", 3, "score desc", "id"), "select id, scene_type, content, score from (select *, row_number() over (partition by scene_type order by score desc, id) as r from samples) where r <= 3")
simple("page_of_entities_T13", lambda b: L.page(b.entities, 3, 12, "id"), "select * from entities order by id limit 12 offset 24")
simple("node_order_T14", lambda b: G.order_nodes(b.entities, 17).limit(25), "select * from entities order by case when id = 17 then 0 else 1 end, last_appearance desc nulls last, id limit 25")

# list endpoints
simple("api_entities_C25", lambda b: b.entities.filter("not is_archived").orderBy(F.col("last_appearance").desc_nulls_last(), "id"), "select * from entities where not is_archived")
simple("api_relationships_C25", lambda b: L.top(b.relationships, 200, "chapter desc", "from_entity", "to_entity", "type"), "select * from relationships order by chapter desc, from_entity, to_entity, type limit 200")
simple("api_relationship_events_C25", lambda b: L.top(L.between(b.relationship_events, "chapter", 10, 20).drop("strength"), 200, "chapter desc", "id desc"), "select id, from_entity, to_entity, type, action, chapter from relationship_events where chapter between 10 and 20 order by chapter desc, id desc limit 200")
simple("api_chapters_C25", lambda b: b.chapters.drop("summary").orderBy("chapter"), "select chapter, title, location, word_count from chapters")
simple("api_scenes_C25", lambda b: L.top(b.scenes.drop("summary"), 500, "chapter", "scene_index"), "select chapter, scene_index, location from scenes order by chapter, scene_index limit 500")
simple("api_reading_power_C25", lambda b: L.top(b.reading_power.drop("coolpoint_patterns"), 50, "chapter desc"), "select chapter, hook_type, hook_strength, debt_balance from reading_power order by chapter desc limit 50")
simple("api_review_metrics_C25", lambda b: L.top(b.reviews.select("end_chapter", F.round("overall_score", 6).alias("overall_score")), 20, "end_chapter desc"), "select end_chapter, round(overall_score, 6) as overall_score from reviews order by end_chapter desc limit 20")
simple("api_state_changes_C25", lambda b: L.top(b.state_changes, 100, "chapter desc", "id desc"), "select * from state_changes order by chapter desc, id desc limit 100")
simple("api_aliases_C25", lambda b: b.aliases, "select * from aliases")
simple("api_overrides_C25", lambda b: L.top(b.contracts, 100, "chapter desc", "id"), "select * from contracts order by chapter desc, id limit 100")
simple("api_debts_C25", lambda b: L.top(L.where(b.debts, status="active"), 100, "source_chapter desc", "id"), "select * from debts where status = 'active' order by source_chapter desc, id limit 100")
simple("api_debt_events_C25", lambda b: L.top(b.debt_events, 200, "chapter desc", "debt_id", "n", "amount"), "select * from debt_events order by chapter desc, debt_id, n, amount limit 200")
simple("api_invalid_facts_C25", lambda b: L.top(b.invalid_facts, 100, "source_id"), "select * from invalid_facts order by source_id limit 100")
simple("api_tool_stats_C25", lambda b: L.top(b.tool_calls.filter("tool_name = 'error'"), 200, "ts desc", "id"), "select * from tool_calls where tool_name = 'error' order by ts desc, id limit 200")
simple("api_checklists_C25", lambda b: L.top(b.checklists.select("chapter", "completed_required", "required_items"), 100, "chapter desc"), "select chapter, completed_required, required_items from checklists order by chapter desc limit 100")
