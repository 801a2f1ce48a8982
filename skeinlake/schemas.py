"""Record types of the data model, one DDL string per table, and its language-neutral enums."""

from __future__ import annotations

from pyspark.sql import types as T

#: Enums of the data model.
TIERS = ("core", "important", "secondary", "decor")
ACTIONS = ("create", "update", "remove")
CONTRACT_STATUS = ("pending", "fulfilled", "overdue", "cancelled")
TERMINAL = ("fulfilled", "cancelled")
DEBT_STATUS = ("active", "overdue", "paid")
THREAD_STATUS = ("open", "resolved")
THREAD_TIER = ("core", "sub", "decor")


def record_type(name: str) -> T.StructType:
    """The type of a table's rows. Needs a session, as Spark parses it."""
    return T.StructType.fromDDL(SCHEMAS[name])


SCHEMAS: dict[str, str] = {
    "chapters": "chapter long not null, title string, location string, word_count long, characters array<string>, summary string, created_at timestamp",
    "scenes": "chapter long not null, scene_index long not null, start_line long, end_line long, location string, summary string, characters array<string>",
    "appearances": "entity_id string not null, chapter long not null, mentions array<string>, confidence double",
    "entities": "id string not null, type string not null, canonical_name string not null, tier string, `desc` string, current map<string,string>, first_appearance long, last_appearance long, is_protagonist boolean, is_archived boolean",
    "aliases": "alias string not null, entity_id string not null, entity_type string not null, created_at timestamp",
    "state_changes": "id long not null, entity_id string not null, field string not null, old_value string, new_value string, reason string, chapter long not null",
    "relationships": "id long not null, from_entity string not null, to_entity string not null, type string not null, description string, chapter long not null",
    "relationship_events": "id long not null, from_entity string not null, to_entity string not null, type string not null, action string, polarity long, strength double, description string, chapter long not null, scene_index long, evidence string, confidence double",
    "override_contracts": "id long not null, chapter long not null, constraint_type string not null, constraint_id string not null, rationale_type string, rationale_text string, payback_plan string, due_chapter long not null, status string, fulfilled_at timestamp",
    "debts": "id long not null, debt_type string not null, original_amount double, current_amount double, interest_rate double, source_chapter long not null, due_chapter long not null, override_contract_id long, status string",
    "debt_events": "id long not null, debt_id long not null, event_type string not null, amount double not null, chapter long not null, note string",
    "reading_power": "chapter long not null, hook_type string, hook_strength string, coolpoint_patterns array<string>, micropayoffs array<string>, hard_violations array<string>, soft_suggestions array<string>, is_transition boolean, override_count long, debt_balance double",
    "invalid_facts": "id long not null, source_type string not null, source_id string not null, reason string not null, status string, marked_by string not null, marked_at timestamp, confirmed_at timestamp, chapter_discovered long",
    "review_metrics": "start_chapter long not null, end_chapter long not null, overall_score double, dimension_scores map<string,double>, severity_counts map<string,long>, critical_issues array<string>, report_file string, notes string",
    "rag_query_log": "id long not null, query string, query_type string, results_count long, hit_sources map<string,long>, latency_ms long, chapter long",
    "tool_call_stats": "id long not null, tool_name string, success boolean, retry_count long, error_code string, error_message string, chapter long",
    "checklist_scores": "chapter long not null, template string, total_items long, required_items long, completed_items long, completed_required long, total_weight double, completed_weight double, completion_rate double, score double, score_breakdown map<string,double>, pending_items array<string>",
    "schema_meta": "key string not null, value string, updated_at timestamp",
    "chunks": "chunk_id string not null, chapter long, scene_index long, content string, embedding array<float>, parent_chunk_id string, chunk_type string, source_file string",
    "postings": "term string not null, chunk_id string not null, tf double",
    "doc_stats": "chunk_id string not null, doc_length long",
    "samples": "id string not null, chapter long, scene_type string, content string, score double, tags array<string>",
}

#: The nested record of one ingested chapter.
PAYLOAD = (
    "chapter long, title string, location string, word_count long, summary string,"
    "scenes array<struct<index:long,start_line:long,end_line:long,location:string,summary:string,characters:array<string>>>,"
    "entities_appeared array<struct<id:string,type:string,mentions:array<string>,confidence:double>>,"
    "entities_new array<struct<suggested_id:string,name:string,type:string,tier:string>>,"
    "state_changes array<struct<entity_id:string,field:string,old:string,new:string,reason:string>>,"
    "relationships_new array<struct<from:string,to:string,type:string,description:string,chapter:long>>,"
    "uncertain array<struct<mention:string,candidates:array<struct<type:string,id:string>>,confidence:double,adopted:string>>"
)
