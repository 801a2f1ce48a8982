"""Queries: sources, round trips through files, routing, reports and supporting operators."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import routing as Q
from ..functions import scalars as S
from ..operators import context as X
from ..operators import graph as G
from ..operators import lookup as L
from ..operators import reports as P
from ..operators import retrieval as R
from ..operators import snapshots as H
from ..operators import support as Y
from ..operators import tables as M
from ..operators import upsert as B
from ..operators.storage import shared_root
from ..sources import files
from ..streaming import ingest as I
from .bindings import Bound, sql
from .q_lookup import simple
from .registry import ORACLES, query


def _folder(spark) -> str:
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


# Markdown corpora: documents as files
def _files(b):
    return b.t.documents.select(F.concat(F.lit("corpus/chapter-"), "doc_id", F.lit(".md")).alias("path"), F.concat(F.lit("# Title "), "doc_id", F.lit("\n- **Points**: "), F.col("doc_id") % 7, F.lit("\n"), "text").alias("text"))


simple(
    "chapters_of_files_A04_F26",
    lambda b: files.chapters(_files(b), "Points", b.t.nation.select(F.col("n_name").alias("name")).unionByName(b.t.labels.limit(0).select(F.lit("").alias("name")))).select("chapter", "title", F.col("word_count").cast("long").alias("word_count"), "stat", F.size("characters").alias("found")),
    """select doc_id as chapter, 'Title ' || doc_id as title, cast(doc_id % 7 as varchar) as stat, length(trim(regexp_replace(regexp_replace(regexp_replace(t, '(?s)```.*?```', '', 'g'), '(?m)^#+ .*$', '', 'g'), '(?m)^\\s*---+\\s*$', '', 'g'))) as word_count,
0 + cast((select count(*) from nation where contains(t, n_name)) as integer) as found from (select doc_id, '# Title ' || doc_id || chr(10) || '- **Points**: ' || doc_id % 7 || chr(10) || text as t from documents)""",
)
simple("summaries_A07_Y28", lambda b: b.t.documents.select("doc_id", files.chapter_summary(F.col("text"), F.when(F.col("lang") == "de", F.lit("own")), "Summary", "Points").alias("summary")), "select doc_id, case when lang = 'de' then 'own' else left(text, 500) end as summary from documents")
simple(
    "outlines_A06",
    lambda b: files.outlines(
        b.t.conversations.filter("turn = 0 and conv_id % 2 = 0").select(F.col("conv_id").alias("chapter"), F.lit("own").alias("text")),
        b.t.conversations.filter("turn = 0").select(F.concat(F.lit("# Chapter "), "conv_id", F.lit("\n"), F.repeat("text", 9)).alias("text")),
    ),
    "select conv_id as chapter, case when conv_id % 2 = 0 then 'own' when length(t) > 1500 then left(t, 1500) || '...' else t end as outline from (select conv_id, '# Chapter ' || conv_id || chr(10) || repeat(text, 9) as t from conversations where turn = 0)",
)
simple("bullets_F22", lambda b: b.t.part.select("p_partkey", F.array_join(S.bullets(F.concat(F.lit("- "), F.regexp_replace("p_name", " ", "\n* ")), 2), "|").alias("items")), "select p_partkey, replace(p_name, ' ', '|') as items from part")
simple("stats_field_F26", lambda b: b.t.part.select("p_partkey", S.stats_field(F.concat(F.lit("intro\n- **Size**: "), "p_size", F.lit("\n- **Size**: 0")), "Size").alias("size")), "select p_partkey, cast(p_size as varchar) as size from part")
simple("named_file_Y21", lambda b: Y.named_files(_files(b).select(F.element_at(F.split("path", "/"), -1).alias("file")), "chapter-7").select("file"), "select 'chapter-7.md' as file")


# round trips through files in the shared folder
@query("file_tree_A04_Y35", "select n_nationkey, n_name from nation")
def file_tree(spark, folder):
    """One text file for each nation, read back whole."""
    path = _folder(spark)
    Bound(spark, folder).t.nation.select("n_nationkey", F.concat(F.lit("name: "), "n_name").alias("value")).write.partitionBy("n_nationkey").text(path)
    got = files.markdown(spark, path, "*.txt")
    return got.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("long").alias("n_nationkey"), F.regexp_extract("text", r"name: (\S+)", 1).alias("n_name"))


@query("json_documents_A05_A08_A13_Y16", "select n_nationkey as id, n_name as name, cast(null as varchar) as missing from nation")
def json_documents(spark, folder):
    """One document a file, read under a schema with a field they lack."""
    path = _folder(spark)
    Bound(spark, folder).t.nation.select("n_nationkey", F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).write.partitionBy("n_nationkey").json(path)
    return files.json_document(spark, path, T.StructType.fromDDL("id long, name string, missing string")).select("id", "name", "missing")


@query("appended_log_B34_B35", "select event_type, count(*) as n from events group by event_type")
def appended_log(spark, folder):
    """The log written in two appends as lines, and read back."""
    path, e = _folder(spark), Bound(spark, folder).t.events
    for half in (0, 1):
        e.filter(F.col("event_id") % 2 == half).select("event_id", "event_type").write.mode("append").json(path)
    return files.json_lines(spark, path, T.StructType.fromDDL("event_id long, event_type string")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("replaced_partitions_B34", "select n_regionkey, n_nationkey, case when n_regionkey = 2 then 'new' else n_name end as n_name from nation")
def replaced_partitions(spark, folder):
    """A table by region, of which one partition is overwritten."""
    path, n = _folder(spark), Bound(spark, folder).t.nation.select("n_regionkey", "n_nationkey", "n_name")
    files.write_table(n, path, ["n_regionkey"], "overwrite")
    files.write_table(n.filter("n_regionkey = 2").withColumn("n_name", F.lit("new")), path, ["n_regionkey"], "overwrite")
    return spark.read.parquet(path).select(F.col("n_regionkey").cast(n.schema["n_regionkey"].dataType).alias("n_regionkey"), "n_nationkey", "n_name")


@query("snapshot_B33_Y25", "select s_suppkey, s_name from supplier")
def snapshot(spark, folder):
    """Saved under a version and loaded again."""
    path = _folder(spark)
    H.save_snapshot(Bound(spark, folder).t.supplier.select("s_suppkey", "s_name"), path, "2", 7)
    return H.load_snapshot(spark, path, "2", 7)


@query("ingested_stream_Y09_B26", "select cast(event_id as bigint) + 1 as chapter, event_type as title from events where event_type <> 'error'")
def ingested_stream(spark, folder):
    """Payloads staged as files, streamed into one table a section; broken ones are rejected."""
    path, e = _folder(spark), Bound(spark, folder).t.events
    record = F.to_json(F.struct((F.col("event_id") + 1).alias("chapter"), F.col("event_type").alias("title")))
    e.select(F.when(F.col("event_type") == "error", F.lit("{broken")).otherwise(record).alias("value")).write.text(f"{path}/in")
    I.ingest_stream(spark.readStream.text(f"{path}/in"), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out/chapters").select("chapter", "title")


@query("missing_columns_A12_Y06", "select vec_id, label, embedding is not null as has_vector, null::varchar as parent_chunk_id, null::bigint as chapter from embeddings")
def missing_columns(spark, folder):
    """Every row under a record type of which the table lacks two columns."""
    want = T.StructType.fromDDL("vec_id long, label int, embedding array<float>, parent_chunk_id string, chapter long")
    have = Bound(spark, folder).t.embeddings
    assert files.columns_missing(have, want) == ["parent_chunk_id", "chapter"]
    return M.conform(have, want).select("vec_id", "label", F.col("embedding").isNotNull().alias("has_vector"), "parent_chunk_id", "chapter")


def _migrated(spark, folder):
    path = _folder(spark)
    M.save_table(Bound(spark, folder).t.embeddings.select("vec_id", "label"), path)
    M.migrate_table(spark, path, lambda df: df.withColumn("kind", F.concat(F.lit("k"), "label")).drop("label"))
    return path


@query("migrated_table_B28_Y06", "select vec_id, 'k' || label as kind from embeddings")
def migrated_table(spark, folder):
    """A migration that fails leaves what the one before it published."""
    path = _migrated(spark, folder)
    try:
        M.migrate_table(spark, path, lambda df: df.withColumn("bad", F.raise_error(F.lit("no"))))
    except PySparkException:
        pass
    return M.load_table(spark, path)


@query("restored_table_Y06", "select vec_id, label from embeddings")
def restored_table(spark, folder):
    """The copy before the migration, back again."""
    path = _migrated(spark, folder)
    assert M.restore_table(spark, path)
    return M.load_table(spark, path)


# routing of a table of queries: words, markers and separators are parameters
_WORDS = {"relationship": ["relation"], "scene": ["where"], "setting": ["rule"], "entity": ["who"]}
_KINDS = ["relation of 甲乙 and 丙丁 and 甲乙, 第", "who is the ", "where, chapters 9-", "rule of 天地人 ", "what happened"]


def _asked(b):
    """A query for each turn, by its number."""
    text = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("turn") % 5 + 1).cast("int"))
    return b.t.conversations.select("conv_id", "turn", F.concat(text, F.col("conv_id") % 20, F.when(F.col("conv_id") % 2 == 0, "章").otherwise(""), F.lit("; "), "role").alias("query"))


_ASKED = """(select conv_id, turn, cast(conv_id % 20 as bigint) as c, case when conv_id % 2 = 0 then true else false end as m, role,
['relationship', 'entity', 'scene', 'setting', 'plot'][turn % 5 + 1] as intent, ['甲乙,丙丁', '', '', '天地人', ''][turn % 5 + 1] as entities from conversations)"""
simple(
    "routing_R13_R14_Y08",
    lambda b: _asked(b).withColumn("r", Q.route(F.col("query"), _WORDS, marker=R.CHAPTER)).select("conv_id", "turn", "r.intent", F.array_join("r.entities", ",").alias("entities"), F.col("r.time_scope.first").alias("first"), F.col("r.time_scope.last").alias("last"), "r.needs_graph"),
    f"select conv_id, turn, intent, entities, case when m then case when intent = 'scene' then least(c, 9) else c end end as first, case when m then case when intent = 'scene' then greatest(c, 9) else c end end as last, intent = 'relationship' as needs_graph from {_ASKED}",
)
simple(
    "planned_steps_R15",
    lambda b: _asked(b).select("conv_id", "turn", F.posexplode(Q.steps(Q.route(F.col("query"), _WORDS, ("relationship", "setting")), R.STRATEGIES)).alias("place", "s")).select("conv_id", "turn", "place", "s.name", "s.strategy"),
    f"""select conv_id, turn, place, case intent when 'relationship' then ['relationship_graph', 'relationship_evidence'][place + 1] when 'setting' then 'graph_enhanced_retrieval' else 'default_retrieval' end as name,
case intent when 'relationship' then ['graph_lookup', 'graph_hybrid'][place + 1] when 'setting' then 'graph_hybrid' when 'scene' then 'bm25' else 'hybrid' end as strategy from {_ASKED}, (values (0), (1)) t(place) where place = 0 or intent = 'relationship'""",
)
simple("split_query_R16", lambda b: _asked(b).filter("turn % 5 = 4").select("conv_id", "turn", F.posexplode(Q.split_query(F.concat("query", F.lit("；；")))).alias("n", "part")),
       "select conv_id, turn, n, case n when 0 then 'what happened' || conv_id % 20 || case when conv_id % 2 = 0 then '章' else '' end else role end as part from conversations, (values (0), (1)) t(n) where turn % 5 = 4")


# documents with nested maps
_FLAT = "select c_custkey, c_name, c_mktsegment, c_nationkey from customer where c_custkey % 3 <> 2 or c_custkey % 5 <> 0"


def _document(b):
    c = b.t.customer
    record = F.struct(F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).alias("name"), F.lit("core").alias("tier"), F.lit(1).alias("first_appearance"), F.col("c_custkey").alias("last_appearance"), F.array(F.concat(F.lit("alias "), "c_nationkey")).alias("aliases"))
    # A document holds a hundred records.
    per = c.groupBy(F.floor(F.col("c_custkey") / 100).alias("document"), "c_mktsegment").agg(F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string").alias("id"), record.alias("r")))).alias("by_id"))
    return per.groupBy("document").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "by_id"))).alias("entities"))


simple("migrated_entities_B27_Y14", lambda b: Y.migrate_document(_document(b))["entities"], "select cast(c_custkey as varchar) as id, c_mktsegment as type, case when c_custkey % 5 > 0 then c_name end as canonical_name, 'core' as tier, 1 as first_appearance, c_custkey as last_appearance from customer")
simple("migrated_aliases_B27", lambda b: Y.migrate_document(_document(b))["aliases"], "select 'alias ' || c_nationkey as alias, cast(c_custkey as varchar) as entity_id, c_mktsegment as entity_type from customer")
simple("skipped_in_migration_B27", lambda b: Y.migrate_document(_document(b))["skipped"], "select cast(c_custkey as varchar) as id, c_mktsegment as type from customer where c_custkey % 5 = 0")

# state, progress, entities
simple("progress_B32_Y17", lambda b: Y.progress(b.chapters.select("chapter", F.col("word_count").alias("words"))), "select max(chapter) as current_chapter, cast(sum(word_count) as bigint) as total_words from chapters")
simple(
    "added_entities_Y10",
    lambda b: B.insert_if_absent(b.entities.filter("tier = 'core'").select("id", "type", "canonical_name"), b.entities.select("id", F.lit("new").alias("type"), "canonical_name"), ["id"]),
    "select id, case when tier = 'core' then type else 'new' end as type, canonical_name from entities",
)
simple("last_appearance_Y12", lambda b: B.monotone(b.appearances, ["entity_id"], "chapter", "first_chapter"), "select entity_id, max(chapter) as chapter, min(chapter) as first_chapter from appearances group by entity_id")
simple("staged_changes_Y13", lambda b: B.ingest(b.t.orders.select(
    F.col("o_orderkey").alias("chapter"), F.lit("").alias("title"), F.lit("").alias("location"), F.lit(0).alias("word_count"), F.lit("").alias("summary"),
    F.array().cast("array<struct<id:string,type:string,mentions:array<string>,confidence:double>>").alias("entities_appeared"),
    F.array().cast("array<struct<suggested_id:string,name:string,type:string,tier:string>>").alias("entities_new"),
    F.array().cast("array<struct<index:int,start_line:int,end_line:int,location:string,summary:string,characters:array<string>>>").alias("scenes"),
    F.array(F.struct(F.col("o_custkey").cast("string").alias("entity_id"), F.lit("status").alias("field"), F.lit(None).cast("string").alias("old"), F.col("o_orderstatus").alias("new"), F.lit("").alias("reason"))).alias("state_changes"),
    F.array().cast("array<struct<from:string,to:string,type:string,description:string,chapter:bigint>>").alias("relationships_new"),
))["state_changes"].select("entity_id", "field", "new_value", "chapter"), "select cast(o_custkey as varchar) as entity_id, 'status' as field, o_orderstatus as new_value, o_orderkey as chapter from orders")
simple("slim_Y18", lambda b: b.t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("name")))).alias("l")).select("conv_id", F.array_join(Y.slim(F.col("l"), 3), ",").alias("names")),
       "select conv_id, string_agg(role, ',' order by turn) as names from conversations where turn in (select unnest([0, 1, 2])) group by conv_id")
simple("restored_Y19", lambda b: B.remove_keys(b.entities.filter("is_archived").select("id", "tier"), b.entities.filter("tier = 'decor' and id % 2 = 0").select("id"), ["id"]), "select id, tier from entities where is_archived and not (tier = 'decor' and id % 2 = 0)")
simple("recovery_Y34", lambda b: Y.recovery(b.t.events.select("event_id", F.col("event_type").alias("step")), b.t.events.sparkSession.createDataFrame([("error", "retry"), ("click", "skip")], "step string, option string")),
       "select event_type as step, event_id, case event_type when 'error' then 'retry' when 'click' then 'skip' end as option from events")
simple(
    "step_trace_Y33_K15",
    lambda b: Y.step_trace(b.t.conversations.select(F.col("conv_id").alias("task"), F.col("turn").alias("n"), F.when(F.col("role") == "user", "step").otherwise("done").alias("event"), F.when(F.col("turn") < 2, "draft").when(F.col("turn") < 6, "review").otherwise("publish").alias("step")), ["draft", "review", "publish"], {"draft": "writer", "publish": "editor"})
    .select("task", "n", "step", "expected_owner", F.array_join("missing", ",").alias("missing"), "violation"),
    """with ev as (select conv_id as task, turn as n, case when role = 'user' then 'step' else 'done' end as event, case when turn < 2 then 'draft' when turn < 6 then 'review' else 'publish' end as step from conversations),
o as (select * from (values ('review', 'draft'), ('publish', 'draft'), ('publish', 'review')) t(step, before)),
m as (select ev.task, ev.n, string_agg(distinct o.before, ',' order by o.before) as missing from ev join o on o.step = ev.step where event = 'step' and not exists (select 1 from ev d where d.task = ev.task and d.event = 'done' and d.step = o.before and d.n <= ev.n) group by 1, 2)
select ev.task, ev.n, ev.step, case ev.step when 'draft' then 'writer' when 'publish' then 'editor' end as expected_owner, coalesce(missing, '') as missing, missing is not null as violation from ev left join m on m.task = ev.task and m.n = ev.n where event = 'step'""",
)

# reports and guidance
query("rank_pack_X01", ORACLES["rank_summaries_X02"])(lambda spark, folder: P.rank_pack({"summaries": Bound(spark, folder).chapters.select("chapter", "summary")}, 150, ["idiot", "que el"])["summaries"].select("chapter", F.round("score", 6).alias("score")))
simple("scored_parts_Y39", lambda b: X.rank_summaries(b.chapters.select("chapter", "summary"), 150, [], debug=True).select("chapter", "score_recency", "score_length", "score_hook"),
       "select chapter, round(1.0 / (1 + greatest(0, 150 - chapter)), 6) as score_recency, round(least(length(summary) / 1200.0, 1.0) * 0.2, 6) as score_length, cast(0.0 as double) as score_hook from chapters")
simple("report_section_K06", lambda b: P.status_report({"stats": P.basic_stats(b.chapters, 1_000_000), "debts": b.debts}, "stats")["stats"].select("chapters", "words"), "select count(*) as chapters, cast(sum(word_count) as bigint) as words from chapters")
simple("step_timing_S15", lambda b: P.step_timing(b.t.lineitem.select(F.col("l_returnflag").alias("step"), F.col("l_linenumber").cast("long").alias("ms"))),
       "with p as (select l_returnflag as step, cast(sum(l_linenumber) as bigint) as ms from lineitem group by 1), t as (select cast(sum(ms) as bigint) as total_ms from p) select step, ms, round(ms / total_ms, 4) as ratio, total_ms, total_ms > 30000 as alarm from p, t order by ms desc, step limit 3")
simple("checker_rollup_S15", lambda b: P.checker_rollup(b.t.supplier.select(F.round(F.col("s_acctbal")).alias("score"), F.when(F.col("s_suppkey") % 3 == 0, 1).otherwise(0).alias("critical"), F.lit(2).alias("high"), (F.col("s_suppkey") >= 0).alias("passed"))),
       "select count(*) as checkers, round(avg(round(s_acctbal)), 2) as overall_score, cast(count(*) filter (s_suppkey % 3 = 0) as bigint) as critical, cast(2 * count(*) as bigint) as high, true as passed from supplier")
simple("guidance_Y23_Y27", lambda b: P.guidance(b.t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("priority"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("when")), F.array(F.lit("ECONOMY")), 3, 6).select("id", "priority", F.col("place").cast("long").alias("place"), "enough"),
       "select id, priority, row_number() over (order by priority, id) as place, count(*) over () >= 3 as enough from (select p_partkey as id, p_size as priority from part where p_partkey % 2 <> 0 or p_type = 'ECONOMY') qualify place <= 6")
simple(
    "genre_profiles_Y22",
    lambda b: P.genre_profile(b.t.nation.select(F.concat("n_name", F.lit("+X/"), "n_name").alias("genre")), b.t.nation.select(F.col("n_name").alias("name"), F.concat(F.lit("- one "), "n_name", F.lit("\n- two")).alias("text")), {"X": "NATION_3"})
    .select("genre", "at", "token", "excerpt", F.array_join("refs", "|").alias("refs")),
    "select n.n_name || '+X/' || n.n_name as genre, k as at, f.n_name as token, '- one ' || f.n_name || chr(10) || '- two' as excerpt, 'one ' || f.n_name || '|two' as refs from nation n cross join (select unnest([0, 1]) as k) join nation f on f.n_name = case when k = 0 then n.n_name else 'NATION_3' end",
)


simple("stages_X07", lambda b: b.chapters.select("chapter", Q.stage(F.col("chapter")).alias("stage")), "select chapter, case when chapter <= 30 then 'early' when chapter >= 120 then 'late' else 'mid' end as stage from chapters")
simple("archive_due_K11", lambda b: b.chapters.select("chapter", Q.archive_due(F.col("word_count"), F.col("chapter"), 20_000).alias("due")), "select chapter, word_count >= 20000 or (chapter > 0 and chapter % 10 = 0) as due from chapters")
simple("bars_Y32", lambda b: b.chapters.select("chapter", F.length(Q.bar(F.when(F.col("chapter") % 4 > 0, F.col("word_count") / 2))).alias("marks")), "select chapter, case when chapter % 4 > 0 then greatest(1, least(12, cast(trunc(12 - word_count / 2.0 / 2000.0 * 12) as int))) else 0 end as marks from chapters")
simple("enabled_Y26", lambda b: b.t.customer.select("c_custkey", Q.enabled_for(F.concat(F.lit(" "), F.initcap("c_mktsegment")), F.split(F.when(F.col("c_custkey") % 7 == 0, "x,ALL").otherwise("machinery, Building "), ",")).alias("enabled")), "select c_custkey, c_custkey % 7 = 0 or c_mktsegment in ('MACHINERY', 'BUILDING') as enabled from customer")
simple("json_argument_Y40", lambda b: b.t.events.select("event_id", Q.json_argument(F.when(F.col("event_type") == "error", "{broken").otherwise(F.col("props")), "$.k", "bigint").alias("k")), "select event_id, case when event_type <> 'error' then cast(json_extract_string(props, '$.k') as bigint) end as k from events")
simple("volume_planned_B32", lambda b: B.latest_wins(b.t.orders.select(F.col("o_custkey").alias("volume"), "o_orderdate", "o_orderkey", (F.col("o_orderkey") % 50).alias("planned")), ["volume"], ["o_orderdate", "o_orderkey"]), "select o_custkey as volume, o_orderdate, o_orderkey, o_orderkey % 50 as planned from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
simple("review_checkpoints_B32", lambda b: B.append_all([b.t.labels.select(F.col("doc_id").alias("chapter"), F.lit("quality").alias("checkpoint"), F.col("quality").cast("long").alias("value")), b.t.labels.filter("toxic = 1").select(F.col("doc_id").alias("chapter"), F.lit("toxic").alias("checkpoint"), F.col("toxic").cast("long").alias("value"))]), "select doc_id as chapter, 'quality' as checkpoint, cast(quality as bigint) as value from labels union all select doc_id, 'toxic', 1 from labels where toxic = 1")


@query("mermaid_F33_G03", sql("select 'n_' || from_entity || '[\"' || from_entity || '\"] -->|' || type || ' @' || chapter || '| n_' || to_entity || '[\"' || to_entity || '\"]' as line from (select * from links where from_entity = 8 or to_entity = 8 order by chapter desc, from_entity, to_entity, type limit 10)"))
def mermaid(spark, folder):
    got = G.mermaid(G.subgraph(Bound(spark, folder).links, 8, 1, 10)[0])
    return spark.createDataFrame([(x.strip(),) for x in got.splitlines()[1:]], "line string")


@query("rendered_B36_Y32", "select '| ' || r_regionkey || ' | ' || r_name || ' |' as line from region")
def rendered(spark, folder):
    got = P.render({"regions": L.top(Bound(spark, folder).t.region.select("r_regionkey", "r_name"), 10, "r_regionkey")})
    return spark.createDataFrame([(x,) for x in got.splitlines() if x.startswith("| ") and "---" not in x and "r_name" not in x], "line string")


@query("known_columns_A12", "select cast(n_nationkey as bigint) as id, n_name as canonical_name, null::varchar as tier from nation")
def known_columns(spark, folder):
    """A table under a record type that has more columns than it."""
    want = T.StructType.fromDDL("id long, canonical_name string, tier string")
    return M.conform(Bound(spark, folder).t.nation.select(F.col("n_nationkey").alias("ID"), F.col("n_name").alias("canonical_name"), "n_regionkey"), want)
