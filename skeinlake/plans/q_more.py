"""Queries: further mutations, reports and supporting operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import health as K
from ..operators import joins as J
from ..operators import lookup as L
from ..operators import reports as P
from ..operators import retrieval as R
from ..operators import upsert as B
from ..sources import files as S
from .bindings import Bound, sql
from .q_lookup import simple
from .q_retrieval import COS, _qvec, _vectors, rounded
from .q_state import _threads
from .registry import ORACLES, query


@query("merged_attributes_B06_Y11", "select c_custkey as id, c_mktsegment as segment, case when c_acctbal > 0 then 'yes' else 'no' end as solvent, 'kept' as note from customer")
def merged_attributes(spark, folder):
    c = Bound(spark, folder).t.customer
    old = c.select(F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("last_appearance"), F.create_map(F.lit("segment"), F.lit("old"), F.lit("note"), F.lit("kept")).alias("current"))
    new = c.select(F.col("c_custkey").alias("id"), F.lit(1).cast("long").alias("last_appearance"), F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("solvent"), F.when(F.col("c_acctbal") > 0, "yes").otherwise("no")).alias("current"))
    got = B.upsert_entities(old, new, [])
    return got.select("id", *[F.col("current")[k].alias(k) for k in ("segment", "solvent", "note")])


simple("appended_changes_B09", lambda b: B.append_all([b.state_changes, b.t.orders.select((F.col("o_orderkey") + 10_000_000).alias("id"), F.col("o_custkey").alias("entity_id"), F.lit("order").alias("field"), F.col("o_totalprice").alias("new_value"), F.lit(99).cast("long").alias("chapter"))]),
       "select * from state_changes union all select o_orderkey + 10000000, o_custkey, 'order', o_totalprice, 99 from orders")
simple("saved_reading_power_B15", lambda b: B.latest_wins(b.t.lineitem.select(F.col("l_partkey").alias("chapter"), F.col("l_shipdate").alias("at"), F.col("l_returnflag").alias("hook")).distinct(), ["chapter"], ["at", "hook"]), "select distinct l_partkey as chapter, l_shipdate as at, l_returnflag as hook from lineitem qualify row_number() over (partition by l_partkey order by l_shipdate desc, l_returnflag desc) = 1")
simple("saved_checklist_B17", lambda b: B.latest_wins(b.t.orders.select(F.col("o_custkey").alias("chapter"), "o_orderdate", "o_orderkey", F.col("o_totalprice").alias("score")), ["chapter"], ["o_orderdate", "o_orderkey"]), "select o_custkey as chapter, o_orderdate, o_orderkey, o_totalprice as score from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
simple("marked_facts_B18", lambda b: B.append_all([b.invalid_facts, b.t.documents.filter("n_chars < 100").select(F.col("doc_id").alias("source_id"), F.lit("pending").alias("status"))]), "select * from invalid_facts union all select doc_id, 'pending' from documents where n_chars < 100")
simple("call_log_B20", lambda b: b.tool_calls.groupBy("tool_name").agg(F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("failed")), "select tool_name, count(*) as calls, count(*) filter (not success) as failed from tool_calls group by 1")
simple("postings_B21_B22", lambda b: R.postings(b.t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("text").alias("content")))[0].select("chunk_id", "term", F.round("tf", 6).alias("tf")),
       "select id as chunk_id, term, round(count(*) * 1.0 / n, 6) as tf from (select conv_id * 1000 + turn as id, unnest(t) as term, len(t) as n from (select conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') as t from conversations)) group by id, term, n")
simple("document_lengths_B22", lambda b: R.postings(b.t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("text").alias("content")))[1], "select conv_id * 1000 + turn as chunk_id, len(regexp_extract_all(lower(text), '[a-z]+')) as doc_length from conversations")
simple("added_samples_B23_D09", lambda b: B.insert_if_absent(b.samples.filter("score < 950"), b.samples.withColumn("content", F.lit("late")), ["id"]), "select id, scene_type, case when score < 950 then content else 'late' end as content, score from samples")
simple("strand_history_B31", lambda b: P.strand_tracker(b.t.events.select("user_id", F.col("event_id").alias("chapter"), F.col("event_type").alias("dominant")), "user_id", keep=20).select("user_id", "chapter", F.col("run").cast("long").alias("run")),
       "select user_id, event_id as chapter, row_number() over (partition by user_id, event_type, g order by event_id) as run from (select *, row_number() over (partition by user_id order by event_id) - row_number() over (partition by user_id, event_type order by event_id) as g from events) qualify row_number() over (partition by user_id order by event_id desc) <= 20")
simple("fulfilled_B13", lambda b: P.fulfill(b.contracts.select("id", "status", F.lit(None).cast("int").alias("fulfilled_at")), b.t.orders.filter("o_totalprice > 400000").select(F.col("o_orderkey").alias("id")), F.lit(7)), "select id, case when id in (select o_orderkey from orders where o_totalprice > 400000) then 'fulfilled' else status end as status, case when id in (select o_orderkey from orders where o_totalprice > 400000) then 7 end as fulfilled_at from contracts")
simple("created_debts_B14", lambda b: P.create_debts(b.debts.select("id", "original_amount", "source_chapter", "override_contract_id"))[0].select("id", "current_amount", "status", "override_contract_id"), "select id, original_amount as current_amount, 'active' as status, nullif(override_contract_id, 0) as override_contract_id from debts")
simple("created_events_B14_L03", lambda b: P.create_debts(b.debts.select("id", "original_amount", "source_chapter", "override_contract_id"))[1], "select id as debt_id, 'created' as event_type, original_amount as amount, source_chapter as chapter from debts")
simple("thread_order_T12", lambda b: K.threads(_threads(b), 24000).select("content", "urgency").orderBy(F.col("urgency").desc_nulls_last(), "content").limit(30), "select id as content, round(greatest(0, 24000 - chapter) / 63 * case constraint_type when '1-URGENT' then 3.0 when '2-HIGH' then 2.0 else 1.0 end, 2) as urgency from contracts where status = 'pending' order by urgency desc, content limit 30")
simple("basic_stats_K05", lambda b: P.basic_stats(b.chapters, 1_000_000), "select count(*) as chapters, cast(sum(word_count) as bigint) as words, round(sum(word_count) / count(*), 2) as words_per_chapter, round(sum(word_count) * 100.0 / 1000000, 2) as completion from chapters")
simple("quality_report_K08", lambda b: P.quality_report(b.reviews, b.checklists, 12)["risks"].select("overall_avg", "checklist_avg", F.array_join("flags", ",").alias("flags")),
       "select o as overall_avg, c as checklist_avg, coalesce(nullif(concat_ws(',', case when o < 75 then 'low_overall' end, case when c < 80 then 'low_checklist' end, case when d < 0.7 then 'low_completion' end), ''), 'stable') as flags from (select (select round(avg(overall_score), 2) from (select * from reviews order by end_chapter desc limit 12)) as o, (select round(avg(score), 2) from (select * from checklists order by chapter desc limit 12)) as c, (select round(avg(completion_rate), 4) from (select * from checklists order by chapter desc limit 12)) as d)")
simple("low_reviews_X09", lambda b: P.reader_signal(b.reading_power, b.reviews, 40, 50.0)["low"].select("end_chapter"), "select end_chapter from (select * from reviews order by end_chapter desc limit 40) where overall_score < 50")
simple("copied_fields_X17", lambda b: P.copy_fields(b.entities.select("id", "tier"), b.t.events.groupBy(F.col("user_id").alias("id")).agg(F.max("event_type").alias("kind")), "id", {"tier": "kind"}), "select e.id, coalesce(k.kind, e.tier) as tier from entities e left join (select user_id as id, max(event_type) as kind from events group by 1) k on k.id = e.id")
simple("archived_entities_Y20", lambda b: P.auto_archive(0, 24010, b.entities, _threads(b).withColumn("resolved_chapter", F.col("planted_chapter")), b.contracts.select("id", F.col("due_chapter").cast("string").alias("chapters")))["entities"][1].select("id"), "select id from entities where not is_archived and tier <> 'core' and last_appearance > 0 and 24010 - last_appearance >= 50")
simple("archived_threads_Y20_K13", lambda b: P.auto_archive(0, 24010, b.entities, _threads(b).withColumn("resolved_chapter", F.col("planted_chapter")), b.contracts.select("id", F.col("due_chapter").cast("string").alias("chapters")))["threads"][1].select("content"), "select id as content from contracts where status = 'fulfilled' and 24010 - chapter >= 20")
simple("recent_meta_Y24", lambda b: P.recent_meta(b.t.documents.select(F.lpad(F.col("doc_id").cast("string"), 4, "0").alias("key"), "lang"), 60, 5).select("chapter", "lang"), "select doc_id as chapter, lang from documents where doc_id >= 55 and doc_id < 60")
simple("opening_texts_Y37", lambda b: P.opening_texts(b.chapters.select("chapter", F.col("summary").alias("text"))).select("chapter", F.col("chars").cast("long").alias("chars"), "prompt_text"), "select chapter, length(regexp_replace(summary, '\\s+', '', 'g')) as chars, left(summary, 6000) as prompt_text from chapters order by chapter limit 3")
simple("titles_Y29", lambda b: b.t.pages.select("page_id", P.file_title(F.concat("page_id", F.lit("_title.md")), F.lit(None).cast("string")).alias("title")), "select page_id, 'title' as title from pages")
simple("meta_entry_F13", lambda b: b.t.customer.select("c_custkey", P.meta_entry(F.create_map(F.lit("0007"), F.col("c_name"), F.lit("12"), F.col("c_mktsegment")), 7).alias("m"), P.meta_entry(F.create_map(F.lit("00012"), F.col("c_name")), 12).alias("n")), "select c_custkey, c_name as m, c_name as n from customer")
simple("seeds_by_alias_R08_R09", lambda b: b.entities.sparkSession.createDataFrame([(i,) for i in R.seed_entities("NATION_1 or NATION_2", b.entities, b.aliases, cap=b.entities.count())], "id long"), "select id from entities where id in (select entity_id from aliases where alias in ('NATION_1', 'NATION_2'))")
simple("first_alias_match_X15", lambda b: J.by_alias(b.entities.select("id", "type"), b.aliases).groupBy("alias").agg(F.min("id").alias("id")), "select alias, min(entity_id) as id from aliases group by alias")


@query("backtrack_R12_Y04", sql("""
with tf as (select conv_id, turn, len(t) as l, t from (select conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') as t from conversations)),
c as (select count(*) as n, avg(l) as a from tf), q as (select unnest(['the', 'thing', 'with']) as term),
h as (select conv_id, turn, l, term, len(list_filter(t, lambda x: x = term)) * 1.0 / l as tf from tf, q where l > 0 and list_contains(t, term)), df as (select term, count(*) as df from h group by term),
s as (select conv_id * 1000 + turn as id, conv_id * 1000 as parent, turn, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))) as score from h join df using (term), c where turn > 0 group by 1, 2, 3),
k as (select *, row_number() over (order by round(score, 9) desc, id) - 1 as r from s qualify r < 5), p as (select parent as id, min(r) as r from k group by 1)
select id, kind, row_number() over (order by r, o) as position from (select id, r, 0 as o, 'parent' as kind from p union all select id, r, 1 as o, 'hit' as kind from k)"""))
def backtrack(spark, folder):
    c = Bound(spark, folder).t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), (F.col("conv_id") * 1000).alias("parent_chunk_id"), "turn", F.col("text").alias("content"))
    hits = R.bm25(c, "the thing with", 5, keep=F.col("turn") > 0).withColumn("score", F.round("score", 9))
    from ..operators.windows import ranks

    ranked = ranks(hits, "score", "chunk_id").join(c.select("chunk_id", "parent_chunk_id"), "chunk_id")
    return J.parents_first(ranked, c.filter("turn = 0").select("chunk_id")).withColumnRenamed("chunk_id", "id").withColumn("position", F.col("position").cast("long"))


@query("scene_search_R12", ORACLES["backtrack_R12_Y04"].replace("'hit' as kind", "'bm25' as kind"))
def scene_search(spark, folder):
    """Turns after the first are scenes, the first is their parent; without vectors."""
    c = Bound(spark, folder).t.conversations
    kind = F.when(F.col("turn") > 0, "scene").otherwise("summary")
    docs = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), (F.col("conv_id") * 1000).alias("parent_chunk_id"), kind.alias("chunk_type"), F.col("text").alias("content"))
    got = R.backtrack(docs, docs.select("chunk_id").limit(0), "the thing with", None, 5, parents=docs.filter("chunk_type = 'summary'"))
    return got.select(F.col("chunk_id").alias("id"), F.col("source").alias("kind"), F.col("position").cast("long").alias("position"))


@query("candidates_by_ids_Y02", "select vec_id, label from embeddings where vec_id in (select doc_id from documents where lang = 'de')")
def candidates_by_ids(spark, folder):
    b = Bound(spark, folder)
    return L.by_ids(b.t.embeddings.select("vec_id", "label"), b.t.documents.filter("lang = 'de'").select("doc_id"), "vec_id")


@query("vectors_by_ids_Y02", f"with {COS} select doc_id, round(score, 6) as score from cs where doc_id in (select doc_id from documents where lang = 'de') order by cs.score desc, doc_id limit 10")
def vectors_by_ids(spark, folder):
    """The nearest vectors among listed ids."""
    ids = Bound(spark, folder).t.documents.filter("lang = 'de'").select("doc_id")
    pool = L.by_ids(_vectors(spark, folder), ids, "doc_id")
    return rounded(R.vector_search(pool, _qvec(spark, folder), 10, "doc_id"), "score")


@query("vector_count_Y05", "select count(*) as n, count(*) <= 500 as full_scan from embeddings")
def vector_count(spark, folder):
    return Bound(spark, folder).t.embeddings.agg(F.count("*").alias("n")).withColumn("full_scan", F.col("n") <= 500)


@query("embedded_A09_A10", "select conv_id, turn, case when length(text) % 2 = 0 then 2 end as width from conversations")
def embedded(spark, folder):
    """A stand-in service that fails on odd lengths: failed items are null at their places."""

    def service():
        return lambda texts: [[1.0, float(len(t))] if len(t) % 2 == 0 else None for t in texts]

    got = S.embed(Bound(spark, folder).t.conversations, service, ["conv_id", "turn"], "text")
    return got.select("conv_id", "turn", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("width"))


@query("rejected_payloads_A14", "select event_id from events where event_type = 'error'")
def rejected_payloads(spark, folder):
    e = Bound(spark, folder).t.events
    raw = e.select(F.when(F.col("event_type") == "error", F.concat(F.lit("{broken "), "event_id")).otherwise(F.to_json(F.struct((F.col("event_id") + 1).alias("chapter")))).alias("value"))
    return S.payloads(raw)[1].select(F.regexp_extract("raw", r"(\d+)", 1).cast("long").alias("event_id"))


@query("missing_table_C27", "select 'region' as name, count(*) as n from region union all select 'supplier', count(*) from supplier union all select 'debts', 0")
def missing_table(spark, folder):
    """Rows of two tables that are there and of one that isn't but has a record type."""
    frames = [S.table(spark, folder, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name in ("region", "supplier", "debts")]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("protagonist_id_G04", sql("select min(id) as id from entities where is_protagonist"))
def protagonist_id(spark, folder):
    b = Bound(spark, folder)
    return spark.createDataFrame([(G.protagonist(b.entities, b.aliases),)], "id long")
