"""Queries: names in texts, the stored index, vector cells, many-source search, ranges, pages, open documents, snapshots and
state over streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import joins as J
from ..operators import names as N
from ..operators import pages as P
from ..operators import snapshots as H
from ..operators import vectors as V
from ..operators.index import WordIndex
from ..operators.storage import new_folder
from ..sources import documents as D
from ..streaming import ingest as I
from ..streaming import stateful as T
from .bindings import Bound, sql
from .q_retrieval import _TOK, BM25, QUERY, rounded
from .q_state import _REPLAY, _STATES
from .registry import query

# names of four tables in texts that hold some of them; NATION_1 stands in NATION_12, and names in the texts' own words
_NAMED = """t as (select doc_id, text || ' ' || coalesce(c_name, '') || ' NATION_' || doc_id % 25 || coalesce(s_name, '') || p_name as text
from documents left join customer on c_custkey = doc_id left join supplier on s_suppkey = doc_id join part on p_partkey = doc_id % (select count(*) from part)),
n as (select c_name as name from customer union select s_name from supplier union select n_name from nation union select p_name from part union select unnest(string_split(p_name, ' ')) from part)"""


def _named(spark, folder):
    t = Bound(spark, folder).t
    docs, parts = t.documents, t.part.count()
    names = docs.join(t.customer.select(F.col("c_custkey").alias("doc_id"), "c_name"), "doc_id", "left").join(t.supplier.select(F.col("s_suppkey").alias("doc_id"), "s_name"), "doc_id", "left")
    names = names.withColumn("p_partkey", F.col("doc_id") % parts).join(t.part.select("p_partkey", "p_name"), "p_partkey")
    text = F.concat("text", F.lit(" "), F.coalesce("c_name", F.lit("")), F.lit(" NATION_"), F.col("doc_id") % 25, F.coalesce("s_name", F.lit("")), "p_name")
    listed = [t.customer.select("c_name"), t.supplier.select("s_name"), t.nation.select("n_name"), t.part.select("p_name"), t.part.select(F.explode(F.split("p_name", " ")))]
    out = listed[0]
    for x in listed[1:]:
        out = out.union(x)
    return names.select("doc_id", text.alias("text")), out.toDF("name")


@query("names_of_tables_D12", f"with {_NAMED} select doc_id, name, cast((length(text) - length(replace(text, name, ''))) // length(name) as bigint) as times, instr(text, name) - 1 as first from t, n where contains(text, name)")
def names_of_tables(spark, folder):
    return N.names_in_texts(*_named(spark, folder), "doc_id", "text")


@query("name_lists_A04_D12", f"with {_NAMED} select doc_id, string_agg(name, '|' order by name) as names from t, n where contains(text, name) group by doc_id")
def name_lists(spark, folder):
    return N.name_lists(*_named(spark, folder), "doc_id", "text").select("doc_id", F.array_join("names", "|").alias("names"))


@query("term_counts_D11", f"with {_NAMED}, own as (select distinct n_regionkey as owner, n_name as name from nation union select distinct r_regionkey, p_name from region, part) select doc_id, count(*) as hits from t, own where contains(text, name) group by doc_id")
def term_counts(spark, folder):
    t = Bound(spark, folder).t
    parts = [r.p_name for r in t.part.select("p_name").distinct().collect()]  # a few hundred combinations of words
    terms = {r.n_regionkey: [*r.names, *parts] for r in t.nation.groupBy("n_regionkey").agg(F.collect_set("n_name").alias("names")).collect()}
    return N.term_counts(_named(spark, folder)[0], terms, "doc_id", "text")


# the stored index: load, change and delete parts of documents in three batches
_FINAL = "documents as (select doc_id, lang, case when doc_id % 3 = 1 then source || ' onea ' || left(text, 200) else text end as text from raw where doc_id % 5 <> 2)"


def _batches(spark, folder, cell_docs=32):
    docs = Bound(spark, folder).t.documents
    index = WordIndex(spark, new_folder(spark), cell_docs)
    index.apply(docs, "doc_id", "text")
    index.apply(docs.filter("doc_id % 3 = 1").select("doc_id", F.concat("source", F.lit(" onea "), F.left("text", F.lit(200))).alias("text")), "doc_id", "text")
    index.apply(docs.filter("doc_id % 5 = 2").select("doc_id", F.lit(None).cast("string").alias("text")), "doc_id", "text")
    return index


def _final(body: str) -> str:
    return f"with raw as (select * from documents), {_FINAL}, {body}"


@query("index_batches_B22", _final(f"{BM25} select doc_id, round(score, 6) as score from bm order by bm.score desc, doc_id limit 20"))
def index_batches(spark, folder):
    """The best of the final texts, from an index that saw each text only in the batch that brought it."""
    return rounded(_batches(spark, folder).search(QUERY, 20).hits.withColumnRenamed("id", "doc_id"), "score")


@query("index_statistics_B22", _final(f"tok as (select {_TOK} as t from documents) select term, n, round(a, 6) as avg_length, df from (select count(*) as n, avg(len(t)) as a from tok), (select term, count(*) as df from (select unnest(list_distinct(t)) as term from tok) where term in ('the', 'onea', 'thing', 'with', 'erand') group by term)"))
def index_statistics(spark, folder):
    n, avg, df = _batches(spark, folder).statistics(["the", "onea", "thing", "with", "erand"])
    return spark.createDataFrame([(t, n, round(avg, 6), f) for t, f in df.items() if f], "term string, n long, avg_length double, df long")


@query("index_merged_B22", _final(f"{BM25} select doc_id, round(score, 6) as score from bm order by bm.score desc, doc_id limit 20"))
def index_merged(spark, folder):
    """The same after the three segments are rewritten into one."""
    index = _batches(spark, folder)
    while index.merge(2):
        pass
    return rounded(index.search(QUERY, 20).hits.withColumnRenamed("id", "doc_id"), "score")


@query("bm25_blockmax_R01", f"with {BM25} select doc_id, round(score, 6) as score from bm order by bm.score desc, doc_id limit 10")
def bm25_blockmax(spark, folder):
    index = WordIndex(spark, new_folder(spark))
    index.apply(Bound(spark, folder).t.documents, "doc_id", "text")
    return rounded(index.search(QUERY, 10).hits.withColumnRenamed("id", "doc_id"), "score")


# vectors: every row whose id is divisible by 50 is a query
_NEAR = """v as (select vec_id, embedding::double[] as e from embeddings), n as (select *, sqrt(list_dot_product(e, e)) as l from v),
s as (select q.vec_id as query_id, d.vec_id as id, list_dot_product(q.e, d.e) / (q.l * d.l) as score from n q, n d where q.vec_id % 50 = 0)"""


def _near(spark, folder):
    vectors = Bound(spark, folder).t.embeddings
    return V.nearest(V.build_index(vectors, "vec_id"), vectors.filter("vec_id % 50 = 0"), 10, "vec_id")


@query("vector_batch_topk_R03", f"with {_NEAR} select query_id, id, round(score, 6) as score from s qualify row_number() over (partition by query_id order by s.score desc, id) <= 10")
def vector_batch_topk(spark, folder):
    return rounded(_near(spark, folder)[0], "score")


@query("vector_cells_read_R03")
def vector_cells_read(spark, folder):
    """(query id, cells read): what the bounds leave to be compared."""
    return _near(spark, folder)[1]


# search from many seeds at once
_REACH = """with u as (select from_entity as a, to_entity as b from links union select to_entity, from_entity from links),
r as (select entity_id as seed, entity_id as id, 0 as hop from aliases where alias = 'NATION_1' union select seed, b, hop + 1 from r join u on a = id where hop < 2),
m as (select seed, id, min(hop) as hop from r group by 1, 2) """


def _seeds(b):
    return b.aliases.filter("alias = 'NATION_1'").select("entity_id")


@query("reach_of_alias_R10", sql(_REACH + "select id, hop, count(*) as seeds from m group by 1, 2").replace("with ", "with recursive ", 1))
def reach_of_alias(spark, folder):
    """For all entities under an alias in one search: how many of them reach a node at which hop."""
    b = Bound(spark, folder)
    found = G.reach(b.links, _seeds(b), 2)
    return found.groupBy("id", "hop").agg(F.sum(F.bit_count("bits")).cast("long").alias("seeds"))


@query("reach_pairs_R10", sql(_REACH + "select seed, id, hop from m").replace("with ", "with recursive ", 1))
def reach_pairs(spark, folder):
    b = Bound(spark, folder)
    return G.reached_pairs(G.reach(b.links, _seeds(b), 2, many_edges=50), _seeds(b))


# ranges of very different width: a point of a line's order, some orders' ranges going over all of them
_WIDE = "select o_orderkey as volume, o_orderkey as first, o_orderkey + case when o_orderkey % 97 = 0 then 1000000000 when o_orderkey % 7 = 0 then 5000 else 3 end as last from orders where o_orderkey % 3 <> 0"


@query("wide_ranges_D15", f"with v as ({_WIDE}), p as (select l_orderkey as chapter, l_linenumber as n from lineitem) select chapter, n, volume, first, last from p join v on chapter between first and last qualify row_number() over (partition by chapter, n order by first desc, volume) = 1")
def wide_ranges(spark, folder):
    t, key = Bound(spark, folder).t, F.col("o_orderkey")
    width = F.when(key % 97 == 0, 1_000_000_000).when(key % 7 == 0, 5000).otherwise(3)
    ranges = t.orders.filter(key % 3 != 0).select(key.alias("volume"), key.alias("first"), (key + width).alias("last"))
    points = t.lineitem.select(F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").alias("n")).distinct()
    return J.containing_range(points, ranges, "chapter", "first", "last", "volume")


# pages of a stored order
_LINES = "(select l_orderkey, l_linenumber, l_extendedprice, row_number() over (order by l_extendedprice desc, l_orderkey, l_linenumber) - 1 as r, count(*) over () as n from lineitem)"


def _pages(spark, folder):
    lines = Bound(spark, folder).t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return P.pages(lines, "l_extendedprice desc", "l_orderkey", "l_linenumber", range_rows=5000)


@query("stored_pages_T13", f"select page, l_orderkey, l_linenumber, l_extendedprice from {_LINES}, (values (1), (2), (3)) t(page) where r // 50 = case page when 1 then 0 when 2 then ((n + 49) // 50) // 2 - 1 else (n + 49) // 50 - 1 end")
def stored_pages(spark, folder):
    """The first, the middle and the last page of 50."""
    stored = _pages(spark, folder)
    last = stored.count(50)
    got = [stored.page(number, 50).withColumn("page", F.lit(k + 1)) for k, number in enumerate((1, last // 2, last))]
    return got[0].unionByName(got[1]).unionByName(got[2])


@query("seek_page_T13", f"select l_orderkey, l_linenumber, l_extendedprice from {_LINES} where r > n // 2 and r <= n // 2 + 50")
def seek_page(spark, folder):
    """The 50 rows behind the one in the middle."""
    stored = _pages(spark, folder)
    at = stored.total // 2
    row = stored.page(at + 1, 1).first()
    return stored.after((row.l_extendedprice, row.l_orderkey, row.l_linenumber), 50)


# open documents under two shapes, an unknown section in each
def _shapes(spark, folder):
    e = Bound(spark, folder).t.events
    record = F.to_json(F.struct(F.concat(F.lit("e"), "user_id").alias("id"), F.col("event_type").alias("kind")))
    tail = F.concat(F.lit(', "props": '), "props", F.lit(', "extra": {"value": '), "value", F.lit("}}"))
    new = F.concat(F.lit('{"entities": {"e'), "user_id", F.lit('": '), record, F.lit("}"), tail)
    old = F.concat(F.lit('{"entities": ['), record, F.lit(", "), record, F.lit(', {"kind": "nameless"}]'), tail)
    text = F.when(F.col("event_id") % 7 == 6, F.lit('{"entities": [')).when(F.col("event_id") % 2 == 0, new).otherwise(old)
    return e.select("event_id", text.alias("doc"))


_RULES = [D.Keyed("entities"), D.Typed("version", "int")]


@query("open_documents_A05_Y16", """select event_id, 'e' || user_id as id, event_type as kind, cast(json_extract_string(props, '$.k') as bigint) as k, round(value, 4) as value, null::int as version from events where event_id % 7 <> 6
union all select event_id, '#2', 'nameless', cast(json_extract_string(props, '$.k') as bigint), round(value, 4), null from events where event_id % 7 <> 6 and event_id % 2 = 1""")
def open_documents(spark, folder):
    fine, _ = D.open_documents(_shapes(spark, folder), "doc", _RULES)
    flat = fine.select("event_id", "version", "rest", F.explode("entities").alias("id", "record"))
    value = F.round(F.try_variant_get(F.col("rest")["extra"], "$.value", "double"), 4)
    return flat.select("event_id", "id", F.try_variant_get("record", "$.kind", "string").alias("kind"), F.try_variant_get(F.col("rest")["props"], "$.k", "bigint").alias("k"), value.alias("value"), "version")


@query("rejected_documents_A05", "select event_id from events where event_id % 7 = 6")
def rejected_documents(spark, folder):
    return D.open_documents(_shapes(spark, folder), "doc", _RULES)[1].select("event_id")


@query("document_schema_A05", "select 'OBJECT<' || string_agg(distinct k || ': BIGINT', ', ') || '>' as schema from (select unnest(json_keys(props)) as k from events)")
def document_schema(spark, folder):
    return D.document_schema(Bound(spark, folder).t.events, "props")


# nested answers: two levels, repeated tags, every fifth turn cut off
_ANSWER = "answer"
_SCHEMA = "verdict string, part array<struct<_n: int, issue: array<struct<_VALUE: string, _level: string>>>>"


def _answers(spark, folder):
    c = Bound(spark, folder).t.conversations
    word = lambda k: F.get(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)), F.lit(k))  # noqa: E731  # null behind the last word
    issue = lambda k, level: F.concat(F.lit(f"<issue{level}>"), F.coalesce(word(k), F.lit("none")), F.lit("</issue>"))
    high = ' level="high"'
    body = F.concat(
        F.lit("Here it is:\n<answer><verdict>"), "role", F.lit('</verdict><part n="'), "turn", F.lit('">'), issue(0, high), issue(1, ""), F.lit('</part><part n="'), F.col("turn") + 1, F.lit('">'), issue(2, high),
        F.when(F.col("turn") % 5 == 4, F.lit("</answer>")).otherwise(F.lit("</part></answer>\nDone.")),
    )
    return c.select("conv_id", "turn", body.alias("text"))


_WORDS = "(select conv_id, turn, role, regexp_extract_all(text, '[a-z]+') as w from conversations)"


@query("nested_answers_K10", f"""select conv_id, turn, role as verdict, cast(turn + d as int) as part, level, coalesce(w[k], 'none') as issue from {_WORDS}, (values (0, 'high', 1), (0, null, 2), (1, 'high', 3)) t(d, level, k) where turn % 5 <> 4""")
def nested_answers(spark, folder):
    fine, _ = D.xml_answers(_answers(spark, folder), "text", _ANSWER, _SCHEMA)
    parts = fine.select("conv_id", "turn", "answer.verdict", F.explode("answer.part").alias("p"))
    return parts.select("conv_id", "turn", "verdict", F.col("p._n").alias("part"), F.explode("p.issue").alias("i")).select("conv_id", "turn", "verdict", "part", F.col("i._level").alias("level"), F.col("i._VALUE").alias("issue"))


@query("malformed_answers_K10", "select conv_id, turn from conversations where turn % 5 = 4")
def malformed_answers(spark, folder):
    return D.xml_answers(_answers(spark, folder), "text", _ANSWER, _SCHEMA)[1].select("conv_id", "turn")


# snapshots
@query("snapshots_B33_Y25", "select cast(s_nationkey % 3 as bigint) as chapter, 'v' || case when s_nationkey % 3 = 0 then 2 else 1 end as version, s_suppkey, s_name || case when s_nationkey % 3 = 0 then ' again' else '' end as s_name from supplier where s_nationkey % 3 <> 1")
def snapshots(spark, folder):
    """A copy a chapter; one is replaced under a new version, one deleted; what is listed is loaded."""
    path, s = new_folder(spark), Bound(spark, folder).t.supplier
    for chapter in range(3):
        H.save_snapshot(s.filter(F.col("s_nationkey") % 3 == chapter).select("s_suppkey", "s_name"), path, "v1", chapter)
    H.save_snapshot(s.filter(F.col("s_nationkey") % 3 == 0).select("s_suppkey", F.concat("s_name", F.lit(" again")).alias("s_name")), path, "v2", 0)
    H.delete_snapshot(spark, path, 1)
    try:
        H.load_snapshot(spark, path, "v1", 0)
        raise AssertionError("a copy of another version was loaded")
    except H.VersionMismatch:
        pass
    out = None
    for chapter, version in H.list_snapshots(spark, path):
        got = H.load_snapshot(spark, path, version, chapter).select(F.lit(chapter).cast("long").alias("chapter"), F.lit(version).alias("version"), "s_suppkey", "s_name")
        out = got if out is None else out.unionByName(got)
    return out


# state over streams, stopped and started again between three turns
@query("streamed_tasks_Y33", _STATES)
def streamed_tasks(spark, folder):
    """A task's events come in three turns by their number, so a turn goes on where the one before stopped."""
    kind = F.when(F.col("turn") == 0, "start").when(F.col("role") == "user", "step").otherwise("done")
    c = Bound(spark, folder).t.conversations
    events = c.select(F.col("conv_id").cast("long").alias("task"), F.col("turn").cast("long").alias("n"), kind.alias("event"), F.floor((F.col("turn") + 1) / 2).cast("string").alias("step"))
    turns = [events.filter("n < 2"), events.filter("n between 2 and 4"), events.filter("n > 4")]
    return T.run_in_turns(spark, turns, "task", T.Tasks, new_folder(spark))


@query("streamed_ledger_L04", _REPLAY)
def streamed_ledger(spark, folder):
    """Events are dealt to three turns by their content: most debts get some that belong before what has been folded."""
    b = Bound(spark, folder)
    pays = b.debt_events.groupBy("debt_id", "chapter").agg((F.sum(F.col("amount").cast("decimal(18,2)")).cast("double") / 10).alias("amount")).select("debt_id", "chapter", F.lit("payment").alias("kind"), F.lit(2).cast("long").alias("id"), "amount")
    interest = b.debts.select(F.col("id").alias("debt_id"), F.col("due_chapter").alias("chapter"), F.lit("interest").alias("kind"), F.lit(1).cast("long").alias("id"), F.col("interest_rate").alias("amount"))
    created = b.debts.select(F.col("id").alias("debt_id"), F.col("source_chapter").alias("chapter"), F.lit("created").alias("kind"), F.lit(0).cast("long").alias("id"), F.col("original_amount").alias("amount"))
    events = pays.unionByName(interest).unionByName(created)
    turn = F.pmod(F.xxhash64("debt_id", "chapter", "kind"), F.lit(3))
    got = T.run_in_turns(spark, [events.filter(turn == k) for k in range(3)], "debt_id", T.Ledger, new_folder(spark))
    return got.select("id", F.round("balance", 2).alias("balance"), "n_events")


@query("notified_Y36", "select distinct 'user-' || user_id as path from events")
def notified(spark, folder):
    """Changed names through a stream, sent in calls of at most 64 names; every name is sent."""
    path, sent = new_folder(spark), []
    Bound(spark, folder).t.events.select(F.concat(F.lit("user-"), "user_id").alias("path")).write.parquet(f"{path}/in")
    I.notify(spark.readStream.schema("path string").parquet(f"{path}/in"), sent.extend, f"{path}/{uuid.uuid4().hex}").awaitTermination()
    return spark.createDataFrame([(x,) for x in sent], "path string").distinct()
