"""Queries: retrieval and graphs (families R, G, Y-02..Y-05)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import lookup as L
from ..operators import retrieval as R
from ..sources.files import lexical_reranker
from .bindings import Bound, sql
from .registry import query

QUERY = "the onea thing with erand"
_TOK = "list_concat(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]'), regexp_extract_all(lower(text), '[a-z]+'))"
BM25 = f"""
tok as (select doc_id, lang, {_TOK} as t from documents), lens as (select doc_id, lang, t, len(t) as l from tok),
c as (select count(*) as n, avg(l) as a from lens), q as (select unnest(['the', 'onea', 'thing', 'with', 'erand']) as term),
tf as (select doc_id, lang, l, term, len(list_filter(t, lambda x: x = term)) * 1.0 / l as tf from lens, q where l > 0 and list_contains(t, term)),
df as (select term, count(*) as df from tf group by term),
bm as (select doc_id, lang, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))) as score from tf join df using (term), c group by doc_id, lang)"""
_QV = "q0 as (select embedding::double[] as v from embeddings where vec_id = 0)"
COS = f"""{_QV}, cs as (select vec_id as doc_id, list_dot_product(embedding::double[], v) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(v, v))) as score from embeddings, q0)"""


def _docs(spark, folder):
    return Bound(spark, folder).t.documents


def _vectors(spark, folder):
    return Bound(spark, folder).t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")


def _qvec(spark, folder):
    row = Bound(spark, folder).t.embeddings.filter("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]] if row else []


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("bm25_topk_R01", f"with {BM25} select doc_id, round(score, 6) as score from bm order by bm.score desc, doc_id limit 10")
def bm25_topk(spark, folder):
    return rounded(R.bm25(_docs(spark, folder), QUERY, 10, "doc_id", "text"), "score")


@query("bm25_filtered_R01", f"with {BM25} select doc_id, round(score, 6) as score from bm where lang = 'de' order by bm.score desc, doc_id limit 10")
def bm25_filtered(spark, folder):
    return rounded(R.bm25(_docs(spark, folder), QUERY, 10, "doc_id", "text", F.col("lang") == "de"), "score")


@query("bm25_indexed_D02", f"with {BM25} select doc_id, round(score, 6) as score from bm order by bm.score desc, doc_id limit 20")
def bm25_indexed(spark, folder):
    post, stats = R.postings(_docs(spark, folder), "doc_id", "text")
    return rounded(R.bm25_indexed(post, stats, QUERY, 20), "score").withColumnRenamed("chunk_id", "doc_id")


@query("corpus_stats_E11", f"select count(*) as n, round(avg(l), 6) as avg_length from (select len({_TOK}) as l from documents)")
def corpus_stats(spark, folder):
    return rounded(R.corpus_stats(R.postings(_docs(spark, folder), "doc_id", "text")[1]), "avg_length")


@query("vector_topk_R02", f"with {COS} select doc_id, round(score, 6) as score from cs order by cs.score desc, doc_id limit 10")
def vector_topk(spark, folder):
    return rounded(R.vector_search(_vectors(spark, folder), _qvec(spark, folder), 10, "doc_id"), "score")


@query("vector_candidates_R03", f"with {COS} select doc_id, round(score, 6) as score from cs where doc_id in (select doc_id from labels where quality = 1) order by cs.score desc, doc_id limit 10")
def vector_candidates(spark, folder):
    ids = Bound(spark, folder).t.labels.filter("quality = 1").select("doc_id")
    return rounded(R.vector_search(_vectors(spark, folder).join(ids, "doc_id", "left_semi"), _qvec(spark, folder), 10, "doc_id"), "score")


_RRF = f"""with {BM25}, {COS},
bk as (select doc_id, score, row_number() over (order by score desc, doc_id) as r from bm qualify r <= 20),
vk as (select doc_id, score, row_number() over (order by score desc, doc_id) as r from cs qualify r <= 30),
f as (select coalesce(b.doc_id, v.doc_id) as doc_id, coalesce(1.0 / (60 + v.r), 0.0) + coalesce(1.0 / (60 + b.r), 0.0) as rrf, coalesce(v.score, b.score) as score, case when v.score is not null then 'vector' else 'bm25' end as source from bk b full join vk v on b.doc_id = v.doc_id)
"""


@query("rrf_R05", _RRF + "select doc_id, round(rrf, 6) as rrf from f order by f.rrf desc, doc_id limit 20")
def rrf_fusion(spark, folder):
    near = R.vector_search(_vectors(spark, folder), _qvec(spark, folder), 30, "doc_id")
    words = R.bm25(_docs(spark, folder), QUERY, 20, "doc_id", "text")
    return rounded(R.rrf({"vector": near, "bm25": words}, 20, "doc_id").select("doc_id", "rrf"), "rrf")


@query("hybrid_R04", _RRF + "select doc_id, round(score, 6) as score, source from f order by f.rrf desc, doc_id limit 10")
def hybrid(spark, folder):
    got = R.hybrid(_docs(spark, folder), _vectors(spark, folder), QUERY, _qvec(spark, folder), doc_id="doc_id", text="text", full_scan=True)
    return rounded(got.drop("rrf"), "score")


#: The best 200 by words and the latest 200 documents, as the operator's constants say.
_POOL = f"""with {BM25}, {COS}, pool as ((select doc_id from bm order by score desc, doc_id limit 200) union (select doc_id from documents order by doc_id desc limit 200)),
bk as (select doc_id, score, row_number() over (order by score desc, doc_id) as r from bm qualify r <= 20),
vk as (select doc_id, score, row_number() over (order by score desc, doc_id) as r from cs where doc_id in (select doc_id from pool) qualify r <= 30),
f as (select coalesce(b.doc_id, v.doc_id) as doc_id, coalesce(1.0 / (60 + v.r), 0.0) + coalesce(1.0 / (60 + b.r), 0.0) as rrf, coalesce(v.score, b.score) as score, case when v.score is not null then 'vector' else 'bm25' end as source from bk b full join vk v on b.doc_id = v.doc_id)
"""


@query("hybrid_prefiltered_R04", _POOL + "select doc_id, round(score, 6) as score, source from f order by f.rrf desc, doc_id limit 10")
def hybrid_prefiltered(spark, folder):
    got = R.hybrid(_docs(spark, folder), _vectors(spark, folder), QUERY, _qvec(spark, folder), doc_id="doc_id", text="text", full_scan=False)
    return rounded(got.drop("rrf"), "score")


@query("hybrid_reranked_R04_A11", _RRF + ", c20 as (select * from f order by rrf desc, doc_id limit 20), s as (select c20.doc_id, len(list_intersect(list_distinct(t), ['the', 'onea', 'thing', 'with', 'erand'])) / 5.0 as score from c20 join tok on tok.doc_id = c20.doc_id) select doc_id, round(score, 6) as score, 'rerank' as source from s order by s.score desc, doc_id limit 10")
def hybrid_reranked(spark, folder):
    docs = _docs(spark, folder)
    got = R.hybrid(docs, _vectors(spark, folder), QUERY, _qvec(spark, folder), doc_id="doc_id", text="text", full_scan=True, rerank=lexical_reranker(QUERY, docs, "doc_id", "text"))
    return rounded(got, "score")


@query("hybrid_rerank_failed_R04_A11", _RRF + "select doc_id, round(score, 6) as score, source from f order by f.rrf desc, doc_id limit 10")
def hybrid_rerank_failed(spark, folder):
    """A reranking service that breaks on its first row."""
    breaks = lambda hits: hits.select("doc_id", F.raise_error(F.lit("no service")).cast("double").alias("score"))
    got = R.hybrid(_docs(spark, folder), _vectors(spark, folder), QUERY, _qvec(spark, folder), doc_id="doc_id", text="text", rerank=breaks)
    return rounded(got.drop("rrf"), "score")


def _search(spark, folder, strategy, k=10, **more):
    return rounded(R.search(_docs(spark, folder), _vectors(spark, folder), QUERY, _qvec(spark, folder), k, strategy, doc_id="doc_id", text="text", at="doc_id", **more), "score")


@query("search_bm25_to_chapter_R11", f"with {BM25} select doc_id, round(score, 6) as score, 'bm25' as source from bm where doc_id <= 150 order by bm.score desc, doc_id limit 10")
def search_bm25(spark, folder):
    return _search(spark, folder, "bm25", filters={"to_chapter": 150})


@query("search_vector_to_chapter_R11", f"with {COS} select doc_id, round(score, 6) as score, 'vector' as source from cs where doc_id in (select doc_id from documents where doc_id <= 150) order by cs.score desc, doc_id limit 10")
def search_vector(spark, folder):
    return _search(spark, folder, "vector", chapter=150)


@query("search_unknown_strategy_R11", _RRF.replace("qualify r <= 20", "qualify r <= 7").replace("qualify r <= 30", "qualify r <= 7") + "select doc_id, round(score, 6) as score, source from f order by f.rrf desc, doc_id limit 7")
def search_unknown(spark, folder):
    return _search(spark, folder, "no such", 7)


@query("search_auto_to_chapter_R11", _RRF.replace("from bm qualify r <= 20", "from bm where doc_id <= 150 qualify r <= 10").replace("from cs qualify r <= 30", "from cs where doc_id in (select doc_id from documents where doc_id <= 150) qualify r <= 10") + "select doc_id, round(score, 6) as score, source from f order by f.rrf desc, doc_id limit 10")
def search_auto(spark, folder):
    return _search(spark, folder, "auto", filters={"to_chapter": "150"})


@query("hybrid_without_vector_Y07", f"with {BM25} select doc_id, round(score, 6) as score, 'bm25' as source from bm order by bm.score desc, doc_id limit 10")
def hybrid_without_vector(spark, folder):
    return rounded(R.hybrid(_docs(spark, folder), _vectors(spark, folder), QUERY, None, doc_id="doc_id", text="text", full_scan=True), "score")


_SEEDS, _RELATED = ["idiot", "clown"], ["the and", "loser"]


@query("graph_priors_R07", """select doc_id, round(least(1.0, n_chars / 5000.0) + case when contains(text, 'idiot') or contains(text, 'clown') then 0.2 when contains(text, 'the and') or contains(text, 'loser') then 0.1 else 0.0 end
+ 0.05 * greatest(0.0, 1 - least(abs(150 - doc_id), 100) / 100), 6) as score from documents""")
def graph_priors(spark, folder):
    base = F.least(F.lit(1.0), F.col("n_chars") / 5000.0)
    return _docs(spark, folder).select("doc_id", F.round(R.graph_priors(base, F.col("text"), _SEEDS, _RELATED, F.col("doc_id"), F.lit(150)), 6).alias("score"))


@query("seed_entities_R08_R09", sql("select id from (select entity_id as id, 0 as o from aliases where alias = 'NATION_2' union all select entity_id, 1 from aliases where alias = 'NATION_1') order by o, id limit 30"))
def seed_entities(spark, folder):
    b = Bound(spark, folder)
    return spark.createDataFrame([(i,) for i in R.seed_entities("between NATION_2 and NATION_1", b.entities, b.aliases)], "id long")


#: The base list, up to 30 nodes of the centre's latest 200 edges, their names and aliases, the chunks that hold these,
#: cosine with the bonuses, the higher score of each, reranked by the share of the query's words.
_GRAPH = sql(_RRF.strip() + """,
base as (select doc_id, score from f order by rrf desc, doc_id limit 20),
se as (select from_entity, to_entity, row_number() over (order by chapter desc, from_entity, to_entity, type) as r from links where from_entity = 8 or to_entity = 8 qualify r <= 200),
nd as (select x, min(p) as p from (select from_entity as x, 2 * r as p from se union all select to_entity, 2 * r + 1 from se union all select 8, 0) group by x),
ex as (select x from nd order by p limit 30),
tm as (select id as x, canonical_name as term from entities where id in (select x from ex) union select entity_id, alias from aliases where entity_id in (select x from ex)),
ch as (select d.doc_id, concat_ws(' ', d.text, e.canonical_name) as t from documents d left join entities e on e.id = d.doc_id),
nm as (select doc_id, t from (select doc_id, t, count(*) as h from ch join tm on contains(t, term) group by doc_id, t) order by h desc, doc_id desc limit 200),
nr as (select nm.doc_id, t, cs.score from nm join cs on cs.doc_id = nm.doc_id order by cs.score desc, nm.doc_id limit 40),
pr as (select doc_id, score + case when (select count(*) from tm where x = 8 and contains(t, term)) > 0 then 0.2 when (select count(*) from tm where contains(t, term)) > 0 then 0.1 else 0.0 end
+ 0.05 * greatest(0.0, 1 - least(abs((select max(doc_id) from documents) - doc_id), 100) / 100.0) as score from nr),
mg as (select doc_id, max(score) as score from (select * from base union all select * from pr) group by doc_id),
best as (select doc_id from mg order by score desc, doc_id limit 30),
rr as (select best.doc_id, len(list_intersect(list_distinct(t), ['the', 'onea', 'thing', 'with', 'erand'])) / 5.0 as score from best join tok on tok.doc_id = best.doc_id)
select doc_id, round(score, 6) as score from rr order by rr.score desc, doc_id limit 10""")


@query("graph_hybrid_R06", _GRAPH)
def graph_hybrid(spark, folder):
    """Each document is a chunk about the entity of its number, whose name follows the text."""
    b, docs, vectors, qvec = Bound(spark, folder), _docs(spark, folder), _vectors(spark, folder), _qvec(spark, folder)
    base = R.hybrid(docs, vectors, QUERY, qvec, n=20, doc_id="doc_id", text="text", full_scan=True)
    names = b.entities.select(F.col("id").alias("doc_id"), "canonical_name")
    chunks = docs.join(names, "doc_id", "left").select("doc_id", F.concat_ws(" ", "text", "canonical_name").alias("text"), F.col("doc_id").alias("chapter")).join(vectors, "doc_id", "left")
    got = R.graph_hybrid(base, chunks, QUERY, qvec, b.entities, b.aliases, b.links, 10, centers=["8"], doc_id="doc_id", text="text", rerank=lexical_reranker(QUERY, docs, "doc_id", "text"))
    return rounded(got, "score")


@query("snippets_R17", f"with {BM25} select doc_id, round(score, 6) as score, left(text, 180) as snippet from (select * from bm order by score desc, doc_id limit 5) b join documents using (doc_id)")
def snippets(spark, folder):
    docs = _docs(spark, folder)
    return R.snippets(R.bm25(docs, QUERY, 5, "doc_id", "text"), docs, "doc_id", "text")


@query("hydrated_parents_Y03", "select conv_id, turn, cast(0.0 as double) as score, 'parent' as source from conversations where turn = 0 and conv_id in (select conv_id from conversations where turn > 3)")
def hydrated_parents(spark, folder):
    c = Bound(spark, folder).t.conversations
    return L.by_ids(c.filter("turn = 0"), c.filter("turn > 3").select("conv_id"), "conv_id").select("conv_id", "turn", F.lit(0.0).alias("score"), F.lit("parent").alias("source"))


# graphs
_AS_OF = """with l as (select from_entity, to_entity, type, chapter, action from relationship_events where chapter <= {n} qualify row_number() over (partition by from_entity, to_entity, type order by chapter desc, id desc) = 1),
e as (select * from l where action <> 'remove' union all select from_entity, to_entity, type, chapter, 'snapshot' as action from links s where chapter <= {n} and not exists (select 1 from l where l.from_entity = s.from_entity and l.to_entity = s.to_entity))
"""


@query("edges_as_of_G01", sql(_AS_OF.format(n=12) + "select * from e"))
def edges_as_of(spark, folder):
    b = Bound(spark, folder)
    return G.edges_as_of(b.relationship_events, b.links, 12)


@query("edges_now_G01", sql("select from_entity, to_entity, type, chapter, 'snapshot' as action from links"))
def edges_now(spark, folder):
    b = Bound(spark, folder)
    return G.edges_as_of(b.relationship_events, b.links)


@query("edges_detailed_G01", sql("""with l as (select * from relationship_events where chapter <= 12 qualify row_number() over (partition by from_entity, to_entity, type order by chapter desc, id desc) = 1)
select from_entity, to_entity, type, chapter, '' as description, 0::bigint as polarity, coalesce(strength, 0.5) as strength, '' as evidence, cast(1.0 as double) as confidence, id as event_id, action from l where action <> 'remove'
union all select from_entity, to_entity, type, chapter, '', 1, cast(0.5 as double), '', cast(1.0 as double), null, 'snapshot' from links s where chapter <= 12 and not exists (select 1 from l where l.from_entity = s.from_entity and l.to_entity = s.to_entity)"""))
def edges_detailed(spark, folder):
    b = Bound(spark, folder)
    got = G.edges_as_of(b.relationship_events, b.links, 12, details=True, negative=["enemy"], positive=["link"])
    return got


@query("subgraph_events_first_G02", sql("""with l as (select * from relationship_events where chapter <= 20 qualify row_number() over (partition by from_entity, to_entity, type order by chapter desc, id desc) = 1),
e as (select from_entity, to_entity, type, chapter, id from l where action <> 'remove' union all select from_entity, to_entity, type, chapter, null from links s where chapter <= 20 and not exists (select 1 from l where l.from_entity = s.from_entity and l.to_entity = s.to_entity))
select from_entity, to_entity, type, chapter, 1 as hop from e where from_entity = 8 or to_entity = 8 order by id is null, chapter desc, id desc, from_entity, to_entity, type limit 20"""))
def subgraph_events_first(spark, folder):
    b = Bound(spark, folder)
    return G.subgraph_frame(G.edges_as_of(b.relationship_events, b.links, 20, details=True), 8, 1, 20)


_HOPS = _AS_OF.format(n=20).rstrip() + """,
h1 as (select from_entity, to_entity, type, chapter from e where from_entity = 8 or to_entity = 8 order by chapter desc, from_entity, to_entity, type limit 50),
fr as (select x from (select from_entity as x from h1 union select to_entity from h1) where x <> 8),
h2 as (select from_entity, to_entity, type, chapter, row_number() over (order by chapter desc, from_entity, to_entity, type) as r from e where (from_entity in (select x from fr) or to_entity in (select x from fr)) and from_entity <> 8 and to_entity <> 8)
select *, 1 as hop from h1 union all select from_entity, to_entity, type, chapter, 2 from h2 where r <= 50 - (select count(*) from h1)"""


@query("subgraph_G02", sql(_HOPS))
def subgraph(spark, folder):
    b = Bound(spark, folder)
    return G.subgraph_frame(G.edges_as_of(b.relationship_events, b.links, 20), 8, 2, 50)


@query("subgraph_one_hop_G02", sql(_AS_OF.format(n=20) + "select from_entity, to_entity, type, chapter, 1 as hop from e where from_entity = 8 or to_entity = 8 order by chapter desc, from_entity, to_entity, type limit 50"))
def subgraph_one_hop(spark, folder):
    b = Bound(spark, folder)
    return G.subgraph_frame(G.edges_as_of(b.relationship_events, b.links, 20), 8, 1, 50)


_NEIGHBOURS = """with u as (select from_entity as a, to_entity as b from links union select to_entity, from_entity from links),
h1 as (select distinct b as id from u where a = 8), h2 as (select distinct u.b as id from u join h1 on u.a = h1.id)
select 8 as id, 0 as hop union all select id, 1 from h1 where id <> 8 union all select id, 2 from h2 where id <> 8 and id not in (select id from h1)"""


@query("neighbours_whole_R10", sql(_NEIGHBOURS))
def neighbours(spark, folder):
    return G.neighbours(Bound(spark, folder).links, spark.createDataFrame([(8,)], "id long"), 2)


@query("neighbours_R10", sql(_NEIGHBOURS))
def neighbours_of_many(spark, folder):
    """The same from the search for many sources, of one."""
    return G.reach(Bound(spark, folder).links, spark.createDataFrame([(8,)], "id long"), 2).select("id", "hop")


@query("typed_graph_G05", sql(_AS_OF.format(n=20).rstrip() + """,
p as (select min(id) as id from entities where is_protagonist),
h1 as (select from_entity, to_entity, type, chapter from e, p where from_entity = p.id or to_entity = p.id order by chapter desc, from_entity, to_entity, type limit 40),
fr as (select x from (select from_entity as x from h1 union select to_entity from h1) where x not in (select id from p)),
h2 as (select from_entity, to_entity, type, chapter, row_number() over (order by chapter desc, from_entity, to_entity, type) as r from e, p where (from_entity in (select x from fr) or to_entity in (select x from fr)) and from_entity <> p.id and to_entity <> p.id),
g as (select * from h1 union all select from_entity, to_entity, type, chapter from h2 where r <= 40 - (select count(*) from h1))
select coalesce(a.canonical_name, cast(from_entity as varchar)) as from_name, coalesce(c.canonical_name, cast(to_entity as varchar)) as to_name, g.type as label, false as hostile from g left join entities a on a.id = from_entity left join entities c on c.id = to_entity"""))
def typed_graph(spark, folder):
    """Two levels around the flagged entity."""
    b = Bound(spark, folder)
    legacy = spark.createDataFrame([], "name string, relation string, hostile boolean, affection long, hatred long")
    return G.relationship_report(b.entities, b.aliases, G.edges_as_of(b.relationship_events, b.links, 20), legacy)


@query("legacy_graph_G05", """select 'lead' as from_name, c_name as to_name, 'affection ' || cast(floor(c_acctbal) as bigint) as label, false as hostile from customer where floor(c_acctbal) > 0
union all select 'lead', c_name, 'hatred ' || c_nationkey, true from customer where c_nationkey > 0""")
def legacy_graph(spark, folder):
    """Without a protagonist in the index, the older document form: two measures a character."""
    b = Bound(spark, folder)
    legacy = b.t.customer.select(F.col("c_name").alias("name"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast("boolean").alias("hostile"), F.floor("c_acctbal").cast("long").alias("affection"), F.col("c_nationkey").cast("long").alias("hatred"))
    return G.relationship_report(b.entities.withColumn("is_protagonist", F.lit(False)), b.aliases, b.links, legacy, lead="lead")
