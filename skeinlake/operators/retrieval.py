"""Retrieval: BM25 over length-normalised term frequencies, exact cosine, reciprocal rank fusion, graph expansion.

Corpus statistics come from all indexed documents; filters on what may be returned apply after scoring. Query terms,
vectors and entity lists are given query sets and become literals in the plan; documents are scored in one scan and
the result is a top-k, so no postings of other terms are shuffled. ``postings`` builds the persistent inverted index
for corpora that are searched often.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.scalars import cosine, tokenize
from .storage import materialize
from .windows import keep_max, ranks

CJK_RUN = re.compile(r"[一-鿿]")


def query_terms(text: str) -> list[str]:
    """Distinct tokens of a query in order, as documents are tokenized."""
    low = text.lower()
    return list(dict.fromkeys([*CJK_RUN.findall(text), *re.findall(r"[a-z]+", low)]))


def postings(docs: DataFrame, doc_id: str = "chunk_id", text: str = "content") -> tuple[DataFrame, DataFrame]:
    """(term, id, tf / length) and (id, length). (B-21, B-22)"""
    toks = docs.select(F.col(doc_id).alias("chunk_id"), tokenize(F.coalesce(F.col(text), F.lit(""))).alias("toks"))
    stats = toks.select("chunk_id", F.size("toks").cast("long").alias("doc_length"))
    flat = toks.select("chunk_id", F.size("toks").alias("n"), F.explode("toks").alias("term"))
    return flat.groupBy("term", "chunk_id").agg((F.count("*") / F.first("n")).alias("tf")), stats


def corpus_stats(stats: DataFrame) -> DataFrame:
    """Number of documents and mean length, both 1 where that gives 0 or null. (E-11)"""
    return stats.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"), F.coalesce(F.when(F.avg("doc_length") > 0, F.avg("doc_length")), F.lit(1.0)).alias("avg_length"))


def _idf(n: int, df: int) -> float:
    return math.log((n - df + 0.5) / (df + 0.5) + 1)


def _same(term: str) -> Callable[[Column], Column]:
    return lambda x: x == term


def bm25(docs: DataFrame, query: str, k: int, doc_id: str = "chunk_id", text: str = "content", keep: Column | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """(id, score): the k best documents that ``keep`` lets through, ties by id. No terms give no rows. (R-01, D-02)

    One pass over the texts counts all documents and writes down those that have a term; nothing else is stored.
    """
    terms = query_terms(query)
    # A document's length and which query terms it has, once for each time.
    one = F.transform(F.array(tokenize(F.coalesce(F.col(text), F.lit("")))), lambda t: F.struct(F.size(t).alias("len"), F.filter(t, lambda x: x.isin(terms)).alias("hits")))
    kept = (keep if keep is not None else F.lit(True)).alias("__keep")
    counted = docs.select(F.col(doc_id), kept, F.element_at(one, 1).alias("s"))
    if not terms:
        return docs.select(doc_id, F.lit(0.0).alias("score")).limit(0)
    seen = Observation(f"bm25-{uuid.uuid4().hex}")
    counted = materialize(counted.observe(seen, F.count("*").alias("n"), F.avg("s.len").alias("avg")).filter(F.size("s.hits") > 0))
    counted = counted.select(doc_id, "__keep", F.col("s.len").alias("len"), *[F.size(F.filter("s.hits", _same(t))).alias(f"c{i}") for i, t in enumerate(terms)])
    row = counted.agg(*[F.count_if(F.col(f"c{i}") > 0).alias(f"d{i}") for i in range(len(terms))]).first()
    n, avg = max(seen.get["n"], 1), seen.get["avg"] or 1.0
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf = F.col(f"c{i}") / F.col("len")
        part = F.lit(_idf(n, row[f"d{i}"])) * tf * (cfg.k1 + 1) / (tf + cfg.k1 * (1 - cfg.b + cfg.b * F.col("len") / F.lit(avg)))
        score = score + F.when(F.col(f"c{i}") > 0, part).otherwise(F.lit(0.0))
    return counted.filter(F.col("__keep")).select(doc_id, score.alias("score")).orderBy(F.desc("score"), doc_id).limit(k)


def bm25_indexed(post: DataFrame, stats: DataFrame, query: str, k: int, cfg: Config = DEFAULT) -> DataFrame:
    """The same scores from a stored inverted index: only the postings of the query's terms are read. (D-02)"""
    terms = query_terms(query)
    mine = post.filter(F.col("term").isin(terms)) if terms else post.limit(0)
    c = corpus_stats(stats).first()
    df = {r["term"]: r["count"] for r in mine.groupBy("term").count().collect()}  # one row per query term
    table = F.create_map(*[F.lit(x) for t in terms for x in (t, _idf(c["n"], df.get(t, 0)))]) if terms else F.create_map(F.lit(""), F.lit(0.0))
    joined = mine.join(stats, "chunk_id")
    part = F.try_element_at(table, F.col("term")) * F.col("tf") * (cfg.k1 + 1) / (F.col("tf") + cfg.k1 * (1 - cfg.b + cfg.b * F.col("doc_length") / F.lit(float(c["avg_length"]))))
    return joined.groupBy("chunk_id").agg(F.sum(part).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(k)


def vector_search(vectors: DataFrame, query: list[float], k: int, doc_id: str = "chunk_id", vec: str = "embedding", keep: Column | None = None) -> DataFrame:
    """(id, score): the k most similar by cosine; rows without a vector are left out. (R-02, R-03, Y-02)"""
    rows = vectors.filter(F.col(vec).isNotNull() & (F.size(vec) > 0))
    if keep is not None:
        rows = rows.filter(keep)
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(doc_id, cosine(F.col(vec), q).alias("score")).orderBy(F.desc("score"), doc_id).limit(k)


def rrf(lists: dict[str, DataFrame], k: int, doc_id: str = "chunk_id", cfg: Config = DEFAULT) -> DataFrame:
    """(id, rrf, and each list's own score): fusion of ranked top-k lists. (R-05, W-04)"""
    parts = [ranks(df.select(doc_id, "score"), "score", doc_id).withColumn("__from", F.lit(name)) for name, df in lists.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    own = [F.max(F.when(F.col("__from") == name, F.col("score"))).alias(f"{name}_score") for name in lists]
    # Summed in the order of the lists, so equal inputs give equal doubles.
    per = [F.coalesce(F.max(F.when(F.col("__from") == name, 1.0 / (cfg.rrf_k + F.col("rank") + 1))), F.lit(0.0)) for name in lists]
    total = per[0]
    for p in per[1:]:
        total = total + p
    return both.groupBy(doc_id).agg(total.alias("rrf"), *own).orderBy(F.desc("rrf"), doc_id).limit(k)


Scorer = Callable[[DataFrame], DataFrame]


def hybrid(
    docs: DataFrame, vectors: DataFrame, query: str, qvec: list[float] | None, n: int | None = None, vector_k: int | None = None, bm25_k: int | None = None,
    doc_id: str = "chunk_id", text: str = "content", vec: str = "embedding", recent: str | None = None, keep: Column | None = None,
    rerank: Scorer | None = None, full_scan: bool | None = True, scale: str = "reference", cfg: Config = DEFAULT,
) -> DataFrame:
    """(id, score, source): BM25 and cosine fused by reciprocal rank, then reranked. (R-04, U-01, Y-05)

    All vectors are compared, whatever their number. With ``full_scan`` False only those of BM25's best and of the most
    recent documents are, which misses most near vectors of other documents (recall of the 30 nearest: 0.23 on sf0.01, 0.03
    on sf0.1, where vectors and texts have little to do with each other); None takes that way beyond
    ``cfg.full_scan_max`` vectors, as the reference does. Without a query vector the full path is BM25 alone and the
    prefiltered path is empty (Y-07). ``rerank`` maps (id, rrf, ...) to (id, score). Without it, and if it fails or
    gives no rows, the fused order stays, scored as ``scale`` says: "reference" keeps each hit's own score (the vector's
    where it has one), "rrf" the fused one.
    """
    n, vector_k, bm25_k = n or cfg.rerank_top_n, vector_k or cfg.vector_top_k, bm25_k or cfg.bm25_top_k
    if full_scan is None:
        full_scan = vectors.count() <= cfg.full_scan_max
    most = bm25_k if full_scan else max(cfg.prefilter_bm25, bm25_k, 5 * vector_k, 10 * n)
    words = best = bm25(docs, query, most, doc_id, text, keep, cfg)
    if qvec is None:
        return words.select(doc_id, "score", F.lit("bm25").alias("source")).limit(n if full_scan else 0)
    pool = vectors if keep is None else vectors.join(docs.filter(keep).select(doc_id), doc_id, "left_semi")
    if not full_scan:
        best = materialize(best)
        words, first = best.orderBy(F.desc("score"), doc_id).limit(bm25_k), best.select(doc_id)
        order = [F.desc(recent or doc_id)] + ([F.desc(doc_id)] if recent else [])
        late = docs.filter(keep if keep is not None else F.lit(True)).orderBy(*order).limit(max(cfg.prefilter_recent, 5 * vector_k, 10 * n)).select(doc_id)
        pool = vectors.join(first.union(late).distinct(), doc_id, "left_semi")
    near = vector_search(pool, qvec, vector_k, doc_id, vec)
    fused = rrf({"vector": near, "bm25": words}, 2 * n, doc_id, cfg)
    source = F.when(F.col("vector_score").isNotNull(), F.lit("vector")).otherwise(F.lit("bm25"))
    if rerank is not None:
        fused = materialize(fused)
        scored = reranked(rerank, fused, doc_id)
        if scored is not None:
            return fused.join(scored, doc_id).select(doc_id, "score", F.lit("rerank").alias("source")).orderBy(F.desc("score"), doc_id).limit(n)
    own = F.coalesce("vector_score", "bm25_score") if scale == "reference" else F.col("rrf")
    return fused.orderBy(F.desc("rrf"), doc_id).limit(n).select(doc_id, own.alias("score"), source.alias("source"), "rrf")


def reranked(rerank: Scorer, hits: DataFrame, doc_id: str) -> DataFrame | None:
    """(id, score) by a reranking service; None if it fails or gives no rows. (A-11)"""
    try:
        scored = materialize(rerank(hits).select(doc_id, "score"))
        return scored if scored.limit(1).count() else None
    except (OSError, PySparkException, Py4JJavaError):
        return None


def graph_priors(score: Column, text: Column, seeds: list[str], related: list[str], chapter: Column, now: Column, cfg: Config = DEFAULT) -> Column:
    """A bonus for a seed's name in the text, else for a related one's, and for recency. (R-07)"""
    from ..functions.scalars import has_any

    bonus = F.when(has_any(text, seeds), cfg.prior_seed).when(has_any(text, related), cfg.prior_related).otherwise(0.0)
    gap = F.least(F.abs(now - chapter), F.lit(100))
    return score + bonus + cfg.prior_recency * F.greatest(F.lit(0.0), 1 - gap / 100)


def seed_entities(query: str, entities: DataFrame, aliases: DataFrame, cap: int | None = None, cfg: Config = DEFAULT) -> list:
    """Ids named in a query: runs of 2 to 8 ideographs or identifiers of 2 to 25 characters, each by alias, then by id,
    in the order of the query. (R-08, R-09)"""
    words = list(dict.fromkeys(re.findall(r"[一-鿿]{2,8}|[A-Za-z_][A-Za-z0-9_#]{1,24}", query)))
    cap = cap or cfg.graph_cap
    ids, named = _named(words, entities, aliases, cap)
    return list(dict.fromkeys(x for w in words for x in [*named.get(w, []), *ids.get(w, [])]))[:cap]


def normalize_ids(words: list[str], entities: DataFrame, aliases: DataFrame, cap: int | None = None, cfg: Config = DEFAULT) -> list:
    """Each word as the id it is, else the ids it is an alias of; distinct, in order, at most the cap. (R-09)"""
    cap = cap or cfg.graph_cap
    ids, named = _named(words, entities, aliases, cap)
    return list(dict.fromkeys(x for w in words for x in ids.get(w) or named.get(w, [])))[:cap]


def _named(words: list[str], entities: DataFrame, aliases: DataFrame, cap: int) -> tuple[dict[str, list], dict[str, list]]:
    """For each word the id it is, and the first ``cap`` ids it is an alias of: enough for any order of the words."""
    from .lookup import per_group_top

    if not words:
        return {}, {}
    ids = {str(r.id): [r.id] for r in entities.filter(F.col("id").cast("string").isin(words)).select("id").collect()}
    named: dict[str, list] = {}
    hits = aliases.filter(F.col("alias").isin(words)).select("alias", "entity_id").distinct()
    for r in sorted(per_group_top(hits, "alias", cap, "entity_id").collect()):
        named.setdefault(r.alias, []).append(r.entity_id)
    return ids, named


def expand_related(seeds: list, edges: DataFrame, hops: int | None = None, top_edges: int = 200, cfg: Config = DEFAULT) -> list:
    """The seeds, then the nodes of each one's subgraph, at most ``cfg.graph_cap``. (R-10)

    Unlike the reference, all seeds come before what they lead to, so the cap never drops a seed for a neighbour. All
    seeds are expanded in one search, a join a hop.
    """
    from .graph import subgraphs

    seeds = list(dict.fromkeys(seeds))[: cfg.graph_cap]
    out = dict.fromkeys(seeds)
    if len(out) < cfg.graph_cap:
        for _, nodes in subgraphs(edges, seeds, hops or cfg.graph_hops, max(20, top_edges)).values():
            out.update(dict.fromkeys(nodes))
    return list(out)[: cfg.graph_cap]


def entity_terms(ids: list, entities: DataFrame, aliases: DataFrame) -> dict:
    """Id -> its canonical name and aliases, trimmed; ids without any are left out."""
    out: dict = {}
    names = entities.filter(F.col("id").isin(ids)).select("id", F.col("canonical_name").alias("term"))
    more = aliases.filter(F.col("entity_id").isin(ids)).select(F.col("entity_id").alias("id"), F.col("alias").alias("term"))
    for r in names.unionByName(more).distinct().collect():
        if r.term and r.term.strip():
            out.setdefault(r.id, set()).add(r.term.strip())
    return {i: sorted(out[i]) for i in ids if i in out}


def graph_hybrid(
    base: DataFrame, chunks: DataFrame, query: str, qvec: list[float] | None, entities: DataFrame, aliases: DataFrame, edges: DataFrame, k: int,
    centers: list[str] | None = None, now: int | None = None, hops: int | None = None, doc_id: str = "chunk_id", text: str = "content",
    vec: str = "embedding", chapter: str = "chapter", candidates: int = 200, rerank: Scorer | None = None, cfg: Config = DEFAULT,
) -> DataFrame:
    """(id, score): a base list joined by chunks that name the seeds or what is related to them, the higher score of
    each kept, then reranked. Without seeds it is the base list. (R-06, R-10, D-11)

    Seeds are the centre entities, else those the query names; they are expanded over ``edges``. Chunks (to ``now``, if
    given) are candidates by the names and aliases they hold. ``rerank`` maps (id, score) to (id, score); if it fails or
    returns no rows, the merged order stays.
    """
    from .names import term_counts

    plain = base.select(doc_id, "score")
    seeds = normalize_ids([c.strip() for c in centers or [] if c.strip()], entities, aliases, cfg=cfg) or seed_entities(query, entities, aliases, cfg=cfg)
    if not seeds:
        return plain.orderBy(F.desc("score"), doc_id).limit(k)
    terms = entity_terms(expand_related(seeds, edges, hops, candidates, cfg), entities, aliases)
    merged = plain
    if terms and qvec:
        seen = chunks if now is None else chunks.filter(F.col(chapter) <= now)
        if now is None:
            now = chunks.agg(F.max(chapter)).first()[0] or 0
        of_seeds = sorted({t for i in seeds for t in terms.get(i, [])})
        of_related = sorted({t for ts in terms.values() for t in ts} - set(of_seeds))
        hits = term_counts(seen, terms, doc_id, text).withColumnRenamed("hits", "__hits")
        named = seen.join(hits, doc_id).orderBy(F.desc("__hits"), F.desc(chapter), doc_id).limit(max(8 * k, candidates))
        q = F.array(*[F.lit(float(x)) for x in qvec])
        near = named.filter(F.col(vec).isNotNull() & (F.size(vec) > 0)).withColumn("__near", cosine(F.col(vec), q)).orderBy(F.desc("__near"), doc_id).limit(max(4 * k, 2 * cfg.rerank_top_n))
        near = near.select(doc_id, graph_priors(F.col("__near"), F.col(text), of_seeds, of_related, F.col(chapter), F.lit(now), cfg).alias("score"))
        merged = keep_max(plain, near, doc_id)
    best = merged.orderBy(F.desc("score"), doc_id).limit(max(3 * k, 2 * cfg.rerank_top_n))
    if rerank is not None:
        best = materialize(best)
        scored = reranked(rerank, best, doc_id)
        if scored is not None:
            best = best.select(doc_id).join(scored, doc_id)
    return best.orderBy(F.desc("score"), doc_id).limit(k)


#: Intent -> words that mark it, as a parameter of the router; the first match wins.
def route(query: str, words: dict[str, list[str]], needs_graph: tuple[str, ...] = ("relationship",), stop: frozenset[str] = frozenset(), marker: str | None = None) -> dict:
    """Intent, up to four entity candidates, time scope and whether the graph is needed. (R-13, Y-08)"""
    intent = next((name for name, ws in words.items() if any(w in query for w in ws)), "plot")
    runs = [w for w in re.findall(r"[一-鿿]{2,6}", query) if w not in stop]
    return {"intent": intent, "entities": list(dict.fromkeys(runs))[:4], "time_scope": time_scope(query, marker), "needs_graph": intent in needs_graph}


#: Fixed value: what follows the number of a chapter.
CHAPTER = r"\s*章"


def time_scope(query: str, marker: str | None = None) -> tuple[int, int] | None:
    """A range of chapters, turned round if reversed, or one chapter. (R-14)

    ``marker`` is a pattern that must follow the number, as ``CHAPTER``; without one any digits count.
    """
    end = marker or ""
    if m := re.search(rf"(\d+)\s*[-~–到]\s*(\d+){end}", query):
        a, b = sorted((int(m[1]), int(m[2])))
        return a, b
    if m := re.search(rf"(\d+){end}", query):
        return int(m[1]), int(m[1])
    return None


#: The search of each intent without a graph.
STRATEGIES = {"entity": "hybrid", "scene": "bm25", "setting": "bm25", "plot": "hybrid"}


def plan_subqueries(intent: dict, strategies: dict[str, str] | None = None) -> list[dict]:
    """The steps of a routed query: name, strategy, entities and time scope. (R-15)

    Relationships take a look at the graph and then the graph search; a query that needs the graph and names entities
    takes the graph search alone; any other the search of its intent.
    """
    if intent["intent"] == "relationship":
        steps = [("relationship_graph", "graph_lookup"), ("relationship_evidence", "graph_hybrid")]
    elif intent["needs_graph"] and intent["entities"]:
        steps = [("graph_enhanced_retrieval", "graph_hybrid")]
    else:
        steps = [("default_retrieval", (STRATEGIES if strategies is None else strategies).get(intent["intent"], "hybrid"))]
    return [{"name": n, "strategy": s, "entities": list(intent["entities"]), "time_scope": intent["time_scope"]} for n, s in steps]


def plan_steps(intent: dict, strategies: dict[str, str]) -> list[str]:
    """Searches over texts to run one after the other until one has hits; ``plan_subqueries`` has the steps of the
    inventory."""
    if intent["intent"] == "relationship":
        return ["graph_hybrid", "hybrid"]
    first = strategies.get(intent["intent"], "hybrid")
    return ["graph_hybrid", first] if intent["entities"] and first != "graph_hybrid" and intent["needs_graph"] else [first]


def split_query(query: str, separators: str = ",;，；、") -> list[str]:
    """Parts between any of the separator characters. (R-16)"""
    return [p.strip() for p in re.split(f"[{re.escape(separators)}]", query) if p.strip()]


def choose_strategy(strategy: str, intent: dict, graph_enabled: bool) -> str:
    """auto takes the graph where it is enabled and needed; unknown names are hybrid. (R-11)"""
    strategy = strategy.lower()
    if strategy == "auto":
        return "graph_hybrid" if graph_enabled and intent["needs_graph"] else "hybrid"
    return strategy if strategy in ("vector", "bm25", "hybrid", "graph_hybrid", "backtrack") else "hybrid"


def search(
    docs: DataFrame, vectors: DataFrame, query: str, qvec: list[float] | None, k: int = 5, strategy: str = "auto", intent: dict | None = None, filters: dict | None = None,
    entities: DataFrame | None = None, aliases: DataFrame | None = None, edges: DataFrame | None = None, centers: list[str] | None = None, chapter: int | None = None,
    parents: DataFrame | None = None, doc_id: str = "chunk_id", text: str = "content", vec: str = "embedding", at: str = "chapter", keep: Column | None = None,
    rerank: Scorer | None = None, graph_enabled: bool = True, cfg: Config = DEFAULT,
) -> DataFrame:
    """(id, score, source): one entry to all strategies. (R-11)

    ``intent`` is a routed query; "auto" takes the graph where it is needed, with the routed entities as centres.
    ``filters`` may hold ``to_chapter``; with it, or with ``chapter``, only documents up to that chapter are found.
    ``keep`` is a further condition on ``docs``. Unknown strategies are "hybrid".
    """
    intent = intent or {"intent": "plot", "entities": [], "time_scope": None, "needs_graph": False}
    if chapter is None and str((filters or {}).get("to_chapter") or "").strip().isdigit():
        chapter = int(filters["to_chapter"]) or None
    took = choose_strategy(strategy, intent, graph_enabled and entities is not None)
    if strategy.lower() == "auto" and took == "graph_hybrid":
        centers = centers or intent["entities"]
    if chapter is not None:
        upto = F.col(at) <= chapter
        keep = upto if keep is None else keep & upto
    if took == "backtrack":
        return backtrack(docs, vectors, query, qvec, k, parents, doc_id, text, vec, rerank=rerank, cfg=cfg)
    if took == "bm25":
        return bm25(docs, query, k, doc_id, text, keep, cfg).withColumn("source", F.lit("bm25"))
    if took == "vector":
        if qvec is None:
            return docs.select(doc_id, F.lit(0.0).alias("score"), F.lit("vector").alias("source")).limit(0)
        pool = vectors if keep is None else vectors.join(docs.filter(keep).select(doc_id), doc_id, "left_semi")
        return vector_search(pool, qvec, k, doc_id, vec).withColumn("source", F.lit("vector"))
    if took == "graph_hybrid" and entities is not None:
        base = hybrid(docs, vectors, query, qvec, max(k, cfg.rerank_top_n), doc_id=doc_id, text=text, vec=vec, keep=keep, rerank=rerank, cfg=cfg)
        chunks = (docs if keep is None else docs.filter(keep)).join(vectors.select(doc_id, vec), doc_id, "left")
        got = graph_hybrid(base, chunks, query, qvec, entities, aliases, edges, k, centers, chapter, doc_id=doc_id, text=text, vec=vec, chapter=at, rerank=rerank, cfg=cfg)
        return got.withColumn("source", F.lit("graph_hybrid"))
    return hybrid(docs, vectors, query, qvec, k, k, k, doc_id, text, vec, keep=keep, rerank=rerank, cfg=cfg).select(doc_id, "score", "source")


def backtrack(
    docs: DataFrame, vectors: DataFrame, query: str, qvec: list[float] | None, k: int = 5, parents: DataFrame | None = None, doc_id: str = "chunk_id", text: str = "content",
    vec: str = "embedding", parent: str = "parent_chunk_id", kind: str = "chunk_type", scene: str = "scene", rerank: Scorer | None = None, cfg: Config = DEFAULT,
) -> DataFrame:
    """(id, score, source, position): the best scenes, each parent once before its first scene, with score 0. (R-12)

    ``docs`` has the parent's id and the kind of each document; only scenes are searched, parents may be any document.
    """
    from .joins import parents_first

    hits = hybrid(docs, vectors, query, qvec, k, 2 * k, 2 * k, doc_id, text, vec, keep=F.col(kind) == scene, rerank=rerank, cfg=cfg)
    order = [F.desc(c) for c in (["rrf"] if "rrf" in hits.columns else ["score"])]
    hits = materialize(hits.withColumn("rank", F.row_number().over(Window.orderBy(*order, doc_id)) - 1).select(doc_id, "score", "source", "rank"))
    ranked = hits.join(docs.select(doc_id, F.col(parent).alias("parent_chunk_id")), doc_id).withColumnRenamed(doc_id, "chunk_id")
    known = (docs if parents is None else parents).select(F.col(doc_id).alias("chunk_id"))
    got = parents_first(ranked.select("chunk_id", "parent_chunk_id", "rank"), known)
    scored = hits.select(F.col(doc_id).alias("chunk_id"), "score", "source").withColumn("kind", F.lit("hit"))
    got = got.join(scored, ["chunk_id", "kind"], "left")
    return got.select(F.col("chunk_id").alias(doc_id), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("source", F.lit("parent")).alias("source"), "position")


def snippets(hits: DataFrame, docs: DataFrame, doc_id: str = "chunk_id", text: str = "content", width: int = 180) -> DataFrame:
    """Hits with the first characters of their text and the score to 6 places. (R-17)"""
    return hits.join(docs.select(doc_id, F.left(text, F.lit(width)).alias("snippet")), doc_id).select(doc_id, F.round("score", 6).alias("score"), "snippet")
