"""Queries: scalar functions over whole tables (family F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from .q_lookup import simple

simple("like_F01", lambda b: b.t.documents.filter(S.like_ci(F.col("text"), "THE A")).select("doc_id"), "select doc_id from documents where lower(text) like '%the a%'")
simple(
    "tokenize_F02",
    lambda b: b.t.documents.select("doc_id", S.tokenize(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.array_join(F.slice("t", 1, 5), " ").alias("first")),
    "select doc_id, len(t) as n, array_to_string(t[1:5], ' ') as first from (select doc_id, list_concat(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]'), regexp_extract_all(lower(text), '[a-z]+')) as t from documents)",
)
simple(
    "cosine_F03",
    lambda b: b.t.embeddings.select("vec_id", F.round(S.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("score")),
    "select vec_id, round(list_dot_product(e, r) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(r, r))), 6) as score from (select vec_id, e, list_reverse(e) as r from (select vec_id, embedding::double[] as e from embeddings))",
)
simple("float32_F04", lambda b: b.t.orders.select("o_orderkey", F.element_at(S.float32(F.array("o_totalprice")), 1).cast("double").alias("v")), "select o_orderkey, cast(cast(o_totalprice as float) as double) as v from orders")
simple("json_field_F05", lambda b: b.t.events.select("event_id", S.json_field(F.col("props"), "k long").getField("k").alias("k")), "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
simple(
    "json_merge_F06",
    lambda b: b.t.customer.select("c_custkey", S.merge_maps(F.create_map(F.lit("tier"), F.lit("old"), F.lit("name"), F.col("c_name")), F.create_map(F.lit("tier"), F.col("c_mktsegment"))).alias("m")).select("c_custkey", F.col("m")["tier"].alias("tier"), F.col("m")["name"].alias("name"), F.size("m").cast("long").alias("n")),
    "select c_custkey, c_mktsegment as tier, c_name as name, 2 as n from customer",
)
simple("positive_int_F07", lambda b: b.t.part.select("p_partkey", S.positive_int(F.col("p_brand")).alias("v")), "select p_partkey, case when cast(regexp_extract(p_brand, '(\\d+)', 1) as bigint) > 0 then cast(regexp_extract(p_brand, '(\\d+)', 1) as bigint) end as v from part")
simple("first_positive_F08", lambda b: b.t.part.select("p_partkey", S.first_positive(F.col("p_type"), F.col("p_brand")).alias("v")), "select p_partkey, nullif(cast(regexp_extract(p_brand, '(\\d+)', 1) as bigint), 0) as v from part")
simple(
    "enum_F09",
    lambda b: b.t.orders.select("o_orderkey", S.enum_of(F.col("o_orderstatus"), {"resolved": ["f", "done"], "open": ["o", "p"]}, "open").alias("status")),
    "select o_orderkey, case when lower(trim(o_orderstatus)) in ('resolved', 'f', 'done') then 'resolved' else 'open' end as status from orders",
)
simple("split_patterns_F10", lambda b: b.t.part.select("p_partkey", F.array_join(S.split_patterns(F.regexp_replace("p_name", " ", " ; ")), "|").alias("p")), "select p_partkey, case when split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2) then split_part(p_name, ' ', 1) else replace(p_name, ' ', '|') end as p from part")
simple("count_patterns_F11", lambda b: b.t.part.select("p_partkey", S.count_patterns(F.regexp_replace("p_name", " ", ",")).cast("long").alias("n")), "select p_partkey, len(list_distinct(string_split(p_name, ' '))) as n from part")
simple("coalesce_synonyms_F12", lambda b: b.t.events.select("event_id", S.coalesce_keys(F.col("props"), ["missing", "k"]).alias("v")), "select event_id, json_extract_string(props, '$.k') as v from events")
simple("recency_F14", lambda b: b.chapters.select("chapter", F.round(S.recency(F.col("chapter"), F.lit(150)), 6).alias("r")), "select chapter, round(1.0 / (1 + greatest(0, 150 - chapter)), 6) as r from chapters")
simple("frequency_F15", lambda b: b.appearances.select("entity_id", "chapter", F.round(S.frequency(F.col("mentions")), 6).alias("f")), "select entity_id, chapter, round(least(1.0, ln(1 + mentions) / ln(11.0)), 6) as f from appearances")
simple("length_score_F16", lambda b: b.chapters.select("chapter", F.round(S.length_score(F.col("summary")), 6).alias("s")), "select chapter, round(least(length(summary) / 1200.0, 1.0) * 0.2, 6) as s from chapters")
simple("has_any_F17", lambda b: b.chapters.select("chapter", S.has_any(F.col("summary"), ["idiot", "que el"]).alias("hit")), "select chapter, contains(summary, 'idiot') or contains(summary, 'que el') as hit from chapters")
simple("count_of_F18", lambda b: b.chapters.select("chapter", S.count_of(F.col("summary"), "the").alias("n")), "select chapter, (length(summary) - length(replace(summary, 'the', ''))) // 3 as n from chapters")
simple("head_tail_F19", lambda b: b.chapters.select("chapter", S.head(F.col("summary"), 30).alias("head"), S.tail(F.col("summary"), 30).alias("tail")), "select chapter, left(summary, 30) as head, right(summary, 30) as tail from chapters")
simple(
    "compact_F20",
    lambda b: b.chapters.select("chapter", S.compact(F.col("summary"), 300).alias("c"), S.compact(F.col("summary"), 100).alias("d")),
    "select chapter, case when length(summary) <= 300 then summary else left(left(summary, 195) || '...[cut]...' || right(summary, 95), 300) end as c, case when length(summary) <= 100 then summary else left(summary, 100) end as d from chapters",
)
simple("page_title_F21", lambda b: b.t.pages.select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title")), "select page_id, regexp_extract(html, '<title>(.*?)</title>', 1) as title from pages")
simple("split_tokens_F23", lambda b: b.t.part.select("p_partkey", F.array_join(S.split_tokens(F.concat("p_name", F.lit(" "), F.upper("p_name")), " ", 2), "+").alias("t")), "select p_partkey, case when split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2) then split_part(p_name, ' ', 1) else replace(p_name, ' ', '+') end as t from part")
simple("translate_token_F24", lambda b: b.t.customer.select("c_custkey", S.translate_token(F.col("c_mktsegment"), {"BUILDING": "house", "MACHINERY": "tool"}).alias("t")), "select c_custkey, case c_mktsegment when 'BUILDING' then 'house' when 'MACHINERY' then 'tool' else c_mktsegment end as t from customer")
simple("chapter_of_path_F25", lambda b: b.t.pages.select("page_id", S.chapter_of_path(F.regexp_replace("url", "[?#].*$", "")).alias("c")), "select page_id, try_cast(regexp_extract(list_last(string_split(regexp_replace(url, '[?#].*$', ''), '/')), '(\\d+)', 1) as bigint) as c from pages")
simple("volume_of_F25", lambda b: b.chapters.select("chapter", S.volume_of(F.col("chapter")).cast("long").alias("v")), "select chapter, case when chapter >= 1 then (chapter - 1) // 50 + 1 end as v from chapters")
simple(
    "range_of_F28",
    lambda b: b.contracts.select("id", S.range_of(F.concat("chapter", F.lit("-"), "due_chapter")).alias("r")).select("id", "r.first", "r.last"),
    "select id, chapter as first, due_chapter as last from contracts",
)
simple("review_end_F27", lambda b: b.contracts.select("id", S.review_end(F.concat(F.lit("Review_"), "chapter", F.lit("-"), "due_chapter", F.lit(".md"))).alias("e"), S.review_end(F.lit("none")).alias("z")), "select id, due_chapter as e, cast(0 as bigint) as z from contracts")
simple("polarity_F29", lambda b: b.t.events.select("event_id", S.polarity(F.col("event_type"), ["err"], ["purch", "sign"]).cast("long").alias("p")), "select event_id, cast(case when contains(event_type, 'err') then -1 when contains(event_type, 'purch') or contains(event_type, 'sign') then 1 else 0 end as bigint) as p from events")
simple("confidence_band_F30", lambda b: b.appearances.select("entity_id", "chapter", S.confidence_band(F.col("confidence")).alias("band")), "select entity_id, chapter, case when confidence >= 0.8 then 'auto' when confidence >= 0.5 then 'warn' else 'manual' end as band from appearances")
_CLASSES = {"battle": ["idiot", "scum"], "tension": ["error", "trash"], "dialogue": ["the"]}
simple(
    "scene_class_F31",
    lambda b: b.chapters.select("chapter", S.first_class(F.col("summary"), _CLASSES, "description").alias("class"), F.array_join(S.all_classes(F.col("summary"), _CLASSES), ",").alias("tags")),
    "select chapter, case when b then 'battle' when t then 'tension' when d then 'dialogue' else 'description' end as class, concat_ws(',', case when b then 'battle' end, case when t then 'tension' end, case when d then 'dialogue' end) as tags from (select chapter, contains(summary, 'idiot') or contains(summary, 'scum') as b, contains(summary, 'error') or contains(summary, 'trash') as t, contains(summary, 'the') as d from chapters)",
)
simple("outline_query_F32", lambda b: b.chapters.select("chapter", F.left(S.normal_outline(F.col("summary")), F.lit(120)).alias("q")), "select chapter, left(trim(regexp_replace(regexp_replace(summary, '(?m)^#+\\s*', '', 'g'), '\\s+', ' ', 'g')), 120) as q from chapters")
simple("format_F34", lambda b: b.t.customer.select("c_custkey", S.grouped(F.col("c_acctbal")).alias("f")), "select c_custkey, format('{:,.2f}', c_acctbal) as f from customer")
simple("extract_chapter_F35", lambda b: b.t.part.select("p_partkey", S.first_positive(F.lit("none"), F.col("p_name"), F.col("p_size")).alias("c")), "select p_partkey, cast(nullif(p_size, 0) as bigint) as c from part")
simple("total_casts_F36", lambda b: b.t.part.select("p_partkey", S.to_double(F.col("p_name"), -1.0).alias("d"), S.to_long(F.col("p_size").cast("string"), 0).alias("l")), "select p_partkey, coalesce(try_cast(p_name as double), -1.0) as d, cast(p_size as bigint) as l from part")
simple("rounding_F37", lambda b: b.t.lineitem.groupBy("l_returnflag").agg(S.round_half_up(F.avg("l_discount"), 4).alias("r")), "select l_returnflag, round(avg(l_discount), 4) as r from lineitem group by 1")
simple("section_F21", lambda b: b.t.part.select("p_partkey", S.section(F.concat(F.lit("# Kind\n"), "p_type", F.lit("\n\n## Name\n\n "), "p_name", F.lit("\n# End\n")), "Name").alias("name")), "select p_partkey, p_name as name from part")
