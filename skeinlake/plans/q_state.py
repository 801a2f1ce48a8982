"""Queries: mutations, ledger, health, context and streaming (families B, L, K, X, Y, streaming)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import context as X
from ..operators import health as K
from ..operators import ledger as L
from ..operators import support as Y
from ..operators import upsert as B
from ..streaming import ingest as S
from .bindings import Bound, day, sql
from .q_lookup import simple
from .registry import query


def _ev(b):
    return b.t.events.select("event_id", "ts", "user_id", "event_type", "value", day().cast("long").alias("day"))


# mutations as views of logs
simple("replace_chapter_B01", lambda b: B.latest_wins(_ev(b), ["user_id", "day"], ["ts", "event_id"]), "select event_id, ts, user_id, event_type, value, date_diff('day', date '2024-01-01', cast(ts as date)) + 1 as day from events qualify row_number() over (partition by user_id, cast(ts as date) order by ts desc, event_id desc) = 1")
simple(
    "replace_partition_B02",
    lambda b: B.replace_partitions(b.t.conversations.select("conv_id", "turn", "role"), b.t.conversations.filter("role = 'system'").select("conv_id", "turn", F.lit("note").alias("role")), "conv_id"),
    "select conv_id, turn, role from conversations where conv_id not in (select conv_id from conversations where role = 'system') union all select conv_id, turn, 'note' from conversations where role = 'system'",
)
simple("first_appearance_B03", lambda b: B.first_wins(_ev(b), ["user_id", "event_type"], ["ts", "event_id"]).drop("day"), "select event_id, ts, user_id, event_type, value from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1")


@query("upsert_entities_B05", sql("""select coalesce(e.id, u.id) as id, case when e.id is not null then e.tier else 'new' end as tier, e.first_appearance, case when u.id is not null then u.last else e.last_appearance end as last_appearance,
case when u.id is not null then cast(u.n as varchar) end as n, e.canonical_name as name from entities e full join (select user_id as id, count(*) as n, max(date_diff('day', date '2024-01-01', cast(ts as date)) + 1) as last from events group by 1) u on e.id = u.id"""))
def upsert_entities(spark, folder):
    b = Bound(spark, folder)
    cols = ["id", "tier", "first_appearance", "last_appearance", "current"]
    old = b.entities.withColumn("current", F.map_filter(F.create_map(F.lit("name"), F.col("canonical_name")), lambda k, v: v.isNotNull())).select(*cols)
    new = b.t.events.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"), F.max(day().cast("long")).alias("last_appearance"))
    new = new.select("id", F.lit("new").alias("tier"), F.lit(None).cast("long").alias("first_appearance"), "last_appearance", F.create_map(F.lit("n"), F.col("n").cast("string")).alias("current"))
    got = B.upsert_entities(old, new, ["tier"])
    return got.select("id", "tier", "first_appearance", "last_appearance", F.col("current")["n"].alias("n"), F.col("current")["name"].alias("name"))


simple("archive_entity_B07", lambda b: B.archive(b.entities.select("id", "is_archived"), b.t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("id"))), "select id, is_archived or id in (select o_custkey from orders where o_totalprice > 400000) as is_archived from entities")
simple(
    "register_alias_B08",
    lambda b: B.insert_if_absent(b.aliases, b.aliases.unionByName(b.t.customer.select(F.col("c_name").alias("alias"), F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("entity_type"))), ["alias", "entity_id", "entity_type"]),
    "select * from aliases union select c_name, c_custkey, c_mktsegment from customer",
)
simple("remove_alias_B08", lambda b: B.remove_keys(b.aliases, b.aliases.filter("alias = 'NATION_3'"), ["alias", "entity_id"]), "select * from aliases where alias <> 'NATION_3'")
simple("upsert_relationship_B10", lambda b: B.latest_wins(b.relationship_events.drop("strength"), ["from_entity", "to_entity", "type"], ["chapter", "id"]), "select id, from_entity, to_entity, type, action, chapter from relationship_events qualify row_number() over (partition by from_entity, to_entity, type order by chapter desc, id desc) = 1")


@query("clean_events_B11", sql("select event_id, event_type as type, case when event_type in ('click', 'view') then 'update' else 'create' end as action, cast(case event_type when 'error' then -1 when 'purchase' then 1 else 0 end as bigint) as polarity, least(greatest(value / 50, 0.0), 1.0) as strength from events where event_type <> 'signup'"))
def clean_events(spark, folder):
    e = Bound(spark, folder).t.events
    raw = e.select(
        "event_id", F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("from_entity"), F.lit("x ").alias("to_entity"), F.when(F.col("event_type") == "signup", "  ").otherwise(F.col("event_type")).alias("type"),
        F.when(F.col("event_type").isin("click", "view"), "bogus").otherwise("create").alias("action"), F.lit(None).cast("long").alias("polarity"), (F.col("value") / 50).alias("strength"), F.lit(None).cast("double").alias("confidence"), F.lit(1).alias("chapter"),
    )
    return B.clean_relationship_events(raw, ["err"], ["purch"]).select("event_id", "type", "action", "polarity", "strength")


simple(
    "frozen_contracts_B12",
    lambda b: B.frozen_upserts(b.contracts.select("constraint_id", "constraint_type", "chapter", "id", "status"), ["constraint_id", "constraint_type"], ["chapter", "id"], "status", ["fulfilled", "cancelled"]),
    "with r as (select constraint_id, constraint_type, chapter, id, status, row_number() over (partition by constraint_id, constraint_type order by chapter, id) as n from contracts), t as (select constraint_id, constraint_type, min(n) filter (status in ('fulfilled', 'cancelled')) as t from r group by 1, 2) select constraint_id, constraint_type, chapter, id, status from r join t using (constraint_id, constraint_type) where n <= coalesce(t, n) qualify row_number() over (partition by constraint_id, constraint_type order by n desc) = 1",
)
simple(
    "review_upsert_B16",
    lambda b: B.latest_wins(b.t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("created"), "o_orderkey", "o_totalprice"), ["k"], ["created", "o_orderkey"], keep_first=["created"]),
    "select k, first_value(created) over w as created, o_orderkey, o_totalprice from (select o_custkey as k, o_orderdate as created, o_orderkey, o_totalprice from orders) window w as (partition by k order by created, o_orderkey) qualify row_number() over (partition by k order by created desc, o_orderkey desc) = 1",
)
simple(
    "resolve_facts_B19",
    lambda b: B.resolve_facts(b.invalid_facts.withColumnRenamed("source_id", "id"), b.t.documents.filter("lang in ('de', 'fr')").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "de", "confirm").otherwise("dismiss").alias("action"), F.lit(1).alias("at"))),
    "select source_id as id, case when lang = 'de' then 'confirmed' else status end as status from invalid_facts join documents on doc_id = source_id where lang <> 'fr'",
)
simple("last_seen_B25", lambda b: B.monotone(b.appearances, ["entity_id"], "chapter", "first"), "select entity_id, max(chapter) as chapter, min(chapter) as first from appearances group by 1")
simple("total_progress_B26", lambda b: Y.progress(b.chapters.select("chapter", F.col("word_count").alias("words"))), "select max(chapter) as current_chapter, cast(sum(word_count) as bigint) as total_words from chapters")
simple(
    "migrate_columns_B28",
    lambda b: B.migrate_columns(b.t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), _typed("id bigint, name string, tier string, score double"), {"tier": F.lit("decor")}),
    "select c_custkey as id, c_name as name, 'decor' as tier, cast(null as double) as score from customer",
)
simple("archive_split_B29", lambda b: B.split_archive(b.contracts, F.col("status") == "fulfilled")[1], "select * from contracts where status = 'fulfilled'")
simple("archive_rest_B29", lambda b: B.split_archive(b.contracts, F.col("status") == "fulfilled")[0], "select * from contracts where status <> 'fulfilled'")


def _typed(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


@query("threads_B30", sql("select content, min(planted) as planted_chapter, min(planted) + 100 as target_chapter, 'sub' as tier, 'open' as status from (select lang as content, doc_id as planted from documents) group by 1"))
def threads_added(spark, folder):
    d = Bound(spark, folder).t.documents.groupBy(F.col("lang").alias("content")).agg(F.min("doc_id").alias("planted_chapter"))
    new = d.withColumns({"target_chapter": F.lit(None).cast("long"), "tier": F.lit(None).cast("string"), "status": F.lit(None).cast("string")})
    return B.add_threads(new.limit(0), new)


@query("ingest_payload_B04_B24", "select conv_id as chapter, count(*) as appearances, cast(sum(length(text)) as bigint) as chars from conversations where role <> 'system' group by 1")
def ingest_payload(spark, folder):
    c = Bound(spark, folder).t.conversations
    seen = F.struct(F.col("turn").cast("string").alias("id"), F.col("role").alias("type"), F.array("text").alias("mentions"), F.lit(0.9).alias("confidence"))
    p = c.groupBy(F.col("conv_id").alias("chapter")).agg(F.collect_list(F.when(F.col("role") != "system", seen)).alias("entities_appeared"))
    typed = p.select("chapter", *[F.lit(None).cast(t).alias(n) for n, t in (("title", "string"), ("location", "string"), ("word_count", "long"), ("summary", "string"))], "entities_appeared",
                     *[F.array().cast(f.dataType).alias(f.name) for f in _typed(_payload()).fields if f.name in ("scenes", "entities_new", "state_changes", "relationships_new", "uncertain")])
    rows = B.ingest(typed)["appearances"]
    return rows.groupBy("chapter").agg(F.count("*").alias("appearances"), F.sum(F.char_length(F.element_at("mentions", 1))).alias("chars"))


def _payload() -> str:
    from ..schemas import PAYLOAD

    return PAYLOAD


# ledger
@query("accrue_L01", sql("""with p as (select debt_id from debt_events where chapter = 23970 group by 1)
select id, round(case when status in ('active', 'overdue') and id not in (select debt_id from p) then current_amount + current_amount * interest_rate else current_amount end, 3) as current_amount,
case when status = 'active' and 23970 > due_chapter and id not in (select debt_id from p) then 'overdue' else status end as status from debts"""))
def accrue(spark, folder):
    b = Bound(spark, folder)
    past = b.debt_events.select("debt_id", "chapter", F.lit("interest_accrued").alias("event_type"))
    return L.accrue(b.debts, past, 23970)[0].select("id", F.round("current_amount", 3).alias("current_amount"), "status")


@query("accrual_events_L01_L03", sql("select id as debt_id, 'interest_accrued' as event_type, round(current_amount * interest_rate, 3) as amount, cast(23970 as bigint) as chapter from debts where status in ('active', 'overdue') union all select id, 'overdue', round(current_amount + current_amount * interest_rate, 3), 23970 from debts where status = 'active' and due_chapter < 23970"))
def accrual_events(spark, folder):
    b = Bound(spark, folder)
    none = b.debt_events.select("debt_id", "chapter", F.lit("x").alias("event_type")).limit(0)
    return L.accrue(b.debts, none, 23970)[1].withColumn("amount", F.round("amount", 3))


@query("accrued_over_L01", sql("""with recursive g as (select id, status, due_chapter, current_amount, 0 as n from debts where status in ('active', 'overdue') union all select id, status, due_chapter, current_amount + current_amount * 0.1, n + 1 from g where n < 5)
select id, round(current_amount, 2) as current_amount from g where n = 5 union all select id, round(current_amount, 2) from debts where status = 'paid'""").replace("with ", "with recursive ", 1).replace(", recursive g", ", g"))
def accrued_over(spark, folder):
    return L.accrued_over(Bound(spark, folder).debts, 23961, 23965).select("id", F.round("current_amount", 2).alias("current_amount"))


@query("pay_L02", sql("""with p as (select debt_id, sum(amount) as paid from debt_events group by 1)
select id, round(case when paid is null then current_amount else greatest(0.0, current_amount - paid) end, 2) as current_amount, case when paid is not null and current_amount <= paid then 'paid' else status end as status from debts left join p on debt_id = id"""))
def pay(spark, folder):
    b = Bound(spark, folder)
    payments = b.debt_events.groupBy("debt_id").agg(F.sum("amount").alias("amount"), F.max("chapter").alias("chapter"))
    return L.pay(b.debts, payments)[0].select("id", F.round("current_amount", 2).alias("current_amount"), "status")


@query("fulfilled_contracts_L02", sql("""with p as (select debt_id, sum(amount) as paid from debt_events group by 1),
d as (select id, override_contract_id as c, paid is not null and (current_amount <= paid or status = 'paid') as hit, case when paid is not null and current_amount <= paid then 'paid' else status end as s from debts left join p on debt_id = id)
select c as override_contract_id from d group by c having bool_and(s not in ('active', 'overdue')) and bool_or(hit)"""))
def fulfilled(spark, folder):
    b = Bound(spark, folder)
    payments = b.debt_events.groupBy("debt_id").agg(F.sum("amount").alias("amount"), F.max("chapter").alias("chapter"))
    return L.pay(b.debts, payments)[2]


_REPLAY = sql("""with ev as (select debt_id, kind, amount, row_number() over (partition by debt_id order by chapter, kind, id) as k from (
select debt_id, chapter, 'payment' as kind, 2 as id, cast(sum(cast(amount as decimal(18, 2))) as double) / 10 as amount from debt_events group by 1, 2 union all select id, due_chapter, 'interest', 1, 0.0 from debts)),
f as (select id, cast(original_amount as double) as balance, interest_rate, 0::bigint as k from debts union all
select f.id, case when kind = 'interest' then balance + balance * interest_rate else greatest(0.0, balance - amount) end, interest_rate, ev.k from f join ev on ev.debt_id = f.id and ev.k = f.k + 1)
select id, cast(round(cast(cast(arg_max(balance, k) as varchar) as decimal(38, 14)), 2) as double) as balance, cast(max(k) as integer) as n_events from f group by id""").replace("with ", "with recursive ", 1)


@query("ledger_replay_L04", _REPLAY)
def ledger_replay(spark, folder):
    b = Bound(spark, folder)
    pays = b.debt_events.groupBy("debt_id", "chapter").agg((F.sum(F.col("amount").cast("decimal(18,2)")).cast("double") / 10).alias("amount")).select("debt_id", "chapter", F.lit("payment").alias("kind"), F.lit(2).cast("long").alias("id"), "amount")
    interest = b.debts.select(F.col("id").alias("debt_id"), F.col("due_chapter").alias("chapter"), F.lit("interest").alias("kind"), F.lit(1).cast("long").alias("id"), F.lit(0.0).alias("amount"))
    return L.replay(b.debts, pays.unionByName(interest)).withColumn("balance", F.round("balance", 2))


# health
simple(
    "absence_K01",
    lambda b: K.characters(b.entities.select("id", "last_appearance"), b.appearances, 24010),
    "select id, last, greatest(0, 24010 - last) as absent_for, case when 24010 - last <= 0 then 'active' when 24010 - last < 30 then 'normal' when 24010 - last < 100 then 'mild' else 'severe' end as status from (select e.id, greatest(coalesce(last_appearance, 0), coalesce(m, 0)) as last from entities e left join (select entity_id, max(chapter) as m from appearances group by 1) a on a.entity_id = e.id)",
)


def _threads(b):
    tier = F.when(F.col("constraint_type") == "1-URGENT", "core").when(F.col("constraint_type") == "2-HIGH", "sub").otherwise("decor")
    return b.contracts.select(F.col("id").alias("content"), F.when(F.col("status") == "fulfilled", "resolved").otherwise("open").alias("status"), tier.alias("tier"), F.col("chapter").alias("planted_chapter"), F.when(F.col("status") != "cancelled", F.col("due_chapter") + 60).alias("target_chapter"))


simple(
    "threads_K02",
    lambda b: K.threads(_threads(b), 24000).select("content", "elapsed", "remaining", "overtime", "urgency", "urgency_status"),
    """select content, elapsed, remaining, case when remaining is null then 'insufficient' when remaining < 0 then 'expired' when remaining < 50 then 'urgent' when remaining < 150 then 'mild' else 'normal' end as overtime, urgency,
case when urgency is null then 'insufficient' when urgency >= 2 then 'critical' when urgency >= 1 then 'warning' else 'normal' end as urgency_status from (
select id as content, greatest(0, 24000 - chapter) as elapsed, t - 24000 as remaining, case when t is null then null when t > chapter then round(greatest(0, 24000 - chapter) / (t - chapter) * w, 2) else round(w * 2, 2) end as urgency
from (select *, case when status <> 'cancelled' then due_chapter + 60 end as t, case constraint_type when '1-URGENT' then 3.0 when '2-HIGH' then 2.0 else 1.0 end as w from contracts where status <> 'fulfilled'))""",
)


@query("strand_violations_K03", """with e as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as n from events),
runs as (select user_id, f, m, count(*) as len from (select user_id, f, m, n - row_number() over (partition by user_id, f, m order by n) as g from (select user_id, n, x.f, event_type = x.f as m from e, (values ('click'), ('view'), ('purchase')) x(f))) group by user_id, f, m, g),
s as (select user_id, coalesce(max(len) filter (f = 'click' and m), 0) as streak, coalesce(max(len) filter (f = 'view' and not m), 0) as g2, coalesce(max(len) filter (f = 'purchase' and not m), 0) as g3 from runs group by 1),
p as (select user_id, count(*) filter (event_type = 'click') * 100.0 / count(*) as p1, count(*) filter (event_type = 'view') * 100.0 / count(*) as p2, count(*) filter (event_type = 'purchase') * 100.0 / count(*) as p3 from events group by 1)
select user_id, streak, concat_ws(',', case when streak > 5 then 'streak' end, case when g2 > 10 then 'gap_second' end, case when g3 > 15 then 'gap_third' end, case when p1 < 55 or p1 > 65 then 'pct_1' end, case when p2 < 20 or p2 > 30 then 'pct_2' end, case when p3 < 10 or p3 > 20 then 'pct_3' end) as violations from s join p using (user_id)""")
def strand_violations(spark, folder):
    from ..operators.aggregates import shares
    from ..operators.windows import longest_runs

    e = Bound(spark, folder).t.events.withColumn("day", day())
    out = shares(e, "event_type", ["click", "view", "purchase"], ["user_id"]).withColumnsRenamed({"pct_click": "pct_1", "pct_view": "pct_2", "pct_purchase": "pct_3"})
    for kind, run, name in (("click", "longest_run", "streak"), ("view", "longest_gap", "gap_second"), ("purchase", "longest_gap", "gap_third")):
        got = longest_runs(e, "user_id", "day", ["ts", "event_id"], F.col("event_type") == kind)
        out = out.join(got.select("user_id", F.col(run).alias(name)), "user_id")
    return K.strand_violations(out).select("user_id", "streak", F.array_join("violations", ",").alias("violations"))


_POINTS = ["thing", "que el", "der ver"]


@query("pacing_K04", """with d as (select doc_id, row_number() over (order by doc_id) - 1 as p, n_chars as words, source, """ + " + ".join(f"(length(text) - length(replace(text, '{w}', ''))) // {len(w)}" for w in _POINTS) + """ as k from documents),
s as (select *, p // 100 as segment, case when k > 0 then k end as points from d),
m as (select segment, source from (select segment, source, count(*) as n, min(p) as at_p from s where points is not null group by 1, 2) qualify row_number() over (partition by segment order by n desc, at_p) = 1)
select segment, count(*) as chapters, cast(sum(words) as bigint) as words, cast(coalesce(sum(points), 0) as bigint) as points, count(*) filter (points is null) as missing, any_value(m.source) as dominant_source, round(sum(words) / nullif(sum(points), 0), 2) as words_per_point,
case when coalesce(sum(points), 0) = 0 then 'insufficient' when sum(words) / sum(points) < 1000 then 'excellent' when sum(words) / sum(points) < 1500 then 'good' when sum(words) / sum(points) < 2000 then 'fair' else 'low' end as rating from s left join m using (segment) group by segment""")
def pacing(spark, folder):
    d = Bound(spark, folder).t.documents.select("doc_id", F.col("n_chars").alias("words"), "source", K.points_by_keywords(F.col("text"), _POINTS).alias("points"))
    return K.pacing(K.positions(d, ["doc_id"])).withColumn("words_per_point", F.round("words_per_point", 2))


simple(
    "risk_flags_K07",
    lambda b: K.risk_flags(b.t.orders.groupBy("o_custkey").agg((F.avg("o_totalprice") / 3000).alias("overall_avg"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("critical"), F.count_if(F.col("o_orderpriority") == "2-HIGH").alias("high"), (F.min("o_totalprice") / 1000).alias("checklist_avg"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("completion"))).select("o_custkey", F.array_join("flags", ",").alias("flags")),
    """select o_custkey, coalesce(nullif(concat_ws(',', case when o < 75 then 'low_overall' end, case when c > 0 then 'critical' when h >= 5 then 'many_high' end, case when l < 80 then 'low_checklist' end, case when d < 0.7 then 'low_completion' end), ''), 'stable') as flags
from (select o_custkey, avg(o_totalprice) / 3000 as o, count(*) filter (o_orderpriority = '1-URGENT') as c, count(*) filter (o_orderpriority = '2-HIGH') as h, min(o_totalprice) / 1000 as l, avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end) as d from orders group by 1)""",
)
simple("opening_checks_K09", lambda b: b.chapters.select("chapter", *[c.alias(n) for n, c in K.opening_checks(F.col("summary"), {"hook": (["idiot", "que", "the"], 2), "setting": (["der"], 1)}).items()]), "select chapter, cast(contains(summary, 'idiot') as int) + cast(contains(summary, 'que') as int) + cast(contains(summary, 'the') as int) >= 2 as hook, contains(summary, 'der') as setting from chapters")
simple("parse_tags_K10", lambda b: b.t.pages.select("page_id", K.parse_tags(F.col("html"), ["title", "h1"]).alias("x")).select("page_id", F.col("x.title").alias("title")), "select page_id, nullif(regexp_extract(html, '(?s)<title>\\s*(.*?)\\s*</title>', 1), '') as title from pages")
simple("inactive_K12", lambda b: K.inactive(b.entities, 24010, 20), "select * from entities where tier <> 'core' and last_appearance > 0 and 24010 - last_appearance >= 20")
simple("resolved_K13", lambda b: K.resolved_threads(b.contracts.select("id", F.when(F.col("status") == "fulfilled", "resolved").otherwise("open").alias("status"), F.col("due_chapter").alias("resolved_chapter")), 24000), "select id, 'resolved' as status, due_chapter as resolved_chapter from contracts where status = 'fulfilled' and 24000 - due_chapter >= 20")
simple("old_reviews_K14", lambda b: K.old_reviews(b.contracts.select("id", F.concat("chapter", F.lit("-"), "due_chapter").alias("chapters")), 24000).select("id", "end_chapter"), "select id, due_chapter as end_chapter from contracts where 24000 - due_chapter >= 50")
simple("missing_steps_K15", lambda b: b.reading_power.select("chapter", F.array_join(K.missing_steps(F.array(F.lit("small"), F.lit("red"), F.lit("ring")), F.col("coolpoint_patterns")), ",").alias("missing")), "select chapter, array_to_string(list_filter(['small', 'red', 'ring'], lambda x: not list_contains(coolpoint_patterns, x)), ',') as missing from reading_power")
simple("monotony_S15", lambda b: K.monotony(b.t.orders, "o_orderpriority", 0.8).select(F.round("top_share", 6).alias("top_share"), "monotone"), "select round(max(n) / sum(n), 6) as top_share, max(n) / sum(n) > 0.8 as monotone from (select count(*) as n from orders group by o_orderpriority)")

# context
_HINTS = ["idiot", "que el"]
simple(
    "rank_summaries_X02",
    lambda b: X.rank_summaries(b.chapters.select("chapter", "summary"), 150, _HINTS).select("chapter", F.round("score", 6).alias("score")),
    "select chapter, round(0.7 * (1.0 / (1 + greatest(0, 150 - chapter))) + 0.3 * (least(length(summary) / 1200.0, 1.0) * 0.2) + 0.2 * (case when contains(summary, 'idiot') or contains(summary, 'que el') then 1.0 else 0.0 end), 6) as score from chapters",
)
simple("rank_meta_X03", lambda b: X.rank_meta(b.chapters.select("chapter", F.when(F.col("location") != "de", F.col("title")).alias("hook")), 150).select("chapter", F.round("score", 6).alias("score")), "select chapter, round(0.7 * (1.0 / (1 + greatest(0, 150 - chapter))) + 0.3 * (least(coalesce(length(h), 0) / 1200.0, 1.0) * 0.2) + 0.2 * (case when h is not null then 1.0 else 0.0 end), 6) as score from (select chapter, case when location <> 'de' then title end as h from chapters)")
simple(
    "rank_appearances_X04",
    lambda b: X.rank_appearances(b.appearances.groupBy("entity_id").agg(F.max("chapter").alias("last_chapter"), F.count("*").alias("total")), 30).select("entity_id", F.round("score", 6).alias("score")),
    "select entity_id, round(0.7 * (1.0 / (1 + greatest(0, 30 - l))) + 0.3 * least(1.0, ln(1 + n) / ln(11.0)), 6) as score from (select entity_id, max(chapter) as l, count(*) as n from appearances group by 1)",
)
simple("rank_skeleton_X05", lambda b: X.rank_summaries(b.chapters.select("chapter", "summary"), 150, []).select("chapter", F.round("score", 6).alias("score")), "select chapter, round(0.7 * (1.0 / (1 + greatest(0, 150 - chapter))) + 0.3 * (least(length(summary) / 1200.0, 1.0) * 0.2), 6) as score from chapters")
simple("rank_alerts_X06", lambda b: X.rank_alerts(b.t.events.select("event_id", F.col("event_type").alias("message"), day().alias("chapter"), F.when(F.col("value") > 90, "Critical").otherwise("low").alias("severity")), 30, ["err"]).select("event_id", F.round("score", 6).alias("score")), "select event_id, round(1.0 / (1 + greatest(0, 30 - (date_diff('day', date '2024-01-01', cast(ts as date)) + 1))) + case when value > 90 then 0.3 else 0.0 end + case when contains(event_type, 'err') then 0.3 else 0.0 end, 6) as score from events")
simple(
    "budgets_X08",
    lambda b: X.budgets(b.chapters.select("chapter", F.col("location").alias("section"), F.col("summary").alias("content")), {"en": 0.4, "de": 0.1}, 1000, ["fr"]).select("chapter", F.col("budget").cast("long").alias("budget"), F.char_length("text").cast("long").alias("n")),
    "select chapter, cast(case location when 'en' then 400 when 'de' then 100 when 'fr' then 800 end as bigint) as budget, least(length(summary), case location when 'en' then 400 when 'de' then 100 when 'fr' then 800 else length(summary) end) as n from chapters",
)


@query("checklist_score_X10", """select l_orderkey as chapter, count(*) as total_items, count(*) filter (r) as required_items, count(*) filter (d) as completed_items, round(count(*) filter (d) * 1.0 / count(*), 4) as completion_rate,
round(greatest(0.0, least(100.0, 100.0 * (0.5 * (coalesce(sum(w) filter (d), 0.0) / sum(w)) + 0.3 * (case when count(*) filter (r) > 0 then count(*) filter (d and r) * 1.0 / count(*) filter (r) else 1.0 end) + 0.2 * (count(*) filter (d) * 1.0 / count(*))))), 2) as score
from (select l_orderkey, l_returnflag = 'R' as r, l_linestatus = 'F' as d, l_quantity as w from lineitem) group by 1""")
def checklist_score(spark, folder):
    items = Bound(spark, folder).t.lineitem.select(F.col("l_orderkey").alias("chapter"), (F.col("l_returnflag") == "R").alias("required"), (F.col("l_linestatus") == "F").alias("done"), F.col("l_quantity").alias("weight"))
    return X.checklist_score(items).select("chapter", "total_items", "required_items", "completed_items", "completion_rate", "score")


simple("dominant_hook_X11", lambda b: X.dominant(b.reading_power, "hook_type"), "select hook_type, n from (select hook_type, count(*) as n, min(chapter) as c from reading_power group by 1) order by n desc, c limit 1")
simple(
    "pick_rules_X12",
    lambda b: X.pick_rules(b.t.lineitem.select(F.col("l_orderkey").alias("pack"), F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("priority")), 2, 3, "pack").select("pack", "id", F.col("place").cast("long").alias("place"), "enough"),
    "select pack, id, row_number() over (partition by pack order by priority, id) as place, count(*) over (partition by pack) >= 2 as enough from (select l_orderkey as pack, l_partkey as id, min(l_linenumber) as priority from lineitem group by 1, 2) qualify place <= 3",
)
simple("style_candidates_X13", lambda b: X.style_candidates(b.chapters.select("chapter", F.col("summary").alias("content"), F.least(F.col("word_count") / 10, F.lit(100)).alias("score"))).select("chapter", F.char_length("content").cast("long").alias("n"), F.round("score", 6).alias("score")), "select chapter, least(length(summary), 2000) as n, round(least(word_count / 10, 100) / 100, 6) as score from chapters where least(word_count / 10, 100) >= 80 and length(summary) >= 200")
simple("uncertain_warnings_X14", lambda b: X.route_uncertain(b.appearances)[0], "select *, case when confidence >= 0.8 then 'auto' else 'warn' end as band from appearances where confidence >= 0.5")
simple("uncertain_pending_X14", lambda b: X.route_uncertain(b.appearances)[1], "select *, 'manual' as band from appearances where confidence < 0.5")
simple("urgent_threads_X16", lambda b: X.urgent(K.threads(_threads(b), 24000), 0.5, 3).select("content", "urgency"), "select id as content, urgency from (select id, round(greatest(0, 24000 - chapter) / 63 * case constraint_type when '1-URGENT' then 3.0 when '2-HIGH' then 2.0 else 1.0 end, 2) as urgency from contracts where status = 'pending') where urgency > 0.5 order by urgency desc, content limit 3")
simple("export_context_Y15", lambda b: Y.export_for_context(b.entities, 24005), "select id, type, canonical_name, tier, last_appearance from entities where coalesce(last_appearance, 0) <= 24005 order by last_appearance desc nulls last, id limit 50")


_STATES = """with recursive e as (select conv_id as task, row_number() over (partition by conv_id order by turn) as k, case when turn = 0 then 'start' when role = 'user' then 'step' else 'done' end as kind, cast((turn + 1) // 2 as varchar) as step from conversations),
s as (select distinct conv_id as task, 0::bigint as k, 'none' as status, null::varchar as step, 0 as retries, 0 as failed, [null::varchar][2:] as done from conversations union all
select s.task, e.k, case when kind = 'start' then 'running' else status end,
case when status = 'running' and kind = 'step' then e.step when kind = 'start' or (kind = 'done' and status = 'running' and coalesce(s.step = e.step, false)) then null else s.step end,
retries + case when status = 'running' and kind = 'start' then 1 else 0 end, failed + case when status = 'running' and s.step is not null and kind = 'step' then 1 else 0 end,
case when kind = 'done' and status = 'running' and coalesce(s.step = e.step, false) then list_append(done, e.step) else done end
from s join e on e.task = s.task and e.k = s.k + 1)
select task, status, step, retries, failed, array_to_string(done, ',') as done from s qualify row_number() over (partition by task order by k desc) = 1"""


@query("task_states_Y33", _STATES)
def task_states(spark, folder):
    kind = F.when(F.col("turn") == 0, "start").when(F.col("role") == "user", "step").otherwise("done")
    c = Bound(spark, folder).t.conversations
    return Y.task_state(c.select(F.col("conv_id").alias("task"), F.col("turn").alias("n"), kind.alias("event"), F.floor((F.col("turn") + 1) / 2).cast("string").alias("step")))


# event time (an extension) and streaming
simple("tumbling_S01", lambda b: S.tumbling(b.t.events, "ts", "1 day", ["event_type"]), "select date_trunc('day', ts) as start, event_type, count(*) as n from events group by 1, 2")
simple("sliding_S02", lambda b: S.sliding(b.t.events, "ts", "2 days", "1 day", ["event_type"]), "select start, event_type, count(*) as n from (select date_trunc('day', ts) as start, event_type from events union all select date_trunc('day', ts) - interval 1 day, event_type from events) group by 1, 2")
simple(
    "sessions_S03",
    lambda b: S.sessions(b.t.events, "ts", "6 hours", ["user_id"]),
    "select min(ts) as start, user_id, count(*) as n from (select *, sum(case when p is null or ts >= p + interval 6 hour then 1 else 0 end) over (partition by user_id order by ts, event_id) as s from (select *, lag(ts) over (partition by user_id order by ts, event_id) as p from events)) group by user_id, s",
)


@query("streamed_counts_S04", "select event_type, count(*) as n, round(sum(value), 4) as total from events group by 1")
def streamed_counts(spark, folder):
    """The same aggregate read as a stream, run to the end of what is there."""
    from ..operators.storage import shared_root

    kinds = spark.read.parquet(f"{folder}/events.parquet").schema
    # A file source takes folders: a single file is named by its parent and a pattern.
    src = spark.readStream.schema(kinds).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/events.parque[t]")
    got = src.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return S.run_to_table(got, f"counts_{uuid.uuid4().hex}", f"{shared_root(spark)}/{uuid.uuid4().hex}")
