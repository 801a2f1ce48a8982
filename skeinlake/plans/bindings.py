"""The data model's tables, bound to the tables of a data folder, and the same bindings as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import Tables

#: Name -> SQL of the binding.
VIEWS: dict[str, str] = {
    "chapters": "select doc_id as chapter, source as title, lang as location, n_chars as word_count, text as summary from documents",
    "scenes": "select conv_id as chapter, turn as scene_index, role as location, text as summary from conversations",
    "appearances": "select user_id as entity_id, date_diff('day', date '2024-01-01', cast(ts as date)) + 1 as chapter, count(*) as mentions, least(1.0, count(*) / 4.0) as confidence from events group by 1, 2",
    "activity": "select o_custkey as id, min(year(o_orderdate) * 12 + month(o_orderdate)) as first_appearance, max(year(o_orderdate) * 12 + month(o_orderdate)) as last_appearance from orders group by 1",
    "entities": "select c.c_custkey as id, c_mktsegment as type, c_name as canonical_name, case when c_acctbal > 7500 then 'core' when c_acctbal > 5000 then 'important' when c_acctbal > 2500 then 'secondary' else 'decor' end as tier, a.first_appearance, a.last_appearance, c_acctbal > 9900 as is_protagonist, c_acctbal < 0 as is_archived from customer c left join activity a on a.id = c.c_custkey",
    "aliases": "select n_name as alias, c_custkey as entity_id, c_mktsegment as entity_type from customer join nation on n_nationkey = c_nationkey",
    "state_changes": "select event_id as id, user_id as entity_id, event_type as field, value as new_value, date_diff('day', date '2024-01-01', cast(ts as date)) + 1 as chapter from events",
    "relationships": "select l_suppkey as from_entity, l_partkey as to_entity, l_returnflag as type, max(year(l_shipdate) * 12 + month(l_shipdate)) as chapter from lineitem group by 1, 2, 3",
    "relationship_events": "select event_id as id, user_id as from_entity, cast(json_extract_string(props, '$.k') as bigint) as to_entity, 'link' as type, case event_type when 'error' then 'remove' when 'signup' then 'create' else 'update' end as action, least(1.0, value / 100) as strength, date_diff('day', date '2024-01-01', cast(ts as date)) + 1 as chapter from events",
    "links": "select user_id as from_entity, cast(json_extract_string(props, '$.k') as bigint) as to_entity, 'link' as type, max(date_diff('day', date '2024-01-01', cast(ts as date)) + 1) as chapter from events where event_type <> 'error' group by 1, 2",
    "contracts": "select o_orderkey as id, year(o_orderdate) * 12 + month(o_orderdate) as chapter, o_orderpriority as constraint_type, o_custkey as constraint_id, year(o_orderdate) * 12 + month(o_orderdate) + 3 as due_chapter, case o_orderstatus when 'O' then 'pending' when 'F' then 'fulfilled' else 'cancelled' end as status from orders",
    "debts": "select o_orderkey as id, o_orderpriority as debt_type, o_totalprice as original_amount, o_totalprice as current_amount, cast(0.1 as double) as interest_rate, year(o_orderdate) * 12 + month(o_orderdate) as source_chapter, year(o_orderdate) * 12 + month(o_orderdate) + 3 as due_chapter, o_custkey as override_contract_id, case o_orderstatus when 'O' then 'active' when 'F' then 'paid' else 'overdue' end as status from orders",
    "debt_events": "select l_orderkey as debt_id, l_extendedprice as amount, year(l_shipdate) * 12 + month(l_shipdate) as chapter, cast(l_linenumber as bigint) as n from lineitem",
    "reading_power": "select p_partkey as chapter, p_brand as hook_type, p_type as hook_strength, string_split(p_name, ' ') as coolpoint_patterns, p_retailprice as debt_balance from part",
    "reviews": "select year(o_orderdate) * 12 + month(o_orderdate) as end_chapter, year(o_orderdate) * 12 + month(o_orderdate) as start_chapter, avg(o_totalprice) / 5000 as overall_score from orders group by 1, 2",
    "review_parts": "select year(o_orderdate) * 12 + month(o_orderdate) as end_chapter, o_orderpriority as name, avg(o_totalprice) as score, count(*) as n from orders group by 1, 2",
    "checklists": "select year(l_shipdate) * 12 + month(l_shipdate) as chapter, count(*) as total_items, count(*) filter (l_returnflag = 'R') as required_items, count(*) filter (l_linestatus = 'F') as completed_items, count(*) filter (l_linestatus = 'F' and l_returnflag = 'R') as completed_required, round(count(*) filter (l_linestatus = 'F') * 1.0 / count(*), 4) as completion_rate, avg(l_quantity) as score from lineitem group by 1",
    "invalid_facts": "select doc_id as source_id, case when toxic = 1 then 'confirmed' else 'pending' end as status from labels where toxic = 1 or quality = 0",
    "samples": "select p_partkey as id, p_type as scene_type, p_name as content, p_retailprice as score from part",
    "tool_calls": "select event_id as id, event_type as tool_name, event_type <> 'error' as success, ts from events",
}


def sql(body: str) -> str:
    """A query over the bindings it names, as SQL over the raw tables."""
    import re

    need: list[str] = []

    def want(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b(?:from|join) {name}\b", text) and name not in need:
                want(VIEWS[name])
                need.append(name)

    want(body)
    head = ", ".join(f"{n} as ({VIEWS[n]})" for n in need)
    return f"with {head} {body}" if need and not body.lstrip().startswith("with ") else f"with {head}, {body.lstrip()[5:]}" if need else body


def day(ts: str = "ts"):
    return F.datediff(F.col(ts), F.lit("2024-01-01").cast("date")) + 1


def month(col: str):
    return F.year(col) * 12 + F.month(col)


class Bound:
    """The bindings as frames: ``Bound(spark, folder).entities``."""

    def __init__(self, spark, folder: str):
        self.t = Tables(spark, folder)

    def __getattr__(self, name: str) -> DataFrame:
        return getattr(Bound, f"_{name}")(self) if hasattr(Bound, f"_{name}") else getattr(self.t, name)

    def _chapters(self):
        return self.t.documents.select(F.col("doc_id").alias("chapter"), F.col("source").alias("title"), F.col("lang").alias("location"), F.col("n_chars").alias("word_count"), F.col("text").alias("summary"))

    def _scenes(self):
        return self.t.conversations.select(F.col("conv_id").alias("chapter"), F.col("turn").alias("scene_index"), F.col("role").alias("location"), F.col("text").alias("summary"))

    def _appearances(self):
        return self.t.events.groupBy(F.col("user_id").alias("entity_id"), day().cast("long").alias("chapter")).agg(F.count("*").alias("mentions"), F.least(F.lit(1.0), F.count("*") / 4.0).alias("confidence"))

    def _activity(self):
        m = month("o_orderdate").cast("long")
        return self.t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.min(m).alias("first_appearance"), F.max(m).alias("last_appearance"))

    def _entities(self):
        bal = F.col("c_acctbal")
        tier = F.when(bal > 7500, "core").when(bal > 5000, "important").when(bal > 2500, "secondary").otherwise("decor")
        c = self.t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("type"), F.col("c_name").alias("canonical_name"), tier.alias("tier"), (bal > 9900).alias("is_protagonist"), (bal < 0).alias("is_archived"))
        return c.join(self._activity(), "id", "left").select("id", "type", "canonical_name", "tier", "first_appearance", "last_appearance", "is_protagonist", "is_archived")

    def _aliases(self):
        c, n = self.t.customer, self.t.nation
        return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("n_name").alias("alias"), F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("entity_type"))

    def _state_changes(self):
        return self.t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("field"), F.col("value").alias("new_value"), day().cast("long").alias("chapter"))

    def _relationships(self):
        return self.t.lineitem.groupBy(F.col("l_suppkey").alias("from_entity"), F.col("l_partkey").alias("to_entity"), F.col("l_returnflag").alias("type")).agg(F.max(month("l_shipdate").cast("long")).alias("chapter"))

    def _k(self):
        return F.get_json_object("props", "$.k").cast("long")

    def _relationship_events(self):
        action = F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "signup", "create").otherwise("update")
        return self.t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("from_entity"), Bound._k(self).alias("to_entity"), F.lit("link").alias("type"), action.alias("action"), F.least(F.lit(1.0), F.col("value") / 100).alias("strength"), day().cast("long").alias("chapter"))

    def _links(self):
        return self.t.events.filter("event_type <> 'error'").groupBy(F.col("user_id").alias("from_entity"), Bound._k(self).alias("to_entity"), F.lit("link").alias("type")).agg(F.max(day().cast("long")).alias("chapter"))

    def _contracts(self):
        m, s = month("o_orderdate").cast("long"), F.col("o_orderstatus")
        return self.t.orders.select(F.col("o_orderkey").alias("id"), m.alias("chapter"), F.col("o_orderpriority").alias("constraint_type"), F.col("o_custkey").alias("constraint_id"), (m + 3).alias("due_chapter"), F.when(s == "O", "pending").when(s == "F", "fulfilled").otherwise("cancelled").alias("status"))

    def _debts(self):
        m, s = month("o_orderdate").cast("long"), F.col("o_orderstatus")
        return self.t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("debt_type"), F.col("o_totalprice").alias("original_amount"), F.col("o_totalprice").alias("current_amount"), F.lit(0.1).alias("interest_rate"), m.alias("source_chapter"), (m + 3).alias("due_chapter"), F.col("o_custkey").alias("override_contract_id"), F.when(s == "O", "active").when(s == "F", "paid").otherwise("overdue").alias("status"))

    def _debt_events(self):
        return self.t.lineitem.select(F.col("l_orderkey").alias("debt_id"), F.col("l_extendedprice").alias("amount"), month("l_shipdate").cast("long").alias("chapter"), F.col("l_linenumber").cast("long").alias("n"))

    def _reading_power(self):
        return self.t.part.select(F.col("p_partkey").alias("chapter"), F.col("p_brand").alias("hook_type"), F.col("p_type").alias("hook_strength"), F.split("p_name", " ").alias("coolpoint_patterns"), F.col("p_retailprice").alias("debt_balance"))

    def _reviews(self):
        """Reviews with their maps of dimension scores and severity counts."""
        m = month("o_orderdate").cast("long")
        per = self.t.orders.groupBy(m.alias("end_chapter"), "o_orderpriority").agg(F.avg("o_totalprice").alias("a"), F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
        return per.groupBy("end_chapter").agg(
            (F.sum("s") / F.sum("n") / 5000).alias("overall_score"),
            F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "a"))).alias("dimension_scores"),
            F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("severity_counts"),
        ).withColumn("start_chapter", F.col("end_chapter"))

    def _checklists(self):
        f, r = F.col("l_linestatus") == "F", F.col("l_returnflag") == "R"
        got = self.t.lineitem.groupBy(month("l_shipdate").cast("long").alias("chapter")).agg(F.count("*").alias("total_items"), F.count_if(r).alias("required_items"), F.count_if(f).alias("completed_items"), F.count_if(f & r).alias("completed_required"), F.avg("l_quantity").alias("score"))
        return got.withColumn("completion_rate", F.round(F.col("completed_items") / F.col("total_items"), 4))

    def _invalid_facts(self):
        return self.t.labels.filter("toxic = 1 or quality = 0").select(F.col("doc_id").alias("source_id"), F.when(F.col("toxic") == 1, "confirmed").otherwise("pending").alias("status"))

    def _samples(self):
        return self.t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("scene_type"), F.col("p_name").alias("content"), F.col("p_retailprice").alias("score"))

    def _tool_calls(self):
        return self.t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("tool_name"), (F.col("event_type") != "error").alias("success"), "ts")
