"""A ledger of obligations as a fold over events: compounding interest, overdue marks, payments, settled contracts.

``replay`` folds each debt's events in order with a higher-order aggregate inside one row, after an aggregation that
collects a debt's own events; a debt has at most a few events per chapter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import settled_contracts


def accrue(debts: DataFrame, events: DataFrame, chapter: int) -> tuple[DataFrame, DataFrame]:
    """(debts, new events) after one chapter's interest: active and overdue debts that haven't accrued in it grow by
    their rate; active ones past due turn overdue. A debt that has accrued in the chapter is left as it is. (L-01)"""
    done = events.filter((F.col("event_type") == "interest_accrued") & (F.col("chapter") == chapter)).select(F.col("debt_id").alias("id")).distinct().withColumn("__done", F.lit(True))
    marked = debts.join(done, "id", "left")
    open_now = F.col("status").isin("active", "overdue") & F.col("__done").isNull()
    late = open_now & (F.col("status") == "active") & (F.lit(chapter) > F.col("due_chapter"))
    interest = F.col("current_amount") * F.col("interest_rate")
    after = marked.withColumns({"current_amount": F.when(open_now, F.col("current_amount") + interest).otherwise(F.col("current_amount")), "status": F.when(late, F.lit("overdue")).otherwise(F.col("status"))})
    grown = marked.filter(open_now).select(F.col("id").alias("debt_id"), F.lit("interest_accrued").alias("event_type"), interest.alias("amount"), F.lit(chapter).cast("long").alias("chapter"))
    turned = marked.filter(late).select(F.col("id").alias("debt_id"), F.lit("overdue").alias("event_type"), (F.col("current_amount") + interest).alias("amount"), F.lit(chapter).cast("long").alias("chapter"))
    return after.select(*debts.columns), grown.unionByName(turned)


def accrued_over(debts: DataFrame, first: int, last: int) -> DataFrame:
    """Debts after interest in every chapter of a range, multiplied in order, one chapter at a time. (L-01 replayed)"""
    steps = max(0, last - first + 1)
    open_now = F.col("status").isin("active", "overdue")
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, steps))), F.col("current_amount"), lambda a, _: a + a * F.col("interest_rate")) if steps else F.col("current_amount")
    late = (F.col("status") == "active") & (F.lit(last) > F.col("due_chapter")) & F.lit(steps > 0)
    return debts.withColumns({"current_amount": F.when(open_now, grown).otherwise(F.col("current_amount")), "status": F.when(late, F.lit("overdue")).otherwise(F.col("status"))})


def pay(debts: DataFrame, payments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(debts, events, fulfilled contracts) after one payment per debt; amounts of 0 or less and unknown debts change
    nothing. What is left is never below 0; a debt at 0 is paid; a contract is fulfilled when none of its debts is
    active or overdue. The event holds the amount paid, which may exceed the balance. (L-02, D-08)"""
    good = payments.filter("amount > 0").select(F.col("debt_id").alias("id"), F.col("amount").alias("__paid"), F.col("chapter").alias("__at"))
    got = debts.join(good, "id", "left")
    left = F.greatest(F.lit(0.0), F.col("current_amount") - F.col("__paid"))
    hit = F.col("__paid").isNotNull()
    after = got.withColumns({"current_amount": F.when(hit, left).otherwise(F.col("current_amount")), "status": F.when(hit & (left == 0), F.lit("paid")).otherwise(F.col("status"))})
    events = got.filter(hit).select(F.col("id").alias("debt_id"), F.when(left == 0, F.lit("full_payment")).otherwise(F.lit("partial_payment")).alias("event_type"), F.col("__paid").alias("amount"), F.col("__at").alias("chapter"))
    after_rows = after.select(*debts.columns)
    touched = after.filter(hit & (F.col("status") == "paid")).select("override_contract_id").distinct()
    return after_rows, events, settled_contracts(after_rows).join(touched, "override_contract_id", "left_semi")


def replay(debts: DataFrame, events: DataFrame) -> DataFrame:
    """(id, balance, n_events): the balance as a fold over a debt's events in (chapter, kind, event id) order: interest
    multiplies, payments subtract down to 0. (L-04)

    ``events`` has debt_id, chapter, id, kind ("interest" or "payment") and amount.
    """
    lists = events.groupBy(F.col("debt_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("chapter", "kind", F.col("id").alias("n"), "amount"))).alias("ev"))
    got = debts.join(lists, "id", "left")
    fold = F.aggregate(
        F.coalesce("ev", F.array().cast("array<struct<chapter:bigint,kind:string,n:bigint,amount:double>>")),
        F.col("original_amount"),
        lambda b, e: F.when(e["kind"] == "interest", b + b * F.col("interest_rate")).otherwise(F.greatest(F.lit(0.0), b - e["amount"])),
    )
    return got.select("id", fold.alias("balance"), F.coalesce(F.size("ev"), F.lit(0)).alias("n_events"))
