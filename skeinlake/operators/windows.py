"""Ordered-sequence analytics: runs, gaps, positions, retention, set-like helpers.

Longest runs are computed from summaries of blocks of a sequence (its length, whether all match, the runs at both ends,
the best run), which are then folded in order. A key with most of the rows is spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookup import per_group_top


def longest_runs(df: DataFrame, key: str, block: str, order: list[str], match: Column) -> DataFrame:
    """Per key: rows, longest run of matching rows and longest run of others. (W-01, W-02)

    ``block`` must not fall along ``order`` (for instance the day of a time stamp); the gap includes what precedes the
    first and follows the last match.
    """
    w = Window.partitionBy(key, block).orderBy(*order)
    m = F.coalesce(match, F.lit(False))
    rows = df.select(key, block, *[c for c in order if c not in (key, block)], m.alias("__m"))
    rows = rows.withColumn("__n", F.row_number().over(w))
    rows = rows.withColumn("__i", F.col("__n") - F.row_number().over(Window.partitionBy(key, block, "__m").orderBy(*order)))
    islands = rows.groupBy(key, block, "__m", "__i").agg(F.count("*").alias("len"), F.min("__n").alias("from"), F.max("__n").alias("to"))
    total = F.sum("len").over(Window.partitionBy(key, block))
    islands = islands.withColumn("size", total)
    parts = []
    for flag, tag in ((True, "a"), (False, "b")):
        on = F.col("__m") == flag
        parts += [
            F.coalesce(F.max(F.when(on, F.col("len"))), F.lit(0)).alias(f"{tag}_best"),
            F.coalesce(F.max(F.when(on & (F.col("from") == 1), F.col("len"))), F.lit(0)).alias(f"{tag}_head"),
            F.coalesce(F.max(F.when(on & (F.col("to") == F.col("size")), F.col("len"))), F.lit(0)).alias(f"{tag}_tail"),
        ]
    blocks = islands.groupBy(key, block).agg(F.max("size").alias("size"), *parts)
    fields = ["size", "a_best", "a_head", "a_tail", "b_best", "b_head", "b_tail"]
    lists = blocks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(block).alias("at"), *fields))).alias("s"), F.sum("size").alias("n"))

    def fold(tag: str) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("best"), F.lit(0).cast("long").alias("tail"))

        def step(acc: Column, x: Column) -> Column:
            joined = acc["tail"] + x[f"{tag}_head"]
            best = F.greatest(acc["best"], x[f"{tag}_best"], joined)
            return F.struct(best.cast("long").alias("best"), F.when(x[f"{tag}_head"] == x["size"], joined).otherwise(x[f"{tag}_tail"]).cast("long").alias("tail"))

        return F.aggregate("s", zero, step)["best"]

    return lists.select(key, "n", fold("a").alias("longest_run"), fold("b").alias("longest_gap"))


def run_since_switch(df: DataFrame, key: str, order: list[str], label: str, block: Column | None = None) -> DataFrame:
    """Each row with the length so far of the run of its label. (W-07)

    With ``block``, which must not fall along ``order``, runs are counted within the blocks of a key and what a block
    takes over from those before it is folded from one summary a block, so no task gets a key as a whole.
    """
    rows = df.withColumn("__b", F.lit(0) if block is None else block)
    w = Window.partitionBy(key, "__b").orderBy(*order)
    rows = rows.withColumn("__n", F.row_number().over(w))
    rows = rows.withColumn("__i", F.col("__n") - F.row_number().over(Window.partitionBy(key, "__b", label).orderBy(*order)))
    rows = rows.withColumn("__run", F.row_number().over(Window.partitionBy(key, "__b", label, "__i").orderBy(*order)))
    if block is None:
        return rows.select(*df.columns, F.col("__run").alias("run"))
    at = F.col("__n")
    blocks = rows.groupBy(key, "__b").agg(F.max("__n").alias("size"), F.max_by(label, at).alias("last"), F.max_by("__run", at).alias("tail"), F.min_by(label, at).alias("head"))
    before = Window.partitionBy(key).orderBy("__b")
    # A block of one label continues the run before it, any other starts a new one with its last label.
    whole = (F.col("tail") == F.col("size")) & F.lag("last").over(before).eqNullSafe(F.col("head"))
    blocks = blocks.withColumn("__g", F.when(whole, 0).otherwise(1)).withColumn("__g", F.sum("__g").over(before))
    upto = Window.partitionBy(key, "__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.withColumn("__sum", F.sum("tail").over(upto))
    blocks = blocks.select(key, "__b", F.lag("last").over(before).alias("__was"), F.coalesce(F.lag("__sum").over(before), F.lit(0)).alias("__had"))
    got = rows.join(blocks, [key, "__b"])
    goes_on = (F.col("__run") == F.col("__n")) & F.col("__was").eqNullSafe(F.col(label)) & (F.col("__had") > 0)
    return got.select(*df.columns, (F.col("__run") + F.when(goes_on, F.col("__had")).otherwise(0)).alias("run"))


def window_slice(df: DataFrame, now: int, width: int, at: str = "chapter") -> DataFrame:
    """Chapters within [max(1, now - width), now). (W-05)"""
    return df.filter((F.col(at) >= max(1, now - width)) & (F.col(at) < now))


def stride_sample(df: DataFrame, now: int, stride: int = 20, most: int = 5, at: str = "chapter", text: str = "summary") -> DataFrame:
    """Every ``stride``-th chapter back from now - stride, the latest ``most`` with a text, in ascending order. (W-06)"""
    some = df.filter((F.col(at) > 0) & (F.col(at) <= now - stride) & (F.pmod(F.lit(now) - F.col(at), F.lit(stride)) == 0) & (F.coalesce(F.length(F.trim(text)), F.lit(0)) > 0))
    return some.orderBy(F.desc(at)).limit(most).orderBy(at)


def retain_last(df: DataFrame, n: int, key: str | None, order: list[str]) -> DataFrame:
    """The last ``n`` rows, of each key if there is one; a key's rows aren't brought together. (W-08)"""
    if key is None:
        return df.orderBy(*[F.desc(c) for c in order]).limit(n)
    return per_group_top(df, key, n, *[f"{c} desc" for c in order])


def ranks(df: DataFrame, score: str, tie: str) -> DataFrame:
    """0-based position by score descending (W-04). For top-k lists, whose size bounds the one window partition."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.col(tie))) - 1)


def union_ids(*frames: DataFrame) -> DataFrame:
    """Ids of any of the lists, once. (U-01)"""
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out.distinct()


def keep_max(a: DataFrame, b: DataFrame, key: str, score: str = "score") -> DataFrame:
    """Rows of both lists, the higher score of each key. (U-02)"""
    both = a.unionByName(b)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(score, F.to_json(F.struct(*rest)))).alias("__m")).select(key, *[f"__m.{c}" for c in rest])


def ordered_distinct(col: Column) -> Column:
    """Elements at their first place. (U-03)"""
    return F.array_distinct(col)
