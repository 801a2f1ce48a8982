"""Point lookups, optional predicates, top-k lists and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_key(spec: str) -> Column:
    """``"chapter desc"`` or ``"id"``; nulls first ascending, last descending."""
    name, _, way = spec.partition(" ")
    return F.col(name).desc_nulls_last() if way.strip() == "desc" else F.col(name).asc_nulls_first()


def where(df: DataFrame, **equal) -> DataFrame:
    """Rows equal in every given column; None leaves a column free. (C-01..C-10, C-17, C-19, C-20, C-24, C-25)"""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def between(df: DataFrame, col: str, low=None, high=None) -> DataFrame:
    """Closed range; None leaves a side open. (C-13, C-14, W-05)"""
    if low is not None:
        df = df.filter(F.col(col) >= F.lit(low))
    if high is not None:
        df = df.filter(F.col(col) <= F.lit(high))
    return df


def top(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in a total order; n <= 0 gives none. (T-01..T-10, C-22, E-01)"""
    return df.orderBy(*[order_key(o) for o in order]).limit(max(0, n))


def page(df: DataFrame, number: int, size: int, *order: str) -> DataFrame:
    """Page ``number`` (from 1, clamped to 1) of ``size`` rows. (T-13)"""
    return df.orderBy(*[order_key(o) for o in order]).offset((max(1, number) - 1) * size).limit(size)


def touching(df: DataFrame, entity, direction: str = "both", a: str = "from_entity", b: str = "to_entity") -> DataFrame:
    """Edges from, to, or at either end of an entity. (C-11)"""
    here, there = F.col(a) == F.lit(entity), F.col(b) == F.lit(entity)
    return df.filter({"from": here, "to": there, "both": here | there}[direction])


def linking(df: DataFrame, one, other, a: str = "from_entity", b: str = "to_entity") -> DataFrame:
    """Edges between two entities in either direction. (C-12, C-14)"""
    return df.filter(((F.col(a) == F.lit(one)) & (F.col(b) == F.lit(other))) | ((F.col(a) == F.lit(other)) & (F.col(b) == F.lit(one))))


def due(df: DataFrame, status: str, by: int | None = None, strict: bool = False) -> DataFrame:
    """Rows of a status, due by a chapter (before it if strict); None or 0 leaves the chapter free. (C-15, C-16)"""
    df = df.filter(F.col("status") == status)
    if not by and not strict:
        return df
    return df.filter(F.col("due_chapter") < by) if strict else df.filter(F.col("due_chapter") <= by)


def overdue_debts(df: DataFrame, now: int) -> DataFrame:
    """Marked overdue, or active and past due. (C-18)"""
    return df.filter((F.col("status") == "overdue") | ((F.col("status") == "active") & (F.col("due_chapter") < now)))


def confident(df: DataFrame, least: float, col: str = "confidence") -> DataFrame:
    """Rows at or above a confidence; null passes. (C-23)"""
    return df.filter(F.col(col).isNull() | (F.col(col) >= least))


def containing(df: DataFrame, col: str, needle: str) -> DataFrame:
    """Containment without regard to case. (F-01, Y-01)"""
    from ..functions.scalars import like_ci

    return df.filter(like_ci(F.col(col), needle))


def per_group_top(df: DataFrame, group: str, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows of each group. (T-11, Y-38)

    The n best of each task and group, and then of each salt, are kept before the exact order is taken, so a group with
    most of the rows isn't brought together, also if they tie.
    """
    from pyspark.sql import Window

    by = [order_key(o) for o in order]
    # Of the whole row, so rows that tie in the order are spread; of equal rows, any n will do.
    salt = F.pmod(F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]), F.lit(64))
    small = df.withColumn("__part", salt).withColumn("__r", F.row_number().over(Window.partitionBy(group, "__part").orderBy(*by))).filter(F.col("__r") <= n)
    final = Window.partitionBy(group).orderBy(*by)
    return small.withColumn("__r", F.row_number().over(final)).filter(F.col("__r") <= n).drop("__r", "__part")


def by_ids(df: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """Rows whose id is listed (C-26, R-03, Y-02, Y-03). Spark picks a broadcast by the measured size."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(col)).distinct(), col, "left_semi")
