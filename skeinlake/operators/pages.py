"""Pages of a stored order: any page, or the rows behind a key, from the ranges that hold it. (T-13)

The rows are written once in range partitions of the order, and the driver keeps one line a range: its number of rows
and its last key. Page 100,000 is rows of one range by their number; nothing before it is sorted.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lookup import order_key
from .storage import new_folder

#: Rows of a range. Ranges come from sampled boundaries, so they differ somewhat; equal keys are never parted.
RANGE_ROWS = 1_000_000
#: Ranges at most: each is a line in the driver, a task and a file. Of more rows the ranges are longer.
MOST_RANGES = 512


def _behind(order: tuple[str, ...], key: tuple) -> Column:
    """Whether a row follows ``key`` in the order (nulls first ascending, last descending)."""
    found = []
    for k, spec in enumerate(order):
        name, _, way = spec.partition(" ")
        same = reduce(lambda a, b: a & b, [F.col(o.partition(" ")[0]).eqNullSafe(F.lit(v)) for o, v in zip(order[:k], key, strict=False)], F.lit(True))
        if way.strip() == "desc":
            later = F.lit(False) if key[k] is None else F.col(name).isNull() | (F.col(name) < F.lit(key[k]))
        else:
            later = F.col(name).isNotNull() if key[k] is None else F.col(name) > F.lit(key[k])
        found.append(same & F.coalesce(later, F.lit(False)))
    return reduce(or_, found)


@dataclass
class Pages:
    """``parts`` are the ranges that have rows, in order, ``starts`` the numbers of their first rows, ``ends`` the running
    totals, ``last`` each range's last key."""

    rows: DataFrame
    order: tuple[str, ...]
    parts: list[int]
    starts: list[int]
    ends: list[int]
    last: DataFrame

    @property
    def total(self) -> int:
        return self.ends[-1] if self.ends else 0

    def count(self, size: int) -> int:
        """Number of pages of ``size`` rows."""
        return -(-self.total // size)

    def _some(self, low: int, high: int) -> DataFrame:
        return self.rows.filter(F.col("__part").isin(self.parts[low:high])).drop("__part", "__row")

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 1, clamped to 1) of ``size`` rows; none behind the last."""
        start = (max(1, number) - 1) * size
        low, high = bisect_right(self.ends, start), bisect_right(self.ends, start + size - 1) + 1
        # Rows of a range are numbered in their order: of it only those of the page are sorted.
        mine = F.lit(False)
        for k in range(low, min(high, len(self.parts))):
            skip = start - (self.ends[k - 1] if k else 0)
            mine |= (F.col("__part") == self.parts[k]) & F.col("__row").between(self.starts[k] + max(0, skip), self.starts[k] + skip + size - 1)
        some = self.rows.filter(F.col("__part").isin(self.parts[low:high]) & mine).drop("__part", "__row")
        return some.orderBy(*[order_key(o) for o in self.order]).limit(size)

    def after(self, key: tuple, size: int) -> DataFrame:
        """The ``size`` rows that follow ``key``, which need not be there."""
        later = self.last.filter(_behind(self.order, key)).agg(F.min("__part")).first()[0]
        low = self.parts.index(later) if later is not None else len(self.parts)
        # The rest of its range, and as many further ranges as hold the page.
        high = bisect_right(self.ends, (self.ends[low] if low < len(self.ends) else 0) + size - 1) + 1
        return self._some(low, high).filter(_behind(self.order, key)).orderBy(*[order_key(o) for o in self.order]).limit(size)


def pages(df: DataFrame, *order: str, range_rows: int = RANGE_ROWS) -> Pages:
    """Store ``df`` by ranges of a total order; rows that are equal in it have no order among themselves."""
    spark, keys = df.sparkSession, [order_key(o) for o in order]
    names = [o.partition(" ")[0] for o in order]
    path = new_folder(spark)
    ranges = min(MOST_RANGES, max(1, -(-df.count() // range_rows)))
    cut = df.repartitionByRange(ranges, *keys).withColumn("__part", F.spark_partition_id()).sortWithinPartitions("__part", *keys)
    cut.withColumn("__row", F.monotonically_increasing_id()).write.partitionBy("__part").parquet(path)
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("__row", T.LongType()), T.StructField("__part", T.IntegerType())])).parquet(path)
    stats = rows.groupBy("__part").agg(F.count("*").alias("n"), F.min("__row").alias("first"), F.max_by(F.struct(*names), "__row").alias("k")).orderBy("__part").collect()
    kinds = T.StructType([T.StructField("__part", T.IntegerType()), *[T.StructField(n, df.schema[n].dataType) for n in names]])
    last = spark.createDataFrame([(r["__part"], *r.k) for r in stats], kinds)
    return Pages(rows, order, [r["__part"] for r in stats], [r["first"] for r in stats], list(accumulate(r.n for r in stats)), last)
