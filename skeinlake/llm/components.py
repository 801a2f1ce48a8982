"""Connected components of an edge table by alternating large-star and small-star steps, with reliable checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, join_counted, materialize


def _directed(edges: DataFrame) -> DataFrame:
    """Both directions of each edge."""
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")


def _star(pairs: DataFrame, large: bool, most: int, hot_rows: int) -> DataFrame:
    """Link each node's neighbours to the smallest of them and itself.

    Large-star links the strictly larger neighbours; small-star the node and its smaller neighbours. The minimum of a node
    is partially aggregated; it goes back to the node's pairs by an equi-join, which Spark doesn't split by itself for a
    node with many pairs, as one side is an aggregate. Where a node may have more than ``hot_rows`` of the ``most`` pairs,
    such nodes' minima are broadcast instead, so their pairs stay where they are.
    """
    if not large:
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("rows"))
    joined = join_counted(pairs.filter("b > a") if large else pairs, low, "a", most, hot_rows)
    got = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        got = got.union(low.select("a", F.col("m").alias("b")))
    return got.filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 50, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    ``edges`` has columns a, b; loops and repeats are ignored. Runs until a fixed point, which is reached in a number
    of rounds logarithmic in practice; ``rounds`` only guards against a defect and raises if it is used up.
    """
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last or state[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        last = state
        # Neither star has more pairs than both directions of the edges, and one for each node.
        big = _star(_directed(edges), True, 2 * state[0], hot_rows)
        edges = materialize(_star(big, False, 4 * state[0], hot_rows))
    raise RuntimeError("components did not settle")
