"""Range sharding by sampled splitters, on DataFrame functions only.

Records are ordered by (group key, row key), where the group key is the hash of the text and the row key that of the
id, so equal texts are neighbours. A size-weighted sample of keys gives quantile boundaries of many small ranges; a
boundary always stands at the start of a group, and a group that holds several is a range of its own. Ranges that turn
out overfull by rows are subdivided into cells: by the hash of the group, and a group that alone overfills a cell by the
hash of its rows. Exact running sizes within cells plus the sizes of the cells before give each record's place in the
global order, and shards are equal parts of the total size.

Equal texts share a shard unless their group is hot (more than ``HOT_SHARE`` of a shard), where staying together would
break the balance. Sizes of shards differ by at most one undivided group.

The driver and broadcasts hold at most ``MOST_RANGES`` boundaries and ``PER_RANGE`` times as many sampled keys; beyond
that many ranges, ranges grow and are subdivided, and the cells stay where they are.

Defined edge results: null and empty texts have size 1 and belong to one group; a null id sorts first within its group;
repeated rows, also those with no id at all, take separate slots and spread over cells; a text of any length is one
record; extra columns are not read, whatever their names; an empty table gives no rows; fewer rows than shards leave
shards empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, if_small, materialize

#: Rows aimed at per range, keys sampled per range, and the least and greatest number of ranges.
ROWS_PER_RANGE = 50_000
PER_RANGE = 12
LEAST_RANGES = 1024
MOST_RANGES = 1 << 14
#: A group heavier than this part of a shard may be divided.
HOT_SHARE = 1 / 32
#: A range with more than this many times the rows aimed at is subdivided.
OVERFULL = 4


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", number: str | None = None) -> DataFrame:
    """(id, size, crc, g, r, u): bytes plus 1, unsigned crc32, group key, row key, and a number of the row (the column
    ``number``, or one of its own), which tells rows equal in text and id apart. Reads each text once."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("string")
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text, F.lit("group")).alias("g"),
        F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.lit("row")).alias("r"),
        (F.monotonically_increasing_id() if number is None else F.col(f"`{number}`")).alias("u"),
    )


def splitters(rows: DataFrame, ranges: int, total: int) -> list[int]:
    """Boundaries: group keys at which a range starts, from a size-weighted sample of about ``ranges * PER_RANGE`` keys.

    A row is drawn with probability min(1, size * wanted / total), by the hash of its key and number. Rows heavier than
    the sampling step are drawn once per step by repeating them, so quantiles keep their weight. A group that holds
    several quantiles gets a boundary before and behind it.
    """
    step = max(1.0, total / (ranges * PER_RANGE))
    u = F.pmod(F.xxhash64("r", "g", "u", F.lit("draw")), F.lit(1_000_000)) / F.lit(1_000_000.0)
    times = F.floor(F.col("size") / F.lit(step) + u)
    drawn = rows.filter(times > 0).select("g", times.cast("long").alias("n")).groupBy("g").agg(F.sum("n").alias("n")).collect()
    weight, cuts, seen = sum(x.n for x in drawn), set(), 0
    for x in sorted(drawn, key=lambda x: x.g):
        held = (seen + x.n) * ranges // weight - seen * ranges // weight
        seen += x.n
        if held:
            cuts.add(x.g)
        if held > 1 and x.g < (1 << 63) - 1:
            cuts.add(x.g + 1)
    return sorted(cuts)


def with_range(rows: DataFrame, bounds: list[int]) -> DataFrame:
    """Add ``range``: the number of boundaries at or below the row's group key.

    Boundaries are bucketed by the high bits of the key, so a row compares with the few of its bucket. The lookup has
    fewer rows than four times the boundaries, which are at most twice ``MOST_RANGES``.
    """
    spark = rows.sparkSession
    bits = max(1, (max(len(bounds), 1) - 1).bit_length())
    buckets: dict[int, list] = {b: [] for b in range(-(1 << (bits - 1)), 1 << (bits - 1))}
    for g in bounds:
        buckets[g >> (64 - bits)].append(g)
    table, base = [], 0
    for b in sorted(buckets):
        table.append((b, base, buckets[b]))
        base += len(buckets[b])
    lookup = F.broadcast(spark.createDataFrame(table, "bucket long, base long, bounds array<long>"))
    below = F.size(F.filter("bounds", lambda b: b <= F.col("g")))
    return (
        rows.withColumn("bucket", F.shiftright("g", 64 - bits).cast("long"))
        .join(lookup, "bucket")
        .withColumn("range", (F.col("base") + below).cast("long"))
        .drop("bucket", "base", "bounds")
    )


def with_cell(ranged: DataFrame, limit: int) -> DataFrame:
    """Add ``part``, the cell within the range, and ``hot``: the size of a group that has cells of its own, else null.

    A range of more than ``limit`` rows has cells by the hash of the group. Behind them follow, in the order of their
    keys, the cells of each group that has more than ``limit`` rows itself, by the hash of the row.
    """
    full = ranged.groupBy("range").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    full = full.select("range", F.ceil(F.col("n") / limit).cast("int").alias("parts"))
    # Fewer overfull ranges than ranges, so this table has a bound of its own.
    ranged = ranged.join(F.broadcast(full), "range", "left")
    inside = ranged.filter("parts is not null")
    groups = inside.groupBy("range", "g").agg(F.count("*").alias("gn"), F.sum("size").alias("hot"), F.max("parts").alias("parts")).filter(F.col("gn") > limit)
    groups = groups.withColumn("own", F.ceil(F.col("gn") / limit).cast("int"))
    before = Window.partitionBy("range").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("range", "g", "hot", "own", (F.col("parts") + F.coalesce(F.sum("own").over(before), F.lit(0))).cast("int").alias("first"))
    placed = ranged.join(groups, ["range", "g"], "left")
    mixed = F.pmod(F.xxhash64("g", F.lit("part")), F.col("parts"))
    lone = F.col("first") + F.pmod(F.xxhash64("r", "u", F.lit("part")), F.col("own"))
    return placed.withColumn("part", F.coalesce(lone, mixed, F.lit(0)).cast("int")).drop("parts", "own")


def places(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` (of ``keyed``, materialized) with shard and slot."""
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = min(MOST_RANGES, max(LEAST_RANGES, n // ROWS_PER_RANGE))
    limit = max(1, OVERFULL * min(n // ranges, ROWS_PER_RANGE))
    placed = materialize(with_cell(with_range(rows, splitters(rows, ranges, total)), limit))

    cell = ["range", "part"]
    sums = placed.groupBy(*cell).agg(F.count("*").alias("cn"), F.sum("size").alias("cs"))
    within = Window.partitionBy("range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inner = [F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"{c}_before") for c in ("cn", "cs")]
    # One row per range: the running totals go over the ranges, whose number is bounded.
    over = _running(sums.groupBy("range").agg(F.sum("cn").alias("rn"), F.sum("cs").alias("rs")), ["rn", "rs"])
    cells = sums.select(*cell, *inner).join(over, "range").select(*cell, (F.col("rn_before") + F.col("cn_before")).alias("n_before"), (F.col("rs_before") + F.col("cs_before")).alias("s_before"))
    # Cells are few: a range has one, or as many as its rows need.
    cells = if_small(materialize(cells))
    order = Window.partitionBy(*cell).orderBy("g", "r", "u")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = placed.join(cells, cell).select(
        "*",
        (F.col("n_before") + F.row_number().over(order) - 1).alias("place"),
        (F.col("s_before") + F.sum("size").over(upto) - F.col("size")).alias("s_own"),
    )
    # A group lies in one cell, or has cells of its own: then its size is known and it starts with the first of them.
    group = Window.partitionBy(*cell, "g")
    inner = inner.withColumn("s_group", F.min("s_own").over(group)).withColumn("weight", F.coalesce("hot", F.sum("size").over(group)))
    starts = cells.select("range", F.col("part").alias("first"), F.col("s_before").alias("s_first"))
    inner = inner.join(starts, ["range", "first"], "left")
    aim = max(1.0, total / shards)
    start = F.when(F.col("weight") > F.lit(aim * HOT_SHARE), F.col("s_own")).otherwise(F.coalesce("s_first", "s_group"))
    held = materialize(
        inner.select("id", "size", "crc", "g", "u", "place", F.least(F.floor(start / F.lit(aim)), F.lit(shards - 1)).cast("int").alias("shard"))
    )
    first = held.groupBy("shard").agg(F.min("place").alias("lowest"))  # at most ``shards`` rows
    return held.join(F.broadcast(first), "shard").select("id", "size", "crc", "g", "u", "shard", (F.col("place") - F.col("lowest")).alias("slot"))


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per record: id, size, crc, g, shard, slot; shards get equal parts of the total size."""
    return places(materialize(keyed(docs, id_col, text_col)), shards).drop("u")


def _running(df: DataFrame, cols: list[str], block: int = 512) -> DataFrame:
    """Exclusive running sums over ``range``, in two levels: within blocks of ranges, then over the blocks."""
    df = df.withColumn("__b", F.floor(F.col("range") / block))
    heads = df.groupBy("__b").agg(*[F.sum(c).alias(f"__{c}") for c in cols])
    over = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("__b", *[F.coalesce(F.sum(f"__{c}").over(over), F.lit(0)).alias(f"__{c}") for c in cols])
    own = Window.partitionBy("__b").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(F.broadcast(heads), "__b")
    return out.select(*[c for c in df.columns if c != "__b"], *[(F.col(f"__{c}") + F.coalesce(F.sum(c).over(own), F.lit(0))).alias(f"{c}_before") for c in cols])


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents, all columns, with ``shard`` and ``slot``, to one folder per shard.

    The documents are written once with a number for each row, and places are joined back by that number, so null and
    repeated ids keep all their rows.
    """
    row = free_name([*docs.columns, "shard", "slot"], "row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    keys = materialize(keyed(numbered, id_col, text_col, row))
    placed = places(keys, shards).select(F.col("u").alias(row), "shard", "slot")
    out = numbered.join(placed, row).drop(row)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8_query(spark, sf_dir: str) -> DataFrame:
    got = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
