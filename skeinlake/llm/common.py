"""Shared plumbing of the corpus operators: Arrow row maps, shared storage, bounded samples."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.storage import materialize, shared_root  # noqa: F401
from ..shipping import ship_code

#: Characters of text handed to one call of a row function; a single longer text is passed alone.
CHUNK_CHARS = 2_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the one all executors share."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def free_name(taken: list[str], name: str) -> str:
    """``name`` with underscores in front until no column has it, in whatever case."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def map_rows(
    df: DataFrame,
    key_cols: list[str],
    text_col: str,
    make: Callable[[], Callable[[list], dict]],
    out: T.StructType,
) -> DataFrame:
    """Apply a row-wise text function over Arrow batches; no shuffle, one task-local state.

    Columns may have any names; those of ``out`` must not be among ``key_cols`` in any case (see ``free_name``).

    ``make()`` runs once per task and returns ``fn(texts) -> {column: list or array}`` with one value per text.
    ``key_cols`` are carried through unchanged (also when null).
    """
    ship_code(df.sparkSession)
    names = [f.name for f in out.fields]
    src = df.select(*[F.col(f"`{c}`") for c in key_cols])
    # A text that is carried through anyway isn't sent twice.
    at = key_cols.index(text_col) if text_col in key_cols else len(key_cols)
    if at == len(key_cols):
        src = df.select(*[F.col(f"`{c}`") for c in key_cols], F.col(f"`{text_col}`").cast("string").alias(free_name(key_cols, "text")))
    schema = T.StructType([src.schema[c] for c in key_cols] + list(out.fields))
    arrow_out = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in split_batch(batch, at):
                got = fn(part.column(at).to_pylist())
                cols = [part.column(i) for i in range(len(key_cols))]
                cols += [pa.array(got[n], type=arrow_out.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays(cols, names=[*key_cols, *names])

    return src.mapInArrow(run, schema)


def split_batch(batch: pa.RecordBatch, text_index: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of about CHUNK_CHARS bytes of text, so memory follows the slice, not the batch."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text_index)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > CHUNK_CHARS:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


#: A key with more rows than this is joined by broadcast.
HOT_ROWS = 1_000_000


def join_named(rows: DataFrame, named: DataFrame, key: str | list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` with the other columns of ``named``, which has one row for each ``key`` and counts them in ``rows``.

    Keys with more than ``hot_rows`` rows, of which there are fewer than rows / ``hot_rows``, are broadcast, so no task
    gets them as a whole; the others are shuffled.
    """
    hot = named.filter(F.col("rows") > hot_rows)
    cold = rows.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(named.filter(F.col("rows") <= hot_rows), key)
    return cold.unionByName(rows.join(F.broadcast(hot), key)).drop("rows")


def join_counted(rows: DataFrame, named: DataFrame, key: str | list[str], most: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``join_named`` if a key is hot, else a plain join. Of at most ``hot_rows`` rows in all (``most``) none is; beyond that
    ``named`` is worked out first, which tells."""
    if most > hot_rows:
        named = materialize(named)
        if not named.filter(F.col("rows") > hot_rows).isEmpty():
            return join_named(rows, named, key, hot_rows)
    return rows.join(named.drop("rows"), key)


#: Rows of a narrow table, of a few numbers each, that may be broadcast.
BROADCAST_ROWS = 2_000_000


def if_small(narrow: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A materialized narrow table, to be broadcast if it has at most ``rows`` rows; beyond that a join shuffles."""
    return F.broadcast(narrow) if narrow.count() <= rows else narrow


def crc_bucket(col: F.Column, mod: int) -> F.Column:
    """crc32 of the id written as text, modulo ``mod`` (null id: remainder of the empty string, 0)."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def bounded_sample(df: DataFrame, by: list[str], id_col: str, per_group: int, groups: int | None = None) -> DataFrame:
    """Rows kept for fitting: about ``per_group`` per distinct value of ``by``, chosen by the hash of the id.

    Two passes: counts per group over narrow columns, then a hash threshold per group. Groups at or below the
    bound are kept whole; with ``groups`` only that many of the largest are drawn from. Used for fitting models only.
    """
    counts = df.groupBy(*by).count()
    counts = (counts.orderBy(F.desc("count"), *by).limit(groups) if groups else counts).collect()
    keep = F.lit(False)
    u = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("fit")), F.lit(1_000_000)) / F.lit(1_000_000.0)
    for r in counts:
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.lit(r[c]))
        keep = keep | (same & (u < F.lit(min(1.0, per_group / max(r["count"], 1)))))
    return df.filter(keep)


#: Different texts of one id, and characters for each group, that a fitting sample takes at most: what reaches the
#: driver is bounded by these, whatever the tables hold.
TEXTS_PER_ID = 4
FIT_CHARS = 64_000_000


def bounded_texts(rows: DataFrame, by: str, id_col: str, text_col: str, per_id: int = TEXTS_PER_ID, chars: int = FIT_CHARS) -> DataFrame:
    """Distinct (id, ``by``, text) of a sample, at most ``per_id`` texts of an id and ``chars`` characters of a group.

    Whole texts are taken, in the order of the ids' hashes, until the group's characters are used up. The choice is made
    on narrow rows, so the texts themselves are never shuffled.
    """
    rows = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{by}`").alias("by"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("n", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))
    first = F.row_number().over(Window.partitionBy("id", "by").orderBy("h"))
    narrow = rows.select("id", "by", "h", "n").distinct().withColumn("k", first).filter(F.col("k") <= per_id)
    upto = Window.partitionBy("by").orderBy(F.xxhash64("id"), "id", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    picked = narrow.withColumn("total", F.sum("n").over(upto)).filter(F.col("total") <= chars).select("id", "by", "h")
    got = rows.join(F.broadcast(picked), on=[rows[c].eqNullSafe(picked[c]) for c in ("id", "by", "h")], how="left_semi")
    # Equal rows meet again: one text for each (id, by, h).
    got = got.groupBy("id", "by", "h").agg(F.any_value("text").alias("text"))
    return got.select(F.col("id").alias(id_col), F.col("by").alias(by), F.col("text").alias(text_col))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, id_col: str, text_col: str):
    """(labels that aren't null, pandas rows of about ``per_class`` labelled documents of each label, by id).

    The sample is drawn from the narrow, distinct labels first, so what is broadcast has that bound; ``bounded_texts``
    bounds what is brought in. An id with both labels counts once for each.
    """
    known = labels.select(F.col(f"`{id_col}`"), F.col(f"`{label_col}`")).filter(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
    chosen = F.broadcast(bounded_sample(known.distinct(), [label_col], id_col, per_class))
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).join(chosen, id_col)
    got = bounded_texts(rows, label_col, id_col, text_col).toPandas()
    return known, got.sort_values([id_col, label_col, text_col], kind="stable").reset_index(drop=True)
