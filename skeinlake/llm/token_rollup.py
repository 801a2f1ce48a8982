"""Token totals by source, language and tokenizer version, maintained by signed deltas.

A batch of changes (inserts, deletes, revised counts) is compared with the last known state of its documents: what was
counted before is subtracted where it was counted, what holds now is added where it belongs. Only these signed sums are
added to the totals; no earlier document is counted again. A batch is first written to a folder of its own, then committed
by one marker, whose name is the next number: of two writers with the same number one creates it, the other compares its
batch anew with what now holds. Totals read committed batches only, and committing an id again changes nothing, so a
failed batch can be run anew. Every COMPACT batches the state and the totals are written as a whole, so that a commit reads
the last of these and at most COMPACT batches, however long the history is.

The file system must create a file only if it is absent, as HDFS does. A marker that its writer left empty is an error.

Defined edge results: deleting what isn't there has no effect; inserting what is there revises it; revising what isn't
there inserts it; of several rows for one document and version in one batch the one with the greatest (change_no, op,
count) holds, so repeated rows count once; null sources and languages are groups of their own; a null count counts as 0;
rows with a null id or version are ignored; a group whose documents are all gone has no row; an empty batch commits and
changes nothing; texts of any length are counted whole; extra columns of a batch are not read.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, materialize, shared_dir

GROUP = ["source", "lang", "tokenizer"]
KEY = ["doc_id", "tokenizer"]

#: Tokenizer versions that are expressions. "words": runs of other than ASCII white space; "pieces": runs of letters
#: and digits (and everything beyond ASCII), and every ASCII punctuation mark by itself.
WORDS = r"[^ \t-\r]+"
PIECES = r"[A-Za-z0-9\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]"


def pattern_count(pattern: str, text_col: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(pattern)).cast("long")


def bpe_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(id, n_tokens) by a public vocabulary, for versions that no expression can count. Map-only."""

    def make():
        from .packing import encoder

        encode = encoder(vocabulary, folder)
        return lambda texts: {"n_tokens": [len(encode(t)) if t else 0 for t in texts]}

    return map_rows(docs, [id_col], text_col, make, T.StructType([T.StructField("n_tokens", T.LongType())]))


#: Batches between two full writings of the state and the totals.
COMPACT = 16


class Marker(NamedTuple):
    seq: int
    folder: str


class TokenRollup:
    """Totals kept under one folder: ``ledger`` (state changes), ``deltas`` (signed sums), ``commits`` (markers), and
    ``state`` and ``sums`` as of the batches that ``compacted`` marks."""

    LEDGER = "doc_id long, tokenizer string, source string, lang string, n_tokens long, deleted boolean, seq long"
    DELTAS = "source string, lang string, tokenizer string, d_docs long, d_tokens long"

    def __init__(self, spark: SparkSession, path: str, compact: int = COMPACT):
        self.spark, self.path, self.compact = spark, path.rstrip("/"), compact

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _markers(self, kind: str) -> dict[str, Marker]:
        """Markers by batch id. One short line for each batch, not for each document."""
        fs, path = self._file(kind)
        if not fs.exists(path) or not len(fs.listStatus(path)):
            return {}
        rows = self.spark.read.schema("batch_id string, seq long, folder string").json(f"{self.path}/{kind}").collect()
        if len(rows) != len(fs.listStatus(path)):
            raise RuntimeError(f"{self.path}/{kind} holds an empty marker; remove it if its writer is gone")
        return {r.batch_id: Marker(r.seq, r.folder) for r in rows}

    def _mark(self, kind: str, batch_id: str, seq: int, folder: str) -> bool:
        """Create the marker of this number; False if another writer has."""
        fs, path = self._file(f"{kind}/{seq:012d}")
        try:
            out = fs.create(path, False)
        except Py4JJavaError:
            if fs.exists(path):
                return False
            raise
        out.write((json.dumps({"batch_id": batch_id, "seq": seq, "folder": folder}) + "\n").encode())
        out.close()
        return True

    def commits(self) -> dict[str, Marker]:
        """Committed batch ids with their numbers and folders."""
        return self._markers("commits")

    def _since(self, done: dict[str, Marker]) -> tuple[Marker | None, list[Marker]]:
        """The last full writing that these commits include, and the commits after it."""
        known = set(done.values())
        full = [Marker(m.seq, m.folder) for m in self._markers("compacted").values() if Marker(m.seq, m.folder) in known]
        last = max(full, default=None)
        return last, sorted(m for m in known if last is None or m.seq > last.seq)

    def _read(self, full: str, kind: str, schema: str, done: dict[str, Marker]) -> DataFrame:
        last, later = self._since(done)
        paths = [f"{self.path}/{full}/{last.folder}"] if last else []
        paths += [f"{self.path}/{kind}/{m.folder}" for m in later]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _state(self, done: dict[str, Marker]) -> DataFrame:
        rows = self._read("state", "ledger", self.LEDGER, done)
        last = rows.groupBy(*KEY).agg(F.max_by(F.struct("source", "lang", "n_tokens", "deleted", "seq"), "seq").alias("s"))
        return last.filter("not s.deleted").select(*KEY, "s.source", "s.lang", "s.n_tokens", "s.deleted", "s.seq")

    def state(self) -> DataFrame:
        """The last known state of each document and version; deleted ones are left out."""
        return self._state(self.commits()).select(*KEY, "source", "lang", "n_tokens")

    def _sums(self, done: dict[str, Marker]) -> DataFrame:
        sums = self._read("sums", "deltas", self.DELTAS, done).groupBy(*GROUP).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        return sums.filter("d_docs <> 0 or d_tokens <> 0")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch of (op, doc_id, source, lang, tokenizer, n_tokens[, change_no]); False if it was committed
        before. ``op`` is insert, revise or delete."""
        order = F.col("change_no") if "change_no" in changes.columns else F.lit(0)
        last = F.max(F.struct(order.alias("change_no"), F.col("op"), F.coalesce("n_tokens", F.lit(0)).alias("n"), "source", "lang")).alias("c")
        new = changes.filter("doc_id is not null and tokenizer is not null").groupBy(*KEY).agg(last)
        new = new.select(*KEY, F.col("c.source").alias("source"), F.col("c.lang").alias("lang"), F.col("c.n").cast("long").alias("n_tokens"), (F.col("c.op") == "delete").alias("deleted"))
        while True:
            done = self.commits()
            if batch_id in done:
                return False
            seq, folder = max((m.seq for m in done.values()), default=0) + 1, f"{_folder(batch_id)}-{uuid.uuid4().hex}"
            self._write(new, done, seq, folder)
            if self._mark("commits", batch_id, seq, folder):
                break
            for kind in ("ledger", "deltas"):
                fs, path = self._file(f"{kind}/{folder}")
                fs.delete(path, True)
        if seq % self.compact == 0:
            done = {**done, batch_id: Marker(seq, folder)}
            self._state(done).write.parquet(f"{self.path}/state/{folder}")
            self._sums(done).write.parquet(f"{self.path}/sums/{folder}")
            self._mark("compacted", batch_id, seq, folder)
        return True

    def _write(self, new: DataFrame, done: dict[str, Marker], seq: int, folder: str) -> None:
        """The batch's state changes and signed sums against the state after ``done``."""
        old = self._state(done).select(*KEY, F.struct("source", "lang", "n_tokens").alias("old"))
        both = new.join(old, KEY, "left").withColumn("seq", F.lit(seq).cast("long"))
        both.write.parquet(f"{self.path}/ledger/{folder}")
        both = self.spark.read.parquet(f"{self.path}/ledger/{folder}")
        minus = both.filter("old is not null").select("old.source", "old.lang", "tokenizer", F.lit(-1).alias("d"), (-F.col("old.n_tokens")).alias("n"))
        plus = both.filter("not deleted").select("source", "lang", "tokenizer", F.lit(1).alias("d"), F.col("n_tokens").alias("n"))
        deltas = plus.unionByName(minus).groupBy(*GROUP).agg(F.sum("d").cast("long").alias("d_docs"), F.sum("n").cast("long").alias("d_tokens"))
        deltas.write.parquet(f"{self.path}/deltas/{folder}")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over the committed batches."""
        return self._sums(self.commits()).filter("d_docs <> 0").select(*GROUP, F.col("d_docs").alias("n_docs"), F.col("d_tokens").alias("n_tokens"))


def _folder(batch_id: str) -> str:
    """A folder name for any batch id."""
    return "batch-" + batch_id.encode("utf-8").hex()


def op5_query(spark, sf_dir: str) -> DataFrame:
    """Four batches over all documents and one of them repeated: inserts under two versions, low-quality documents
    revised into a source of their own, toxic ones deleted."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    counted = materialize(docs.select("doc_id", "source", "lang", pattern_count(WORDS).alias("words"), pattern_count(PIECES).alias("pieces")))

    def rows(df: DataFrame, op: str, version: str, n: str) -> DataFrame:
        return df.select(F.lit(op).alias("op"), "doc_id", "source", "lang", F.lit(version).alias("tokenizer"), F.col(n).alias("n_tokens"))

    def both(df: DataFrame, op: str) -> DataFrame:
        return rows(df, op, "words-1", "words").unionByName(rows(df, op, "pieces-1", "pieces"))

    low = counted.join(labels.filter("quality = 0").select("doc_id").distinct(), "doc_id", "left_semi").withColumn("source", F.lit("quarantine"))
    toxic = counted.join(labels.filter("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    rollup = TokenRollup(spark, f"{shared_dir(spark)}/rollup")
    rollup.commit("load words", rows(counted, "insert", "words-1", "words"))
    rollup.commit("load pieces", rows(counted, "insert", "pieces-1", "pieces"))
    rollup.commit("move low quality", both(low, "revise"))
    rollup.commit("withdraw toxic", both(toxic, "delete"))
    rollup.commit("withdraw toxic", both(toxic, "delete"))
    return rollup.totals()


OP5_SQL = r"""
with known as (
  select distinct d.doc_id, d.lang,
    case when exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 0) then 'quarantine' else d.source end as source,
    len(regexp_extract_all(coalesce(d.text, ''), '[^ \t\n\x0b\f\r]+')) as words,
    len(regexp_extract_all(coalesce(d.text, ''), '[A-Za-z0-9\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]')) as pieces
  from documents d
  where d.doc_id is not null and not exists (select 1 from labels l where l.doc_id = d.doc_id and l.toxic = 1)
), t as (
  select doc_id, source, lang, 'words-1' as tokenizer, words as n from known
  union all
  select doc_id, source, lang, 'pieces-1' as tokenizer, pieces as n from known
), one as (
  select *, row_number() over (partition by doc_id, tokenizer order by n desc, source desc nulls last, lang desc nulls last) as k from t
)
select source, lang, tokenizer, count(*) as n_docs, cast(sum(n) as bigint) as n_tokens from one where k = 1 group by source, lang, tokenizer
"""
