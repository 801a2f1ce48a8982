"""A stored word index that follows its texts: segments, tombstones, merges, and top-k that skips blocks. (B-22, R-01)

A batch of changed texts becomes one *segment*: postings of its words, the lengths and word counts of its documents, the
change of every word's document frequency, and the ids that are dead in older segments. What holds is the list of
segments in the last published version, with the number of documents and their total length kept up to date; a batch
reads its own texts and, for replaced documents, their stored word counts, never another text. ``merge`` rewrites segments
of similar size into one from these stored counts. Texts are counted where they are read and stored as counts; these are
shuffled once, to the bands of similar length in which blocks are made.

Postings are kept in *blocks*: the documents of a segment are ordered by length in bands and cut into cells, and a block holds
a word's postings in a cell, with its greatest frequency and its smallest length. These bound the score of every document
of the cell, for any corpus statistics; the bounds of a query's words add up. A search scores the most promising cells
first, and then only those whose bound reaches the k-th score found: what it leaves out can't be among the best, so
the result is that of scoring everything, ties included.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.scalars import tokenize
from .retrieval import _idf, query_terms
from .storage import Versions, materialize, remove

#: Documents of a cell. Cells scored before the bounds are used, for a query.
CELL_DOCS, FIRST_CELLS = 128, 16
#: Documents of a band, which a task orders and cuts into cells. Lengths of a band differ by a factor of at most 2 ** 0.5.
DOCS_PER_TASK = 1 << 12
#: So many ids are broadcast to texts or word counts; for more these are shuffled.
BROADCAST_IDS = 1 << 20
#: Segments of one size class that are merged into one.
FANOUT = 4


class Overtaken(RuntimeError):
    """Another writer published a version first; the batch has to be applied again."""


@dataclass
class Found:
    """``hits`` (id, score); of ``blocks`` blocks of the query's words ``read`` were scored."""

    hits: DataFrame
    blocks: int
    read: int


class WordIndex:
    """An index in a folder. Writers that start from the same version can't both publish."""

    def __init__(self, spark: SparkSession, path: str, cell_docs: int = CELL_DOCS):
        self.spark, self.path, self.cell_docs = spark, path, cell_docs
        self.versions = Versions(spark, f"{path}/versions")

    def state(self) -> tuple[int, list[dict], int, int]:
        """(version, segments by age, documents, total length)."""
        number, text = self.versions.last()
        found = json.loads(text) if text else {"segments": [], "docs": 0, "length": 0}
        return number, found["segments"], found["docs"], found["length"]

    def _publish(self, number: int, segments: list[dict], docs: int, length: int) -> None:
        if not self.versions.add(number, json.dumps({"segments": segments, "docs": docs, "length": length})):
            raise Overtaken(self.path)

    def _read(self, segments: list[dict], table: str) -> DataFrame | None:
        """A table of the segments with the segment's age (``seg``)."""
        frames = [self.spark.read.parquet(f"{self.path}/{s['name']}/{table}").withColumn("seg", F.lit(s["age"])) for s in segments]
        return reduce(DataFrame.unionByName, frames) if frames else None

    def _living(self, segments: list[dict], ids: DataFrame | None = None) -> DataFrame | None:
        """Stored documents (id, len, words, seg) that no later segment has replaced or deleted."""
        docs = self._read(segments, "docs")
        if docs is None:
            return None
        docs = docs.filter("len is not null")
        if ids is not None:
            docs = docs.join(ids, "id", "left_semi")
        dead = self._read(segments[1:], "dead")
        if dead is None:
            return docs
        # A segment's own documents outlive its tombstones, which are for older segments.
        last = dead.groupBy("id").agg(F.max("seg").alias("last"))
        gone = materialize(docs.select("id", "seg").join(last, "id").filter("last > seg").select("id", "seg"))
        return docs.join(_sent(gone, gone.count()), ["id", "seg"], "left_anti")

    def apply(self, changes: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> None:
        """One batch: texts that are new or changed, null texts for documents that go. Of several rows of an id the
        greatest text holds; null ids are left out. An empty batch changes nothing."""
        number, segments, docs, length = self.state()
        rows = _one_text(changes.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null"))
        toks, known = tokenize(F.col("text")), F.col("text").isNotNull()
        rows = rows.withColumn("toks", toks).select("id", F.when(known, F.size("toks").cast("long")).alias("len"), F.when(known, word_counts(F.col("toks"))).alias("words"))
        name = uuid.uuid4().hex
        rows = self._stored(rows, name)
        total = rows.agg(F.count("*"), F.count("len"), F.coalesce(F.sum("len"), F.lit(0))).first()
        if not total[0]:
            remove(self.spark, f"{self.path}/{name}")
            return
        ids = rows.select("id")
        old = self._living(segments, _sent(ids, total[0]))
        gone = old.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first() if old is not None else (0, 0)
        age = 1 + max((s["age"] for s in segments), default=-1)
        new = rows.filter("len is not null")
        self._write(name, new, ids, _frequencies(new, 1) if old is None else _frequencies(new, 1).unionByName(_frequencies(old, -1)))
        self._publish(number, [*segments, {"name": name, "age": age, "docs": total[1]}], docs + total[1] - gone[0], length + total[2] - gone[1])

    def _stored(self, docs: DataFrame, name: str) -> DataFrame:
        """Documents (id, len, words) as a segment keeps them; length and words are null of those that go."""
        docs.write.parquet(f"{self.path}/{name}/docs")
        return self.spark.read.schema(docs.schema).parquet(f"{self.path}/{name}/docs")

    def _write(self, name: str, docs: DataFrame, dead: DataFrame, frequencies: DataFrame) -> None:
        """The other tables of a segment, of its stored documents."""
        # Long documents are few, so there are a few dozen lengths; documents of one are dealt to bands by their ids.
        size = F.floor(2 * F.log2(F.col("len") + 1)).cast("int")
        parts = {r.size: -(-r.n // DOCS_PER_TASK) for r in docs.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()}
        known = F.create_map(*[F.lit(x) for k, n in parts.items() for x in (k, n)]) if parts else F.create_map(F.lit(0), F.lit(1))
        band = F.pmod(F.xxhash64("id"), F.coalesce(F.try_element_at(known, size), F.lit(1)).cast("long")) * 128 + size
        # Words and counts as a string: as rows of an array they take several times as much to shuffle.
        flat = F.array_join(F.transform("words", lambda w: F.concat(w["term"], F.lit(" "), w["n"])), "\n")
        cut = docs.select("id", "len", flat.alias("words"), band.alias("band")).repartition(max(1, 2 * sum(parts.values())), "band")
        cut = cut.sortWithinPartitions("band", "len", "id")
        place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        cell = F.col("band") * (1 << 33) + F.floor(place / self.cell_docs)
        cut = cut.select("band", "id", "len", "words", cell.alias("cell")).filter("words <> ''")
        word = cut.select("band", "cell", "id", "len", F.explode(F.split("words", "\n")).alias("w"))
        post = word.select(F.substring_index("w", " ", 1).alias("term"), "band", "cell", F.struct("id", "len", (F.substring_index("w", " ", -1).cast("int") / F.col("len")).alias("tf")).alias("p"))
        # A band is in one task, and with it each of its cells: blocks are made without another shuffle.
        blocks = post.groupBy("band", "term", "cell").agg(F.count("*").alias("n"), F.max("p.tf").alias("max_tf"), F.min("p.len").alias("min_len"), F.collect_list("p").alias("postings"))
        # Each file is sorted by word, so a search reads the pages of its words.
        blocks.drop("band").sortWithinPartitions("term", "cell").write.parquet(f"{self.path}/{name}/blocks")
        frequencies.groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0").sortWithinPartitions("term").write.parquet(f"{self.path}/{name}/terms")
        dead.write.parquet(f"{self.path}/{name}/dead")

    def merge(self, fanout: int = FANOUT) -> bool:
        """Merge neighbouring segments where ``fanout`` of one size class (a power of ``fanout``) stand together, the
        youngest first; whether there was anything to merge. Texts aren't read."""
        number, segments, docs, length = self.state()
        size = lambda s: _class(s["docs"], fanout)
        for end in range(len(segments), fanout - 1, -1):
            run = segments[end - fanout : end]
            if max(map(size, run)) == min(map(size, run)):
                break
        else:
            return False
        name = uuid.uuid4().hex
        living = self._stored(self._living(run).select("id", "len", "words"), name)
        dead = self._read(run, "dead").select("id").distinct()
        if run[0] is segments[0]:
            dead = dead.limit(0)  # nothing is older
        self._write(name, living, dead, self._read(run, "terms").select("term", "df"))
        merged = {"name": name, "age": run[-1]["age"], "docs": living.count()}
        self._publish(number, [*segments[: end - fanout], merged, *segments[end:]], docs, length)
        return True

    def statistics(self, terms: list[str]) -> tuple[int, float, dict[str, int]]:
        """(documents, mean length, word -> document frequency), as the batches have kept them."""
        _, segments, docs, length = self.state()
        found = self._read(segments, "terms")
        rows = found.filter(F.col("term").isin(terms)).groupBy("term").agg(F.sum("df").alias("df")).collect() if found is not None and terms else []
        return max(docs, 1), (length / docs if docs and length else 1.0), {r.term: r.df for r in rows}

    def search(self, query: str, k: int, cfg: Config = DEFAULT, first_cells: int = FIRST_CELLS) -> Found:
        """The k best documents by BM25, ties by id: those of ``bm25`` over the living texts. (R-01)"""
        terms, (_, segments, _, _) = query_terms(query), self.state()
        blocks = self._read(segments, "blocks")
        if blocks is None or not terms:
            none = self.spark.createDataFrame([], "id long, score double") if blocks is None else blocks.select(F.col("postings")[0]["id"].alias("id"), F.lit(0.0).alias("score")).limit(0)
            return Found(none, 0, 0)
        n, avg, df = self.statistics(terms)
        idf = F.create_map(*[F.lit(x) for t in terms for x in (t, _idf(n, df.get(t, 0)))])

        def part(tf: Column, length: Column) -> Column:
            return F.try_element_at(idf, F.col("term")) * tf * (cfg.k1 + 1) / (tf + cfg.k1 * (1 - cfg.b + cfg.b * length / F.lit(avg)))

        mine = blocks.filter(F.col("term").isin(terms))
        # More frequent and shorter is better: no document of the block scores above this. Rounding is given some room.
        cells = mine.select("seg", "cell", (part(F.col("max_tf"), F.col("min_len")) * (1 + 1e-9) + 1e-12).alias("bound"))
        cells = materialize(cells.groupBy("seg", "cell").agg(F.sum("bound").alias("bound"), F.count("*").alias("blocks")))
        dead = self._read(segments[1:], "dead")
        last = None if dead is None else dead.groupBy("id").agg(F.max("seg").alias("gone"))

        def scored(some: DataFrame) -> DataFrame:
            rows = mine.join(some.select("seg", "cell"), ["seg", "cell"], "left_semi").select("seg", "term", F.explode("postings").alias("p")).select("seg", "term", "p.*")
            if last is not None:
                rows = rows.join(last, "id", "left").filter(F.coalesce(F.col("gone") <= F.col("seg"), F.lit(True)))
            # Summed in the order of the query's words, so equal documents get equal doubles.
            own = [F.coalesce(F.max(F.when(F.col("term") == t, part(F.col("tf"), F.col("len")))), F.lit(0.0)) for t in terms]
            return rows.groupBy("id").agg(reduce(lambda a, b: a + b, own).alias("score")).orderBy(F.desc("score"), "id").limit(k)

        promising = cells.orderBy(F.desc("bound"), "seg", "cell").limit(first_cells)
        seen = scored(F.broadcast(promising)).collect()
        least = seen[-1].score if len(seen) == k else None
        rest = cells if least is None else cells.filter(F.col("bound") >= least)
        counted = cells.agg(F.sum("blocks"), F.sum(F.when(F.lit(True) if least is None else F.col("bound") >= least, F.col("blocks")))).first()
        return Found(scored(rest), counted[0] or 0, counted[1] or 0)


def word_counts(toks: Column) -> Column:
    """array<(term, n)> of a text's words, by the runs of the sorted words: n log n in the length of the text."""

    def runs(words: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
        ends = lambda at: F.transform(at, lambda p, j: F.struct(F.get(words, p).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(words)) - p).alias("n")))
        return F.when(F.size(words) > 0, _let(starts, ends)).otherwise(F.array().cast("array<struct<term:string,n:int>>"))

    return _let(F.sort_array(toks), runs)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _frequencies(docs: DataFrame, sign: int) -> DataFrame:
    """(term, df) of each word of each document, still to be added up."""
    return docs.select(F.explode("words.term").alias("term"), F.lit(sign).cast("long").alias("df"))


def _sent(ids: DataFrame, many: int) -> DataFrame:
    return F.broadcast(ids) if many <= BROADCAST_IDS else ids


def _one_text(rows: DataFrame) -> DataFrame:
    """(id, text): the greatest text of each id. Texts of ids that come once stay where they are."""
    twice = materialize(rows.groupBy("id").count().filter("count > 1").select("id"))
    many = twice.count()
    if not many:
        return rows
    greatest = lambda some: some.groupBy("id").agg(F.max("text").alias("text"))
    if many > BROADCAST_IDS:
        return greatest(rows)
    twice = F.broadcast(twice)
    return rows.join(twice, "id", "left_anti").unionByName(greatest(rows.join(twice, "id", "left_semi")))


def _class(docs: int, fanout: int) -> int:
    k = 0
    while docs >= fanout:
        docs, k = docs // fanout, k + 1
    return k
