"""Readers: tables, databases, Markdown corpora, JSON documents, logs; and the pluggable scoring services."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import chapter_of_path, section, stats_field
from ..schemas import PAYLOAD, SCHEMAS
from ..shipping import ship_code


def table(spark: SparkSession, path: str, name: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A Parquet table; a missing one is empty if its record type is known. (A-01..A-03, A-12, C-27)"""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.parquet")
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.read.parquet(f"{path}/{name}.parquet")
    return spark.createDataFrame([], schema or SCHEMAS[name])


def jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int = 16, **options: str) -> DataFrame:
    """A database table read in ranges of a numeric key. (A-01..A-03)"""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options)
    return reader.load()


def columns_missing(df: DataFrame, want: T.StructType | str) -> list[str]:
    """Columns of a record type that a table lacks. (A-12, Y-06)"""
    want = T.StructType.fromDDL(want) if isinstance(want, str) else want
    return [f.name for f in want.fields if f.name not in df.columns]


def markdown(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """One row per file: path, file name, whole text. (A-04, A-07, Y-35)"""
    got = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return got.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.col("value").alias("text"))


def clean_markdown(col: Column) -> Column:
    """Text without code fences, headings and rules."""
    out = F.regexp_replace(col, r"(?s)```.*?```", "")
    out = F.regexp_replace(out, r"(?m)^#+ .*$", "")
    return F.trim(F.regexp_replace(out, r"(?m)^\s*---+\s*$", ""))


def chapters(files: DataFrame, stats_name: str, names: DataFrame | None = None) -> DataFrame:
    """Chapters of a Markdown corpus by path: number, title, length of the cleaned text, a value of the statistics list,
    and the sorted names of a table that occur in the text. (A-04, D-12, F-26)

    ``names`` (column name) may have any number of rows; see ``names_in_texts``. Paths tell files apart.
    """
    from ..operators.names import name_lists

    got = files.withColumn("chapter", chapter_of_path(F.col("path"))).filter("chapter is not null")
    clean = clean_markdown(F.col("text"))
    title = F.trim(F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1))
    none = F.array().cast("array<string>")
    if names is None:
        got = got.withColumn("__names", none)
    else:
        got = got.join(name_lists(got, names, "path", "text").select("path", F.col("names").alias("__names")), "path", "left")
    return got.select("path", "chapter", F.when(title != "", title).alias("title"), F.char_length(clean).alias("word_count"), stats_field(F.col("text"), stats_name).alias("stat"), F.coalesce("__names", none).alias("characters"), "text")


def chapter_summary(text: Column, own: Column | None, title: str, stats_name: str, first: int = 500) -> Column:
    """The summary file, else the section, else the statistics entry, else the beginning. (Y-28, A-07)"""
    part = section(text, title)
    return F.coalesce(own if own is not None else F.lit(None).cast("string"), F.when(part != "", part), stats_field(text, stats_name), F.left(text, F.lit(first)))


def outlines(single: DataFrame, volumes: DataFrame, most: int = 1500, marker: str = "...") -> DataFrame:
    """Outline per chapter: its own file wins (whole), else its section of the volume file, cut to ``most``. (A-06)

    ``single`` has chapter, text; ``volumes`` has text with a heading per chapter number.
    """
    parts = volumes.select(F.explode(F.split("text", r"(?m)^(?=#+\s)")).alias("part"))
    cut = parts.withColumn("chapter", F.regexp_extract("part", r"^#+\D*(\d+)", 1).try_cast("long")).filter("chapter is not null")
    short = F.when(F.char_length("part") > most, F.concat(F.left("part", F.lit(most)), F.lit(marker))).otherwise(F.col("part"))
    cut = cut.groupBy("chapter").agg(F.min(short).alias("from_volume"))
    both = single.select("chapter", F.col("text").alias("own")).join(cut, "chapter", "full_outer")
    return both.select("chapter", F.coalesce("own", "from_volume").alias("outline"))


def json_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON document under a declared schema; malformed ones give null fields. (A-05, A-08, A-13, Y-16)"""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An append-only log. (B-35)"""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def payloads(raw: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) ingest records: parsed under the declared type, missing lists empty; a record without a
    chapter above 0, or that doesn't parse, is rejected with its reason. (A-14)"""
    kind = T.StructType.fromDDL(PAYLOAD)
    got = raw.select(F.col(col).alias("raw"), F.from_json(col, kind).alias("p"))
    lists = {f.name: F.coalesce(F.col(f"p.{f.name}"), F.array().cast(f.dataType)).alias(f.name) for f in kind.fields if isinstance(f.dataType, T.ArrayType)}
    why = F.when(F.try_parse_json("raw").isNull(), "malformed").when(F.coalesce(F.col("p.chapter"), F.lit(0)) <= 0, "no chapter")
    got = got.withColumn("reason", why)
    fine = got.filter("reason is null").select(*[lists.get(f.name, F.col(f"p.{f.name}")) for f in kind.fields])
    return fine, got.filter("reason is not null").select("raw", "reason")


Embedder = Callable[[list[str]], list[list[float] | None]]


def embed(docs: DataFrame, make: Callable[[], Embedder], keys: list[str], text: str = "content", batch: int = 64, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """Keys and ``embedding`` by an outside service, in batches; a batch that fails after all tries, or that comes back
    short, gives nulls at its places. (A-09, A-10, B-21)"""
    ship_code(docs.sparkSession)
    src = docs.select(*keys, F.col(text).alias("__text"))
    schema = T.StructType([src.schema[k] for k in keys] + [T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(frames: Iterator) -> Iterator:
        service = make()
        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                out = with_retries(lambda part=part: service(part["__text"].tolist()), tries, wait) or []
                part = part.drop(columns="__text")
                part["embedding"] = out if len(out) == len(part) else [None] * len(part)
                yield part

    return src.mapInPandas(run, schema)


def with_retries(call: Callable, tries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """The call's result, or None after ``tries`` failures; the wait doubles. (A-09, A-11)"""
    for n in range(tries):
        try:
            return call()
        except Exception:  # a remote service may fail in any way; what fails for good is null in the result
            if n + 1 < tries:
                sleep(wait * 2**n)
    return None


def lexical_reranker(query: str, docs: DataFrame, doc_id: str = "chunk_id", text: str = "content") -> Callable[[DataFrame], DataFrame]:
    """A scorer for ``hybrid``: share of the query's terms in the text. A stand-in for a model service. (A-11)"""
    from ..functions.scalars import tokenize
    from ..operators.retrieval import query_terms

    terms = query_terms(query)

    def score(hits: DataFrame) -> DataFrame:
        got = hits.select(doc_id).join(docs.select(doc_id, tokenize(F.col(text)).alias("t")), doc_id)
        share = F.size(F.array_intersect("t", F.array(*[F.lit(t) for t in terms]))) / max(1, len(terms))
        return got.select(doc_id, share.alias("score"))

    return score


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "append") -> None:
    """Parquet through the commit protocol; with partitions and ``overwrite``, only those in the data are replaced.
    (B-02, B-20, B-34, B-35)"""
    out = df.write.mode(mode)
    if partition_by:
        out = out.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    out.parquet(path)
