"""The corpus pipeline: five operators in a row, each stage written and read again before the next one.

Toxic documents go, one document of each near-duplicate group stays, documents that hold benchmark passages go, secrets
are taken out of the texts, and what is left is packed into training sequences.

All stages but the last return the columns they got, whatever their names, and read texts of any length whole. Null ids,
texts and other columns keep their rows unless a stage below says otherwise; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlake.llm import decontaminate, packing, secrets, simhash, toxicity
from skeinlake.llm.common import crc_bucket, if_small, materialize, read_table, shared_dir


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; labels of the documents held out for testing aren't learned from. Null and empty
    texts score as an empty sentence; without labels of both kinds every document has the smoothed share of label 1."""
    labels = read_table(spark, sf_dir, "labels").filter(crc_bucket(F.col("doc_id"), 3) != 1)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels), 0.7)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of texts whose five-word shingles have a similarity of 0.8
    or more. Documents with a null id stay, and repeated rows of one id are one document, which stays or goes as a whole.
    Null, empty and word-less texts are copies of each other."""
    found = simhash.near_duplicates(docs, shingle=5, bound=24, similarity=0.8)
    gone = if_small(materialize(found.filter("doc_id <> component_id").select("doc_id").distinct()))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is covered. Null and empty texts hold none; an empty benchmark drops nothing."""
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each reported span but public keys replaced by a marker; ``n_chars`` follows the new text."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in its sequence. Null and empty texts are one piece with the end id; repeated rows are
    packed each."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: Trained models, tokenization and reachability aren't expressible in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again."""
    folder = shared_dir(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
