"""Which names of a table occur in which texts, by an automaton over the names. (A-04, D-11, D-12)

A text is walked once whatever the number of names: the automaton is in the state of the longest name that may end here
and reports every name that does, nested and overlapping ones included. Names are taken in blocks of bounded size; each
is broadcast, and all texts are read once a block. A match is plain containment, as a search for each name would find.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..shipping import ship_code
from .storage import materialize, new_folder

#: Characters of names in a block; its automaton takes some hundred bytes a character.
BLOCK_CHARS = 1_000_000
#: Texts whose names a task holds at once.
BATCH_TEXTS = 256


def name_blocks(names: DataFrame, name: str, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[list[str], bool]]:
    """(distinct names, whether it is the last block): blocks of about ``block_chars`` characters by the names' hash."""
    distinct = names.select(F.col(name).alias("name")).filter("name <> ''").distinct()
    chars = distinct.agg(F.coalesce(F.sum(F.char_length("name")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    path = new_folder(names.sparkSession)
    part = F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int").alias("block")
    # Stored by block once: what a block reads and sends doesn't grow with the number of blocks.
    distinct.select("name", part).repartition("block").write.partitionBy("block").parquet(path)
    stored = names.sparkSession.read.schema("name string, block int").parquet(path)
    for k in range(blocks):
        yield sorted(r.name for r in stored.filter(F.col("block") == k).select("name").collect()), k + 1 == blocks


def automaton(names: list[str]):
    import ahocorasick

    built = ahocorasick.Automaton()
    for n in names:
        built.add_word(n, n)
    built.make_automaton()
    return built


def found_in(built, text: str) -> dict[str, list[int]]:
    """Name -> [how often it occurs, where first], in the order of the text."""
    out: dict[str, list[int]] = {}
    for end, n in built.iter(text):
        if n in out:
            out[n][0] += 1
        else:
            out[n] = [1, end - len(n) + 1]
    return out


#: The automaton of the block at hand, one in a worker.
_built: dict[str, object] = {}


def names_in_texts(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, name: str = "name", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, name, times, first): every name that a text contains, how often, and the place of the first (from 0).

    Null texts hold none; empty and null names occur nowhere; repeated names are one; rows of ``texts`` are looked at
    each. Of several blocks each but the last is worked off and its broadcast released before the next.
    """
    spark = texts.sparkSession
    ship_code(spark)
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    schema = StructType([StructField("id", rows.schema["id"].dataType), StructField("name", StringType()), StructField("times", LongType()), StructField("first", LongType())])
    arrow, out = to_arrow_schema(schema), None
    for block, last in name_blocks(names, name, block_chars):
        if not last and out is None:
            rows = materialize(rows)  # read once a block
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, token=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            if token not in _built:
                _built.clear()
                _built[token] = automaton(shared.value) if shared.value else None
            built = _built[token]
            if built is None:
                return
            for part in (batch.slice(at, BATCH_TEXTS) for batch in batches for at in range(0, batch.num_rows, BATCH_TEXTS)):
                columns: list[list] = [[], [], [], []]
                for row, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    for n, (times, first) in found_in(built, text.as_py()).items():
                        for column, value in zip(columns, (row, n, times, first), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        got = rows.mapInArrow(run, schema)
        if not last:
            got = materialize(got)
            shared.destroy()
        out = got if out is None else out.unionByName(got)
    return out.withColumnRenamed("id", id_col)


def name_lists(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, name: str = "name") -> DataFrame:
    """(id, names): the sorted names of each text that has any; ``id`` must tell texts apart."""
    return names_in_texts(texts, names, id_col, text_col, name).groupBy(id_col).agg(F.sort_array(F.collect_list("name")).alias("names"))


def term_counts(texts: DataFrame, terms: dict, id_col: str, text_col: str) -> DataFrame:
    """(id, hits): for each text with any, the distinct terms it holds, counted for each owner of the term. (D-11)"""
    pairs = sorted({(str(owner), t) for owner, ts in terms.items() for t in ts if t})
    owned = texts.sparkSession.createDataFrame(pairs, "owner string, name string")
    per = F.broadcast(owned.groupBy("name").agg(F.count("*").alias("owners")))
    return names_in_texts(texts, owned, id_col, text_col).join(per, "name").groupBy(id_col).agg(F.sum("owners").alias("hits"))
