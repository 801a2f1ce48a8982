"""Tables that are replaced as a whole and can go back: schema migrations with a backup. (B-28, Y-06)

A migration writes a new copy beside the old one and then publishes it; until then readers have the old copy, and if the
migration fails nothing has happened. The copy before stays as the backup that ``restore_table`` publishes again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import Versions


class Overtaken(RuntimeError):
    """Another writer published a copy in the meantime."""


def _versions(spark: SparkSession, path: str) -> Versions:
    return Versions(spark, f"{path}/versions")


def _state(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    number, text = _versions(spark, path).last()
    return number, json.loads(text)["copies"] if text else []


def _publish(spark: SparkSession, path: str, number: int, copies: list[str]) -> None:
    if not _versions(spark, path).add(number, json.dumps({"copies": copies})):
        raise Overtaken(path)


def save_table(df: DataFrame, path: str) -> None:
    """Publish a copy of ``df`` as the table; the one before is kept as its backup."""
    number, copies = _state(df.sparkSession, path)
    name = uuid.uuid4().hex
    df.write.parquet(f"{path}/copies/{name}")
    _publish(df.sparkSession, path, number, [name, *copies[:1]])


def load_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The published copy, None if there is none."""
    _, copies = _state(spark, path)
    return spark.read.parquet(f"{path}/copies/{copies[0]}") if copies else None


def migrate_table(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """Publish what ``change`` makes of the table. (B-28)"""
    number, copies = _state(spark, path)
    if not copies:
        raise LookupError(f"no table in {path}")
    name = uuid.uuid4().hex
    change(spark.read.parquet(f"{path}/copies/{copies[0]}")).write.parquet(f"{path}/copies/{name}")
    _publish(spark, path, number, [name, copies[0]])


def restore_table(spark: SparkSession, path: str) -> bool:
    """Publish the backup again; False if there is none. (Y-06)"""
    number, copies = _state(spark, path)
    if len(copies) < 2:
        return False
    _publish(spark, path, number, [copies[1], copies[0]])
    return True


def conform(df: DataFrame, want: T.StructType | str) -> DataFrame:
    """Rows under a record type: its columns in its order, cast to its types, null where the table lacks them; further
    columns are left out. (A-12, Y-06)"""
    want = T.StructType.fromDDL(want) if isinstance(want, str) else want
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields])
