"""Versioned copies of assembled tables, published by a pointer that only one writer can make. (B-33, Y-25)

A copy is written whole under a name of its own, then a pointer to it is added to the series of its chapter. Readers
follow the last pointer, so they never see half a copy; a writer that is overtaken publishes after the other. Deleting
adds a pointer to nothing; ``vacuum`` removes copies that no last pointer leads to.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from .storage import Versions, names_in, remove


class VersionMismatch(ValueError):
    """The last copy was made under another version than is asked for."""


def _series(spark: SparkSession, path: str, chapter: int) -> Versions:
    return Versions(spark, f"{path}/pointers/{chapter}")


def _publish(spark: SparkSession, path: str, chapter: int, content: dict) -> int:
    series = _series(spark, path, chapter)
    while True:
        number, _ = series.last()
        if series.add(number, json.dumps(content)):
            return number + 1


def save_snapshot(pack: DataFrame, path: str, version: str, chapter: int) -> int:
    """Write a copy and publish it; the number of its pointer. (B-33)"""
    data = uuid.uuid4().hex
    pack.write.parquet(f"{path}/data/{data}")
    return _publish(pack.sparkSession, path, chapter, {"data": data, "version": version})


def load_snapshot(spark: SparkSession, path: str, version: str, chapter: int) -> DataFrame | None:
    """The last copy of a chapter, None if there is none or it was deleted; an error if it is of another version. (B-33,
    Y-25)"""
    _, text = _series(spark, path, chapter).last()
    found = json.loads(text) if text else {"data": None}
    if found["data"] is None:
        return None
    if not compatible(found, version):
        raise VersionMismatch(f"chapter {chapter} has a copy of version {found['version']}, not {version}")
    return spark.read.parquet(f"{path}/data/{found['data']}")


def compatible(found: dict, version: str) -> bool:
    """Whether a copy can be used under a version. (Y-25)"""
    return found.get("version") == version


def delete_snapshot(spark: SparkSession, path: str, chapter: int) -> bool:
    """Publish that a chapter has no copy any more; False if it had none. (B-33)"""
    _, text = _series(spark, path, chapter).last()
    if text is None or json.loads(text)["data"] is None:
        return False
    _publish(spark, path, chapter, {"data": None, "version": None})
    return True


def list_snapshots(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(chapter, version) of every chapter that has a copy, by chapter. (B-33)"""
    out = []
    for chapter in sorted(int(n) for n in names_in(spark, f"{path}/pointers")):
        _, text = _series(spark, path, chapter).last()
        found = json.loads(text) if text else {"data": None}
        if found["data"] is not None:
            out.append((chapter, found["version"]))
    return out


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove copies that aren't the last of their chapter; how many. For times without readers or writers."""
    used = set()
    for chapter in names_in(spark, f"{path}/pointers"):
        _, text = _series(spark, path, int(chapter)).last()
        used.add(json.loads(text)["data"] if text else None)
    old = [name for name in names_in(spark, f"{path}/data") if name not in used]
    return sum(remove(spark, f"{path}/data/{name}") for name in old)
