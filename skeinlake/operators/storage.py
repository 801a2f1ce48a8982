"""Cutting lineage in the folder that driver and executors share; small files that only one writer can create."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset, a folder of this machine's temporary directory does if all executors run on this machine;
    otherwise rows written there would be lost with an executor, so it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.gettempdir()}/skeinlake-checkpoints"
    return path.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """The rows as a reliable checkpoint in the shared folder; never a local checkpoint.

    For narrow tables that several jobs read: what is costly to compute is computed once, and a lost executor loses
    nothing.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession) -> str:
    """A name in the shared folder that nothing else has."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


#: Ends a whole small file; one without it was cut off, or is being written.
WHOLE = "\n."


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file; False if there is one already, whoever made it. Of several writers one succeeds, on file
    systems that create a file only if it is absent."""
    where, fs = _at(spark, path)
    fs.mkdirs(where.getParent())
    local = fs.getUri().getScheme() == "file"
    if local and not spark._jvm.java.io.File(where.toUri().getPath()).createNewFile():
        return False
    try:
        out = fs.create(where, local)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    out.write((text + WHOLE).encode())
    out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None if there is none or it isn't whole."""
    where, fs = _at(spark, path)
    if not fs.exists(where):
        return None
    source = fs.open(where)
    try:
        text = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()
    return text.removesuffix(WHOLE) if text.endswith(WHOLE) else None


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Sorted names in a folder, none if there is no such folder."""
    where, fs = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.delete(where, True)


class Versions:
    """A series of small files, each made once: the last whole one is what holds now. Readers see a version or the next
    one, never a part of either; of two writers that start from one version, one finds its place taken."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def numbers(self) -> list[int]:
        return [int(n) for n in names_in(self.spark, self.path) if n.isdigit()]

    def last(self) -> tuple[int, str | None]:
        """(greatest number that is taken, text of the greatest whole version)."""
        taken = self.numbers()
        for n in reversed(taken):
            if (text := read_text(self.spark, f"{self.path}/{n:012d}")) is not None:
                return taken[-1], text
        return (taken[-1] if taken else 0), None

    def add(self, after: int, text: str) -> bool:
        """Publish the version that follows number ``after``; False if another writer has."""
        return put_if_absent(self.spark, f"{self.path}/{after + 1:012d}", text)
