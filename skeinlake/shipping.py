"""Bringing this package's code to executors that can't import it."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .operators.storage import shared_root

_done: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give executors this package, once per application: a small archive in the shared folder, added as a Python file.

    Functions that run in Python workers refer to modules of the package by name; workers get it this way wherever
    they run, also if the driver found it on a path of its own.
    """
    sc = spark.sparkContext
    if sc.applicationId in _done:
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    target = f"{shared_root(spark)}/{root.name}-{uuid.uuid4().hex}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(held.getvalue())
    out.close()
    sc.addPyFile(target)
    _done.add(sc.applicationId)
