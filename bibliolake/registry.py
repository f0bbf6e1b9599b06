"""All queries of the core and their SQL twins."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

from bibliolake.operators import packed_queries, queries

QUERIES = {**queries.QUERIES, **packed_queries.QUERIES}
ORACLE = {**queries.ORACLE, **packed_queries.ORACLE}

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to executors that may not have it on their path (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="bibliolake-zip-"), "bibliolake_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
