"""Shared helpers: table access, scratch tables and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than one part in HOT_PARTS of all rows, so there are fewer than
#: HOT_PARTS hot keys whatever the data: that is the size bound of every broadcast of hot keys.
HOT_PARTS = 1000

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it. Only a session whose executors
    are threads of this machine may go without one: it gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.gettempdir()


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def materialize(df: DataFrame) -> DataFrame:
    """Write df once to the shared scratch folder and return a DataFrame that reads it.

    This cuts the lineage: a lost executor costs a re-read of files and no re-computation, and a
    result that is used several times is computed once. The files go when the application ends, or
    earlier by release.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/bibliolake-scratch-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, place = _file_system(spark, path)
    files.deleteOnExit(place.getParent())
    found = spark.read.schema(df.schema).parquet(path)
    found._scratch_path = path
    return found


def release(*written: DataFrame) -> None:
    """Remove the files of materialized tables that nothing reads any more, as rounds of a fixpoint do
    with those of earlier rounds, so that a long session does not fill the disk."""
    for df in written:
        path = getattr(df, "_scratch_path", None)
        if path:
            files, place = _file_system(df.sparkSession, path)
            files.delete(place, True)


def broadcast_if_small(df: DataFrame, rows: int, most: int = 20_000) -> DataFrame:
    """A broadcast hint behind a check: given only if the counted rows are within the bound."""
    return F.broadcast(df) if rows <= most else df


def join_by_counted_key(rows: DataFrame, by_key: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of rows with by_key, which has one row per key and the key's number of rows.

    Rows of hot keys meet a broadcast of the hot entries (fewer than HOT_PARTS by counting) and are
    never shuffled; all other keys hold at most one part in HOT_PARTS and go through a shuffle join.
    Keys must not be null. by_key is read three times, so it should be materialized or cheap.
    """
    total, most = by_key.agg(F.sum(count), F.max(count)).first()
    if not total:
        return rows.join(by_key, keys, "inner")
    limit = max(int(total) // HOT_PARTS, 10_000)
    if most <= limit:
        return rows.join(by_key, keys, "inner")
    hot = F.broadcast(by_key.filter(F.col(count) > limit))
    warm = rows.join(hot, keys, "inner")
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(
        by_key.filter(F.col(count) <= limit), keys, "inner"
    )
    return warm.unionByName(cold)
