"""Queries on packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bibliolake.common import table
from bibliolake.operators.packed import explode_packed


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each author of each raw row with its place."""
    return explode_packed(table(spark, sf_dir, "raw_rows"), "raw_id", "authors", value_name="author")


QUERIES = {"p3_found": p3_found}
ORACLE: dict[str, str] = {}
