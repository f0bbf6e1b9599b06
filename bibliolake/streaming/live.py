"""Searches that arrive as a stream: looked up against the catalog, or run batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from bibliolake.operators.catalog import lookup_general


def run_batches(stream: DataFrame, run: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Runs a batch plan over what a stream has and appends its rows; a batch that failed is run again
    and a finished one is not, as the checkpoint says. Each batch writes to a folder of its own,
    so that running one again replaces its rows."""

    def write(batch: DataFrame, number: int) -> None:
        run(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lookups(stream: DataFrame, key: str, journal: str, index: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Catalog lookups of a stream of (key, journal)."""
    return run_batches(stream, lambda batch: lookup_general(batch, key, journal, index), path, checkpoint)
