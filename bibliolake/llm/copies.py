"""Duplicates hidden by formatting differences: radix partitioning on canonical bytes, then tries.

Every record becomes a canonical byte string. Buckets of common leading bytes are split by further
bytes, where the bucket first differs, until each fits into one task; a bucket that cannot be split
holds one key only (a hot key) and is counted in part before anything moves. The other rows are
shuffled once, by bucket, and counted in one trie a task with counters at its terminals.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bibliolake.common import materialize
from bibliolake.llm.unify import unified
from bibliolake.operators.catalog import small

#: Bytes by which a bucket is split at a time, from where its keys first differ.
STRIDE = 2
#: A bucket fits if it has at most this share of all rows, within these bounds in rows.
SHARE, LEAST_ROWS, MOST_ROWS = 4096, 20_000, 250_000


def text_key(column: str) -> Column:
    """A text without letter case, white space, punctuation and look-alike characters; null is empty."""
    folded = F.replace(F.lower(unified(column)), F.lit("ß"), F.lit("ss"))
    return F.coalesce(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", ""), F.lit(""))


def names_key(column: str) -> Column:
    """A list of names without the order of names, and in each name without the order of its parts.

    Parts are words; in names written in Han characters, where no space divides, they are characters.
    """
    joined = F.array_join(F.transform(F.col(column), lambda x: F.translate(x, "\n", " ")), "\n")
    folded = F.replace(F.lower(unified(joined)), F.lit("ß"), F.lit("ss"))

    def name(x: Column) -> Column:
        parts = F.when(x.rlike(r"\p{IsHan}"), F.split(F.regexp_replace(x, r"[^\p{L}\p{N}]+", ""), "")).otherwise(F.split(x, r"[^\p{L}\p{N}]+"))
        return F.array_join(F.sort_array(parts), "")

    names = F.filter(F.transform(F.split(folded, "\n"), name), lambda x: x != "")
    return F.coalesce(F.array_join(F.sort_array(names), " "), F.lit(""))


def canonical_bytes(texts: list[str], names: list[str]) -> Column:
    """The canonical byte string of a record: its text fields, then its lists of names."""
    return F.concat_ws("\x1f", *[text_key(c) for c in texts], *[names_key(c) for c in names]).cast("binary")


def _agreeing(low: str, high: str) -> Column:
    """How many leading bytes two binary columns have in common."""
    shorter = F.least(F.length(low), F.length(high))
    differs = F.transform(F.sequence(F.lit(1), shorter), lambda i: F.substring(F.col(low), i, F.lit(1)) != F.substring(F.col(high), i, F.lit(1)))
    return F.when(shorter == 0, F.lit(0)).otherwise(F.coalesce(F.nullif(F.array_position(differs, True), F.lit(0)) - 1, shorter)).cast("int")


def _by_prefix(rows: DataFrame, table: DataFrame, lengths: list[int], how: str) -> DataFrame:
    """rows with the columns of a table of buckets (_prefix, ...) for each length of a bucket's prefix."""
    each = rows.withColumn("_at", F.explode(F.array(*[F.lit(n) for n in lengths]))).filter(F.length("_key") >= F.col("_at"))
    return each.withColumn("_prefix", F.expr("substring(_key, 1, _at)")).join(small(table), "_prefix", how)


def _lengths(table: DataFrame) -> list[int]:
    """The lengths of the prefixes of buckets: as many as there are levels at most, whatever the data."""
    return sorted(r[0] for r in table.select(F.length("_prefix")).distinct().collect())


def radix_plan(keyed: DataFrame, limit: int) -> tuple[DataFrame | None, DataFrame | None]:
    """The buckets that are split further (_prefix, _to: the length to which), and the hot keys (_key),
    both as tables, or None: buckets whose rows exceed limit, and keys that alone do. There are fewer
    of each than rows / limit at any depth, by counting; no bucket comes to the driver."""
    splits: DataFrame | None = None
    hot: DataFrame | None = None
    child = keyed.select(F.substring("_key", 1, STRIDE).alias("_child"), "_key")
    while True:
        found = child.groupBy("_child").agg(F.count(F.lit(1)).alias("n"), F.min("_key").alias("low"), F.max("_key").alias("high")).filter(F.col("n") > limit)
        found = found.withColumn("_alone", F.col("low") == F.col("high"))
        longer = F.greatest(_agreeing("low", "high"), F.length("_child")) + STRIDE
        level = materialize(found.select("_alone", F.when(F.col("_alone"), F.col("low")).alias("_key"), F.col("_child").alias("_prefix"), F.when(~F.col("_alone"), longer).alias("_to")))
        alone = level.filter("_alone").select("_key")
        if not alone.isEmpty():
            hot = alone if hot is None else hot.unionByName(alone)
        further = level.filter("not _alone").select("_prefix", "_to")
        if further.isEmpty():
            return splits, hot
        splits = further if splits is None else splits.unionByName(further)
        child = _by_prefix(keyed.select("_key"), further, _lengths(further), "inner").select(F.expr("substring(_key, 1, _to)").alias("_child"), "_key")


class Trie:
    """A burst trie over byte strings, 8 bytes a step: a key stays a leaf until another shares its path.

    Terminals hold the ids that arrived with their key, so its counter is their number.
    """

    STEP = 8

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: bytes, ident: object) -> None:
        node, at, step = self.root, 0, self.STEP
        while True:
            part = key[at : at + step]
            entry = node.get(part)
            if entry is None:
                node[part] = [key, ident, None]
                return
            if type(entry) is list:
                if entry[0] == key:
                    if entry[2] is None:
                        entry[2] = [entry[1]]
                    entry[2].append(ident)
                    return
                child = {entry[0][at + step : at + 2 * step]: entry}
                node[part] = child
                entry = child
            node, at = entry, at + step

    def terminals(self) -> Iterator[list]:
        stack = [self.root]
        while stack:
            for entry in stack.pop().values():
                if type(entry) is list:
                    yield entry
                else:
                    stack.append(entry)


def _count_in_tries(batches: Iterator[pa.RecordBatch], schema: pa.Schema, singles: bool) -> Iterator[pa.RecordBatch]:
    trie = Trie()
    for batch in batches:
        for key, ident in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            trie.add(key, ident)
    first: list = []
    member: list = []
    for key, ident, idents in trie.terminals():
        if idents is None:
            if singles:
                first.append(ident)
                member.append(ident)
            continue
        own = sorted(set(idents))
        start = 0 if singles else 1
        first += [own[0]] * (len(own) - start)
        member += own[start:]
        if len(first) >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(first, schema.field(0).type), pa.array(member, schema.field(1).type)], schema=schema)
            first, member = [], []
    yield pa.RecordBatch.from_arrays([pa.array(first, schema.field(0).type), pa.array(member, schema.field(1).type)], schema=schema)


def group_copies(df: DataFrame, key: str, texts: list[str], names: list[str], *, singles: bool = False) -> DataFrame:
    """Rows (first, copy): each record that is a copy, with the smallest key of its group.

    With singles, every record comes out, the first of a group as its own copy, so that counting
    rows by first gives the number of copies. Records are the same if their canonical bytes agree:
    letter case, white space, punctuation, look-alike characters, the order of names and of their
    parts are left aside; null, empty and blank fields agree. Rows without a key are ignored, rows
    that repeat a key within a group count once, other columns are ignored, and an empty table
    gives an empty result.
    """
    spark = df.sparkSession
    keyed = materialize(df.filter(F.col(key).isNotNull()).select(canonical_bytes(texts, names).alias("_key"), F.col(key).alias("_id")))
    id_type = keyed.schema["_id"].dataType
    rows = keyed.count()
    limit = min(max(rows // SHARE, LEAST_ROWS), MOST_ROWS)
    splits, hot = radix_plan(keyed.select("_key"), limit)
    out = T.StructType([T.StructField("first", id_type), T.StructField("copy", id_type)])

    cold = keyed
    if hot is not None:
        # each of more rows than a bucket may have, so they are few; a list beyond a broadcast's bound is shuffled
        firsts = materialize(keyed.join(small(hot), "_key").groupBy("_key").agg(F.min("_id").alias("first")))
        of_hot = keyed.join(small(firsts), "_key").select("first", F.col("_id").alias("copy")).distinct()
        if not singles:
            of_hot = of_hot.filter(F.col("first") != F.col("copy"))
        cold = keyed.join(small(hot), "_key", "left_anti")

    # a row's bucket is its prefix to the length that its deepest split ancestor names
    bucket = F.substring("_key", 1, STRIDE)
    if splits is not None:
        lengths = _lengths(splits)
        for n in lengths:
            level = splits.filter(F.length("_prefix") == n).select(F.col("_prefix").alias("_p"), F.col("_to").alias(f"_to{n}"))
            cold = cold.join(small(level), F.substring("_key", 1, n) == F.col("_p"), "left").drop("_p")
        bucket = F.expr("substring(_key, 1, _to)")
        cold = cold.withColumn("_to", F.coalesce(*[F.col(f"_to{n}") for n in reversed(lengths)], F.lit(STRIDE)))
    tasks = max(-(-rows // limit), min(spark.sparkContext.defaultParallelism, -(-rows // 1000)), 1)
    arrow = pa.schema([pa.field("first", _arrow_type(id_type)), pa.field("copy", _arrow_type(id_type))])
    placed = cold.select("_key", "_id", bucket.alias("_bucket")).repartition(tasks, "_bucket").select("_key", "_id")
    found = placed.mapInArrow(lambda batches: _count_in_tries(batches, arrow, singles), out)
    return found.unionByName(of_hot) if hot is not None else found


def _arrow_type(kind: T.DataType) -> pa.DataType:
    return {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.ShortType: pa.int16()}.get(type(kind), pa.string())


def count_copies(df: DataFrame, key: str, texts: list[str], names: list[str]) -> DataFrame:
    """One row (first, copies) for each group of copies, groups of one too."""
    return group_copies(df, key, texts, names, singles=True).groupBy("first").agg(F.countDistinct("copy").alias("copies"))
