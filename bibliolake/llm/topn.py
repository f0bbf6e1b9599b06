"""Top N items within every group, by score histograms and exact ranking of the survivors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bibliolake.common import HOT_PARTS, materialize


def _doublings(score: Column) -> Column:
    """Steps that never fall as score grows: its sign with the doublings of its size, in 64ths."""
    size = F.floor(F.log2(F.abs(score.cast("double")) + 1) * 64)
    return F.signum(score.cast("double")) * size


def top_n(
    df: DataFrame,
    group: str,
    score: Column,
    tie_keys: list[str],
    n: int,
    keep: list[str],
    *,
    bucket: Column | None = None,
) -> DataFrame:
    """The n rows of each group with the lowest score, ties by tie_keys ascending, with their rank.

    score is an integer expression, lowest first; bucket coarsens it monotonically into a bounded
    number of steps (by default a sign and 64 steps for each doubling, some 8,000 in all), so that a
    group's histogram is small whatever its size. One pass counts rows per (group, bucket), summed in part before the
    shuffle, so the largest group costs no more there than its buckets. The threshold of a group is
    the first bucket at which at least n rows are reached: no row above it can be among the n.
    Thresholds of hot groups (more than one part in a thousand of all rows, so fewer than a
    thousand groups) are broadcast; the others meet their rows in a shuffle join. What survives is
    ranked exactly; a window's limit is applied before its shuffle too, so that a group whose
    threshold bucket holds millions of ties sends at most n rows a partition.

    A null group is no group. Null scores come last, among them ties decide; null tie keys come
    last too. Groups of fewer than n rows come out whole. Repeated rows count as often as they are
    there. Only group, keep and rank come out, so other columns cannot clash.
    """
    cols = list(dict.fromkeys([group, *tie_keys, *keep]))
    last = F.lit(2**63 - 1).cast("long")
    rows = df.filter(F.col(group).isNotNull()).select(
        *[F.col(c).alias(f"_c_{c}") for c in cols],
        F.coalesce(score.cast("long"), last).alias("_score"),
        F.coalesce((bucket if bucket is not None else _doublings(score)).cast("long"), last).alias("_bucket"),
    )
    g = f"_c_{group}"
    counts = rows.groupBy(g, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    up_to = W.partitionBy(g).orderBy("_bucket")
    whole = W.partitionBy(g)
    limits = materialize(
        counts.withColumn("_before", F.sum("_n").over(up_to) - F.col("_n"))
        .withColumn("_size", F.sum("_n").over(whole))
        .filter(F.col("_before") < n)
        .groupBy(g)
        .agg(F.max("_bucket").alias("_limit"), F.max("_size").alias("_size"))
    )
    total = limits.agg(F.sum("_size")).first()[0] or 0
    hot = F.broadcast(limits.filter(F.col("_size") > max(total // HOT_PARTS, 10_000)).select(g, F.col("_limit").alias("_hot")))
    cold = limits.filter(F.col("_size") <= max(total // HOT_PARTS, 10_000)).select(g, "_limit")
    # hot groups lose their rows above the threshold before any shuffle
    cut = rows.join(hot, g, "left").filter(F.col("_hot").isNull() | (F.col("_bucket") <= F.col("_hot")))
    from_hot = cut.filter(F.col("_hot").isNotNull()).drop("_hot", "_bucket")
    from_cold = cut.filter(F.col("_hot").isNull()).join(cold, g, "inner").filter(F.col("_bucket") <= F.col("_limit"))
    order = [F.col("_score").asc(), *[F.col(f"_c_{c}").asc_nulls_last() for c in tie_keys]]
    ranked = (
        from_hot.unionByName(from_cold.drop("_limit", "_hot", "_bucket"))
        .withColumn("rank", F.row_number().over(W.partitionBy(g).orderBy(*order)))
        .filter(F.col("rank") <= n)
    )
    return ranked.select(F.col(g).alias(group), *[F.col(f"_c_{c}").alias(c) for c in keep if c != group], "rank")
