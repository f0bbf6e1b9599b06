"""Mixing sources to target weights by Poisson replication.

Each document gets a uniform number from all bits of a hash of its key; the inverse of a Poisson
distribution turns it into a number of copies, never above the source's cap. The mean of each
source's distribution is found from the sizes that these very numbers give: a histogram brackets the
mean, and further histograms of the few documents whose number of copies the bracket leaves open
refine it, until what is open is a thousandth of the target or the numbers end. Copies depend on key
and source alone, so only keys and sizes are written in between; texts go from their scan into the
final shuffle.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibliolake.common import materialize

#: Steps of a histogram. It has at most this many rows for each source and number of copies.
STEPS = 4096
#: A list of sources may have at most so many entries: the driver holds STEPS sums for each.
MOST_SOURCES = 1000
#: Refinement ends when what is open is at most this share of the target, or after so many rounds: the
#: numbers have 53 bits, of which each round decides 12.
TOLERANCE, MOST_ROUNDS = 1e-3, 5


def tails(mean: float, cap: int) -> list[float]:
    """The probabilities of more than 0 .. cap - 1 copies: a number below as many of them gets as many
    copies. Each is exact to its own size, however small."""
    out: list[float] = []
    for k in range(cap):
        if mean <= 0:
            out.append(0.0)
        elif k + 1 > mean:
            # beyond the mean the terms fall fast: the tail itself is summed
            term = total = math.exp((k + 1) * math.log(mean) - mean - math.lgamma(k + 2))
            j = k + 1
            while term > total * 1e-17 and j < k + 1000:
                j += 1
                term *= mean / j
                total += term
            out.append(min(total, 1.0))
        else:
            out.append(1.0)
    # up to the mean: one less what comes before
    before = 0.0
    for k in range(min(cap, int(mean) if mean > 0 else 0)):
        before += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        out[k] = max(1.0 - before, 0.0)
    return out


class Sizes:
    """What is known of the sizes of one source's documents by their numbers: the size of all whose
    number is below some points, and histograms between some of them."""

    def __init__(self, supply: int) -> None:
        self.points = np.array([0.0, 1.0])
        self.below = np.array([0.0, float(supply)])

    def refine(self, low: float, high: float, steps: dict[int, int]) -> None:
        """Adds the sums of STEPS equal parts of [low, high), of whose ends the sizes below are known."""
        sums = np.zeros(STEPS)
        for step, size in steps.items():
            sums[step] = size
        start = self.below[np.searchsorted(self.points, low)]
        inner = low + (high - low) * np.arange(1, STEPS) / STEPS
        own = start + np.cumsum(sums)[:-1]
        keep = (inner > low) & (inner < high)
        at = np.searchsorted(self.points, low) + 1
        self.points, self.below = np.insert(self.points, at, inner[keep]), np.insert(self.below, at, own[keep])

    def bounds(self, mean: float, cap: int) -> tuple[float, float, list[tuple[float, float]]]:
        """The least and the greatest size of the copies at this mean, and the parts that leave it open."""
        low = high = 0.0
        open_parts = []
        for t in tails(mean, cap):
            i = int(np.searchsorted(self.points, t, side="right")) - 1
            low += self.below[i]
            if self.points[i] == t or i + 1 == len(self.points):
                high += self.below[i]
            else:
                high += self.below[i + 1]
                if self.below[i + 1] > self.below[i]:
                    open_parts.append((float(self.points[i]), float(self.points[i + 1])))
        return low, high, open_parts

    def guess(self, mean: float, cap: int) -> float:
        """The size at this mean if sizes are spread evenly within a part."""
        return float(np.interp(tails(mean, cap), self.points, self.below).sum())


def calibrated_mean(sizes: Sizes, cap: int, target: float) -> float:
    """The mean at which the copies' total size is nearest to target; sizes do not fall as it grows."""
    # at this mean fewer than one in a million documents would stay below the cap: all numbers reach it
    most = max(256.0, 2.0 * cap + 40)
    if sizes.guess(most, cap) <= target:
        return most
    low, high = 0.0, most
    for _ in range(200):
        # means of rare copies are small: steps of size, not of distance
        middle = math.sqrt(low * high) if low > 0 else high / 1024 if high > 1e-18 else 0.0
        if not low < middle < high:
            break
        if sizes.guess(middle, cap) < target:
            low = middle
        else:
            high = middle
    return min((low, high), key=lambda m: abs(sizes.guess(m, cap) - target))


def _number(key: str, seed: int) -> Column:
    """A uniform number in [0, 1) with 53 bits from a hash of the key."""
    return F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 11).cast("double") * F.lit(2.0**-53)


class Plan:
    """What a mixture does with each source: rows (source, weight, cap, supply, mean, limits)."""

    def __init__(self, rows: list[tuple[str, float, int, int, float, list[float]]], total: float) -> None:
        self.rows, self.total = rows, total


def _histogram(sized: DataFrame, parts: list[tuple[str, float, float]]) -> dict[tuple[str, float], dict[int, int]]:
    """Sizes in STEPS equal steps of each part (source, low, high) of numbers."""
    spark = sized.sparkSession
    # at most MOST_SOURCES sources with a part for each of their numbers of copies
    wanted = F.broadcast(spark.createDataFrame(parts, "source string, low double, high double"))
    within = sized.join(wanted, "source").filter((F.col("number") >= F.col("low")) & (F.col("number") < F.col("high")))
    step = F.least(F.floor((F.col("number") - F.col("low")) / (F.col("high") - F.col("low")) * STEPS), F.lit(STEPS - 1)).cast("int")
    found: dict[tuple[str, float], dict[int, int]] = {}
    for source, low, n, size in within.groupBy("source", "low", step.alias("step")).agg(F.sum("size").cast("long")).collect():
        found.setdefault((source, low), {})[n] = size
    return found


def plan(sized: DataFrame, targets: list[tuple[str, float, int]], total: float | None) -> Plan:
    """sized: rows (source, number, size), read once for each round. Without a total, the largest one
    at which every source that has documents can fill its share."""
    first = _histogram(sized, [(s, 0.0, 1.0) for s, _, _ in targets]) if targets else {}
    supply = {s: sum(first.get((s, 0.0), {}).values()) for s, _, _ in targets}
    present = [(s, w, c) for s, w, c in targets if supply[s] > 0 and w > 0 and c > 0]
    share = sum(w for _, w, _ in present)
    if total is None:
        total = min((supply[s] * c / (w / share) for s, w, c in present), default=0.0)
    known = {s: Sizes(supply[s]) for s, _, _ in present}
    for s, _, _ in present:
        known[s].refine(0.0, 1.0, first[s, 0.0])
    means: dict[str, float] = {}
    for turn in range(MOST_ROUNDS):
        wanted: list[tuple[str, float, float]] = []
        for s, w, c in present:
            target = total * w / share
            means[s] = calibrated_mean(known[s], c, target)
            low, high, parts = known[s].bounds(means[s], c)
            if high - low > TOLERANCE * target:
                wanted += [(s, a, b) for a, b in dict.fromkeys(parts) if b - a > 2.0**-52]
        if not wanted or turn == MOST_ROUNDS - 1:
            break
        found = _histogram(sized, wanted)
        for s, a, b in wanted:
            known[s].refine(a, b, found.get((s, a), {}))
    rows = []
    for s, w, c in targets:
        mean = means.get(s, 0.0)
        rows.append((s, w, c, supply[s], mean, tails(mean, c) if mean > 0 else []))
    return Plan(rows, total)


def mix(
    sized: DataFrame,
    targets: DataFrame,
    *,
    key: str,
    source: str,
    size: str,
    weight: str,
    cap: str,
    seed: int = 7,
    total: float | None = None,
    content: DataFrame | None = None,
    keep: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The mixture (key, source, copy, place, then keep) in the order of place, and the report of shares.

    sized holds a size for each document (key, source, size); targets one row for each source with
    its weight and cap. content holds the documents (key, source, and the columns to keep) that may
    be drawn, those with a size above zero: their copies are drawn on its own scan, so that what is
    kept is never written or joined; without it, what is kept comes from sized. Documents of other
    sources or without one are left out, as are those with a null or zero size or a null key. Sources
    without documents, weight or cap get nothing and the others keep their proportions. A row that is
    repeated counts as another document, with the same number of copies. Of a source named twice in
    targets the first in the order of (weight, cap) counts. A source whose target is all that its cap
    allows comes out with every document exactly cap times.
    Report: source, weight, cap, docs, supply, mean, used, share of the total; every source of
    targets has its row. Empty tables give an empty mixture.
    """
    spark = sized.sparkSession
    wanted = targets.filter(F.col(source).isNotNull()).select(F.col(source).alias("s"), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("w"), F.coalesce(F.col(cap).cast("int"), F.lit(0)).alias("c"))
    own = wanted.orderBy("s", "w", "c").limit(MOST_SOURCES + 1).collect()
    if len(own) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    rows: dict[str, tuple[str, float, int]] = {}
    for s, w, c in own:
        rows.setdefault(s, (s, max(w, 0.0), max(c, 0)))
    mine = F.col(source).isin(list(rows)) & F.col(key).isNotNull()
    slim = sized.filter(mine).select(F.col(key).alias("k"), F.col(source).alias("source"), F.col(size).cast("long").alias("size"))
    slim = materialize(slim)
    # after the write: a filter before it would compute a size that Python counts twice
    slim = slim.filter("size > 0").withColumn("number", _number("k", seed))
    made = plan(slim, list(rows.values()), total)
    table = spark.createDataFrame(made.rows, "source string, weight double, cap int, supply long, mean double, limits array<double>")
    limits = F.broadcast(table.select("source", "limits"))
    copies = F.size(F.filter("limits", lambda t: F.col("number") < t))

    def drawn(docs: DataFrame) -> DataFrame:
        return docs.join(limits, "source").withColumn("copies", copies).filter("copies > 0")

    kept = {f"_keep{i}": c for i, c in enumerate(keep or [])}
    if content is None and kept:
        content = sized.filter(F.col(size) > 0)
    if content is None:
        docs = slim
    else:
        docs = content.filter(mine).select(F.col(key).alias("k"), F.col(source).alias("source"), *[F.col(c).alias(new) for new, c in kept.items()]).withColumn("number", _number("k", seed))
    exploded = drawn(docs).select("k", "source", *kept, F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    mixture = (
        exploded.withColumn("place", F.xxhash64("k", "copy", F.lit(seed + 1)))
        .orderBy("place", "k", "copy")
        .select(F.col("k").alias(key), "source", "copy", "place", *[F.col(new).alias(c) for new, c in kept.items()])
    )
    used = drawn(slim).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("used"))
    count = slim.groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
    joined = table.drop("limits").join(count, "source", "left").join(used, "source", "left").na.fill(0, ["docs", "used"])
    # the report has one row for each of at most MOST_SOURCES sources
    whole = F.sum("used").over(Window.partitionBy(F.lit(0)))
    report = joined.withColumn("share", F.when(whole > 0, F.col("used") / whole).otherwise(F.lit(0.0)))
    report = report.select("source", "weight", "cap", "docs", "supply", "mean", "used", "share")
    return mixture, report
