"""Best representative of each duplicate group: Bayesian fusion of claims with copy detection.

Records of a group claim values of fields. Records come through channels (the sources). Rounds of
estimation give each source an accuracy and each pair of sources a probability that one copies the
other, which shared false values raise and differing values lower; the votes of a likely copier are
discounted. To the votes come the prior odds of a value for how many of three criteria its best
record meets: latest, from a trusted record, complete. How much that says is learned in the same
rounds, from how often values meet them that are held for true and for false. The value of the
greatest posterior survives, with the best of the records that hold it.

A vote depends only on the set of sources that claim a value. So the large tables are reduced to one
row for each set of sources (and number of criteria met), and all that is learned comes from that
small table, as DataFrames keyed by source and by pair of sources; no source is pooled with others.
Nothing collects a group: hot groups are summed in parts, all others meet in one shuffle a round.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bibliolake.common import HOT_PARTS, join_by_counted_key, materialize, release
from bibliolake.operators.catalog import small

#: Rounds of estimation, a copier's share of copied values, prior probability of copying, number
#: of false values that a field is assumed to have.
ROUNDS, COPY_RATE, COPY_PRIOR, FALSE_VALUES = 2, 0.8, 0.1, 10
#: What is believed before any round, and as how many values it counts: a source's accuracy; how often
#: a true and how often a false value meets 0, 1, 2 and 3 of the criteria.
START_ACCURACY, BELIEF = 0.8, 5.0
START_MET = [(0.002, 0.08), (0.008, 0.32), (0.04, 0.5), (0.95, 0.1)]
#: Log odds beyond this are all the same: exp must not overflow.
MOST_SCORE = 600.0


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$", "")


def _entries(column: str) -> Column:
    """A list as a set: entries trimmed, without blanks and repeats, in order; null if none is left."""
    own = F.array_sort(F.array_distinct(F.filter(F.transform(F.col(column), _trimmed), lambda x: x != "")))
    return F.when(F.size(own) > 0, own)


def claims_of(
    groups: DataFrame, records: DataFrame, *, group: str, key: str, counts: list[str], lists: list[str], seen: str, doubtful: str, source: Column
) -> DataFrame:
    """Usable values as rows (g, field, value, entries, record, at, trusted, source), each once."""
    # records are shuffled as they are; their cells are made of those that belong to a group
    raw = {f"_f{i}": c for i, c in enumerate([*counts, *lists])}
    own = records.select(
        F.col(key).alias("record"),
        F.coalesce(F.col(seen).cast("timestamp"), F.lit("0001-01-01 00:00:00").cast("timestamp")).alias("at"),
        F.coalesce(~F.col(doubtful), F.lit(False)).alias("trusted"),
        source.alias("source"),
        *[F.col(c).alias(new) for new, c in raw.items()],
    )
    members = groups.select(F.col(group).alias("g"), F.col(key).alias("record")).filter(F.col("g").isNotNull() & F.col("record").isNotNull()).distinct()

    def cell(new: str, c: str) -> Column:
        if c in counts:
            value, entries = F.when(F.col(new) >= 0, F.col(new).cast("string")), F.lit(None).cast("array<string>")
        else:
            value, entries = F.array_join(_entries(new), "\x1f"), _entries(new)
        return F.struct(F.lit(c).alias("field"), value.alias("value"), entries.alias("entries"))

    cells = F.filter(F.array(*[cell(new, c) for new, c in raw.items()]), lambda x: x["value"].isNotNull())
    joined = members.join(own, "record").select("g", "record", "at", "trusted", "source", F.explode(cells).alias("_cell"))
    return joined.select("g", "_cell.field", "_cell.value", "_cell.entries", "record", "at", "trusted", "source").distinct()


def _pairs(codes: str) -> Column:
    """All pairs of two entries of a sorted list, the smaller first."""
    return F.flatten(F.transform(codes, lambda a, i: F.transform(F.slice(codes, i + 2, F.size(codes)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def copying(stats: DataFrame, met: DataFrame, accuracy: DataFrame) -> DataFrame:
    """(a, b, copies): the probability that one of two sources copies the other. stats has one row for
    each set of sources of values (codes, true, n); met one for each set of sources that claim a field
    of a group (codes, n). Sharing false values speaks for it, differing against it."""
    same = stats.filter(F.size("codes") > 1).select("true", "n", F.explode(_pairs("codes")).alias("p")).groupBy("p.a", "p.b").agg(F.sum("true").alias("_true"), F.sum(F.col("n") - F.col("true")).alias("_false"))
    both = met.filter(F.size("codes") > 1).select("n", F.explode(_pairs("codes")).alias("p")).groupBy("p.a", "p.b").agg(F.sum("n").alias("_both"))
    known = both.join(same, ["a", "b"], "left").na.fill(0.0, ["_true", "_false"])
    known = known.join(small(accuracy.select(F.col("source").alias("a"), F.col("accuracy").alias("x"))), "a").join(small(accuracy.select(F.col("source").alias("b"), F.col("accuracy").alias("y"))), "b")
    x, y, mean = F.col("x"), F.col("y"), (F.col("x") + F.col("y")) / 2
    t, f = x * y, (1 - x) * (1 - y) / FALSE_VALUES
    differ = F.greatest(F.col("_both") - F.col("_true") - F.col("_false"), F.lit(0.0))
    gain = (
        F.col("_true") * F.log((COPY_RATE * mean + (1 - COPY_RATE) * t) / t)
        + F.col("_false") * F.log((COPY_RATE * (1 - mean) + (1 - COPY_RATE) * f) / f)
        + differ * F.log(F.lit(1 - COPY_RATE))
    )
    odds = F.lit(COPY_PRIOR / (1 - COPY_PRIOR)) * F.exp(F.greatest(F.least(gain, F.lit(50.0)), F.lit(-50.0)))
    return known.select("a", "b", (odds / (1 + odds)).alias("copies"))


def accuracies(stats: DataFrame) -> DataFrame:
    """(source, accuracy): the share of a source's values that are held for true."""
    each = stats.select(F.explode("codes").alias("source"), "true", "n").groupBy("source").agg(F.sum("true").alias("_t"), F.sum("n").alias("_n"))
    share = (F.col("_t") + START_ACCURACY * BELIEF) / (F.col("_n") + BELIEF)
    return each.select("source", F.greatest(F.least(share, F.lit(0.95)), F.lit(0.05)).alias("accuracy"))


def votes(profiles: DataFrame, accuracy: DataFrame, copied: DataFrame) -> DataFrame:
    """(codes, votes): the log odds that a set of sources gives a value: of each source ln(n A / (1 - A)),
    times the probability that it copied from none of those before it, the most accurate first."""
    each = profiles.select("codes", F.explode("codes").alias("source")).join(small(accuracy), "source")
    weight = F.log(F.lit(FALSE_VALUES) * F.col("accuracy") / (1 - F.col("accuracy")))
    each = each.select("codes", F.struct((-F.col("accuracy")).alias("o"), "source").alias("s"), weight.alias("w"))
    sets = each.groupBy("codes").agg(F.array_sort(F.collect_list("s")).alias("order"))
    before = sets.select("codes", F.posexplode("order").alias("_i", "s"), "order").select("codes", "s", F.explode_outer(F.expr("slice(order, 1, _i)")).alias("e"))
    pair = before.select("codes", "s", F.least("s.source", "e.source").alias("a"), F.greatest("s.source", "e.source").alias("b"), F.col("e").isNotNull().alias("_pair"))
    free = pair.join(small(copied), ["a", "b"], "left").groupBy("codes", "s").agg(F.exp(F.sum(F.when(F.col("_pair"), F.log1p(-COPY_RATE * F.coalesce("copies", F.lit(0.0)))).otherwise(F.lit(0.0)))).alias("free"))
    return each.join(free, ["codes", "s"]).groupBy("codes").agg(F.sum(F.col("w") * F.col("free")).alias("votes"))


def criteria(stats: DataFrame) -> list[float]:
    """The log odds for 0 .. 3 criteria met, of four sums over all values."""
    met = {r[0]: (r[1], r[2]) for r in stats.groupBy("good").agg(F.sum("true"), F.sum(F.col("n") - F.col("true"))).collect()}
    true = [met.get(k, (0.0, 0.0))[0] + BELIEF * START_MET[k][0] for k in range(4)]
    false = [met.get(k, (0.0, 0.0))[1] + BELIEF * START_MET[k][1] for k in range(4)]
    return [math.log((t / sum(true)) / (f / sum(false))) for t, f in zip(true, false)]


def _scored(values: DataFrame, voted: DataFrame, prior: list[float], limit: int) -> DataFrame:
    """values with score and posterior p. Groups of more than limit claims are summed in parts and get
    their sums back by a broadcast (there are fewer than HOT_PARTS of them), the others by a window."""
    weight = F.element_at(F.array(*[F.lit(x) for x in prior]), F.col("good") + 1)
    rows = values.join(small(voted), "codes").withColumn("score", F.least(F.col("votes") + weight, F.lit(MOST_SCORE))).withColumn("_e", F.exp("score"))
    cold = rows.filter(F.col("_n") <= limit).withColumn("p", F.col("_e") / F.sum("_e").over(W.partitionBy("g", "field")))
    hot = rows.filter(F.col("_n") > limit)
    sums = F.broadcast(hot.groupBy("g", "field").agg(F.sum("_e").alias("_whole")))
    return cold.unionByName(hot.join(sums, ["g", "field"]).withColumn("p", F.col("_e") / F.col("_whole")).drop("_whole")).drop("_e", "votes")


def fuse(claims: DataFrame) -> DataFrame:
    """One row (g, field, value, record, posterior, is_full, full_records) for each group and field.

    record is the record whose value survives: of those that hold it the one that meets most of the
    criteria, then the trusted, the latest, the smallest. is_full says that it is the latest,
    trusted (if any is) and complete (holds all entries of the group's lists) at once; full_records
    is the number of records in the group that are. A group and field without a usable value gives
    no row; equal posteriors are decided by the value's record as above. A null source is one source.
    What is learned of pairs grows with the square of the sources that claim one field of a group:
    sources are channels, not records. An empty table gives no rows.
    """
    claims = materialize(claims.withColumn("source", F.coalesce("source", F.lit("\x00"))))
    whole = claims.groupBy("g", "field").agg(F.max("at").alias("_at"), F.max("trusted").alias("_trusted"), F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_set("source")).alias("_sources"))
    distinct_lists = claims.filter(F.col("entries").isNotNull()).select("g", "field", F.explode("entries").alias("e")).distinct()
    union = distinct_lists.groupBy("g", "field").agg(F.count(F.lit(1)).alias("_all"))
    whole = materialize(whole.join(union, ["g", "field"], "left"))
    total = whole.agg(F.sum("_n")).first()[0] or 0
    met = materialize(whole.groupBy(F.col("_sources").alias("codes")).agg(F.count(F.lit(1)).alias("n")))
    judged = join_by_counted_key(claims, whole.drop("_sources"), ["g", "field"], "_n")
    latest, sure = (F.col("at") == F.col("_at")).cast("int"), (F.col("trusted") | ~F.col("_trusted")).cast("int")
    complete = F.coalesce(F.col("entries").isNull() | (F.size("entries") == F.col("_all")), F.lit(False)).cast("int")
    judged = judged.select("g", "field", "value", "record", "source", "_n", F.unix_micros("at").alias("at"), sure.alias("sure"), (latest + sure + complete).alias("good"))
    best = F.min(F.struct((-F.col("good")).alias("good"), (-F.col("sure")).alias("sure"), (-F.col("at")).alias("at"), "record"))
    values = judged.groupBy("g", "field", "value").agg(best.alias("_order"), F.count_if(F.col("good") == 3).alias("full"), F.max("_n").alias("_n"), F.array_sort(F.collect_set("source")).alias("codes"))
    values = materialize(values.withColumn("good", -F.col("_order.good")))
    limit = max(int(total) // HOT_PARTS, 10_000)

    # the first round believes the start: all sources alike, none a copier
    profiles = materialize(values.groupBy("codes").agg(F.count(F.lit(1)).alias("n")))
    accuracy = profiles.select(F.explode("codes").alias("source")).distinct().withColumn("accuracy", F.lit(START_ACCURACY))
    copied = claims.sparkSession.createDataFrame([], "a string, b string, copies double")
    prior = [math.log(t / f) for t, f in START_MET]
    voted = votes(profiles, accuracy, copied)
    for _ in range(ROUNDS):
        stats = materialize(_scored(values, voted, prior, limit).groupBy("codes", "good").agg(F.sum("p").alias("true"), F.count(F.lit(1)).alias("n")))
        prior = criteria(stats)
        sets = stats.groupBy("codes").agg(F.sum("true").alias("true"), F.sum("n").alias("n"))
        accuracy = accuracies(sets)
        following = materialize(votes(profiles, accuracy, copying(sets, met, accuracy)))
        release(voted, stats)
        voted = following
    return (
        _scored(values, voted, prior, limit)
        .groupBy("g", "field")
        .agg(
            F.min_by(F.struct("value", "_order.record", "p", "good"), F.struct((-F.col("score")).alias("s"), "_order", "value")).alias("_best"),
            F.sum("full").alias("full_records"),
        )
        .select("g", "field", "_best.value", "_best.record", F.col("_best.p").alias("posterior"), (F.col("_best.good") == 3).alias("is_full"), "full_records")
    )
