"""Matching entities across sources without keys: probabilistic record linkage.

Several blocking passes (identifiers, corrected identifiers, titles and aliases in several
reductions) propose pairs. A pair is compared field by field in levels of agreement; the counts of
the patterns of levels, a table of bounded size, are all that expectation-maximisation needs to
estimate how probable each level is among matches and among non-matches. The posterior of a pair's
pattern is its confidence.
"""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bibliolake.common import join_by_counted_key, materialize
from bibliolake.llm.reflist import _HAN, _TOKEN, _content, bare, folded, joined, most_edits

#: The rows of a block that meet in one task. A key that more classes share is common: its classes are
#: dealt to parts of about this size, and every part meets every other one.
MOST_IN_BLOCK = 200
#: Pairs from this posterior on are matches; a third record links two others from the higher one on.
THRESHOLD, SURE = 0.65, 0.9
#: Rounds of expectation-maximisation, and the pairs' worth of belief in the starting values.
EM_ROUNDS, EM_BELIEF = 40, 20.0

# Starting probabilities of each level among matches and non-matches, level 0 first.
START = {
    "ids": ([0.04, 0.04, 0.92], [0.80, 0.02, 0.18]),
    "title": ([0.02, 0.22, 0.76], [0.70, 0.05, 0.25]),
    "publisher": ([0.03, 0.97], [0.92, 0.08]),
}
FIELDS = tuple(START)

# What indexes add after a title.
_ADDITION = re.compile(r"\s*(?:[-(/]\s*(?:print|online|quarterly|monthly|annual|weekly|series)\b\)?|:\s*an? (?:international|interdisciplinary) \w+)\s*$")


def clean_identifier(value: str | None) -> str:
    """An identifier's digits; empty if it cannot be one."""
    if not value:
        return ""
    value = re.sub(r"(?i)[ep]?-?issn", "", unicodedata.normalize("NFKC", value)).upper()
    value = re.sub(r"[^0-9X]", "", value)
    return value if 7 <= len(value) <= 9 and "X" not in value[:-1] else ""


def valid_identifier(x: str) -> bool:
    """Whether the check digit holds."""
    if len(x) != 8:
        return False
    return sum((8 - i) * int(c) for i, c in enumerate(x[:7])) % 11 == -(10 if x[7] == "X" else int(x[7])) % 11


def corrections(x: str) -> list[str]:
    """Valid identifiers one slip away from an invalid one: a digit, a swap, one missing or too many."""
    out = set()
    digits = "0123456789X"
    if len(x) == 8:
        out |= {x[:i] + d + x[i + 1 :] for i in range(8) for d in digits}
        out |= {x[:i] + x[i + 1] + x[i] + x[i + 2 :] for i in range(7)}
    elif len(x) == 7:
        out |= {x[:i] + d + x[i:] for i in range(8) for d in digits}
    else:
        out |= {x[:i] + x[i + 1 :] for i in range(len(x))}
    return sorted(y for y in out if "X" not in y[:-1] and valid_identifier(y))


def names_of(values: list[str | None]) -> list[str]:
    """The distinct names among titles and aliases, as words without case, accents and additions."""
    out = []
    for v in values:
        if v and v.strip():
            tokens = _TOKEN.findall(_ADDITION.sub("", bare(folded(v))))
            tokens = tokens[1:] if len(tokens) > 2 and tokens[0] == "the" else tokens
            if _HAN.search(v):
                tokens = [joined(tokens)]
            if tokens:
                out.append(" ".join(tokens))
    return list(dict.fromkeys(out))


def _short(name: str) -> str:
    return " ".join(sorted("j" if t == "journal" else t[:3] for t in _content(name.split())))


def keys_of(names: list[str], ids: list[str], bad: list[str], publisher: str | None) -> list[str]:
    """The blocking keys of a record, from all passes."""
    out = {f"i{x}" for x in ids}
    for x in bad:
        out |= {f"i{y}" for y in corrections(x)}
    for name in names:
        if publisher:
            # a name that very many records share is split by its publishers
            out.add(f"q{publisher}|" + "".join(sorted(set(name))))
        if _HAN.search(name):
            out.add("h" + "".join(sorted(set(name))))
        else:
            tokens = _content(name.split())
            out.add("t" + "".join(tokens))
            if len(tokens) >= 3:
                short = _short(name).split()
                out.add("s" + " ".join(short))
                if publisher and len(short) >= 4:
                    out |= {f"p{publisher}|" + " ".join(short[:i] + short[i + 1 :]) for i in range(len(short))}
    return sorted(out)


def _edits(a: str, b: str, most: int, replace: bool) -> int:
    """The optimal string alignment distance, most + 1 if it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (0 if x == y else 1 if replace else 9))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def _begins(short: str, long: str) -> bool:
    """Whether long begins with short, one slip in longer beginnings allowed."""
    if long.startswith(short):
        return True
    return len(short) >= 4 and short[0] == long[0] and any(_edits(short, long[:n], 1, True) <= 1 for n in (len(short) - 1, len(short), len(short) + 1))


def _abbreviates(a: list[str], b: list[str]) -> bool:
    """Whether each word of the shorter name begins another of the longer one, in any order, all used."""
    if len(a) != len(b) or len(a) < 3:
        return False
    short, long = sorted((a, b), key=lambda words: sum(map(len, words)))
    left = sorted(long, key=len)
    for t in sorted(short, key=len, reverse=True):
        hit = next((w for w in left if _begins(t, w)), None) or next((w for w in left if len(w) >= 3 and t.startswith(w)), None)
        if hit is None:
            return False
        left.remove(hit)
    return True


def title_level(a: list[str], b: list[str]) -> int:
    """2: a name in common; 1: one abbreviates, extends or misspells another; 0: others; -1: in
    different scripts, which says nothing."""
    if not a or not b:
        return -1
    own, other = set(a), set(b)
    if own & other:
        return 2
    comparable = False
    for x in own:
        han = bool(_HAN.search(x))
        for y in other:
            if han != bool(_HAN.search(y)):
                continue
            comparable = True
            p, q = x.replace(" ", ""), y.replace(" ", "")
            if p == q:
                return 2
            most = most_edits(p) + (han and len(p) >= 7)  # either of the two may have a slip
            if _edits(p, q, most, not han) <= most:
                return 1
            if not han:
                s, t = _content(x.split()), _content(y.split())
                if s == t:
                    return 2
                few, many = sorted((s, t), key=len)
                if _abbreviates(s, t) or (len(few) >= 4 and set(few) < set(many)):
                    return 1
                if len(few) >= 4 and len(few) < len(many) and _edits("".join(few), "".join(many[: len(few)]), 2, True) <= 2:
                    return 1
    return 0 if comparable else -1


def id_level(a_print: list[str], a_online: list[str], b_print: list[str], b_online: list[str]) -> int:
    """2: an identifier in common, whatever its kind; 1: one that a slip explains; 0: none although
    both have one of a kind; -1: nothing to compare."""
    own, other = {*a_print, *a_online}, {*b_print, *b_online}
    if not own or not other:
        return -1
    if own & other:
        return 2
    for x in own:
        for y in other:
            if valid_identifier(x) != valid_identifier(y) and _edits(x, y, 1, True) <= 1:
                return 1
    ok = valid_identifier
    both = (any(map(ok, a_print)) and any(map(ok, b_print))) or (any(map(ok, a_online)) and any(map(ok, b_online)))
    return 0 if both else -1


_PREPARED = T.StructType(
    [T.StructField(n, T.ArrayType(T.StringType())) for n in ("names", "printed", "online", "keys")]
    + [T.StructField("publisher", T.StringType())]
    + [T.StructField(n, T.BooleanType()) for n in ("print_ok", "online_ok", "slips")]
)


@F.pandas_udf(_PREPARED)
def _prepare(titles: pd.Series, formal: pd.Series, aliases: pd.Series, issn: pd.Series, eissn: pd.Series, publishers: pd.Series) -> pd.DataFrame:
    rows = []
    for title, other, names, p, e, publisher in zip(titles, formal, aliases, issn, eissn, publishers):
        own = names_of([title, other, *(names if names is not None else [])])
        printed = sorted({y for x in (p if p is not None else []) if (y := clean_identifier(x))})
        online = sorted({y for x in (e if e is not None else []) if (y := clean_identifier(x))})
        house = " ".join(_TOKEN.findall(folded(publisher))) if publisher and publisher.strip() else None
        ids = {*printed, *online}
        good = sorted(x for x in ids if valid_identifier(x))
        keys = keys_of(own, [*good, *sorted(ids - set(good))], sorted(ids - set(good)), house)
        rows.append((own, printed, online, keys, house, any(map(valid_identifier, printed)), any(map(valid_identifier, online)), len(good) < len(ids)))
    return pd.DataFrame(rows, columns=["names", "printed", "online", "keys", "publisher", "print_ok", "online_ok", "slips"])


#: Comparisons of names that a Python worker keeps.
MOST_KEPT = 100_000
_kept: dict[tuple[tuple[str, ...], tuple[str, ...]], int] = {}


@F.pandas_udf(T.IntegerType())
def _title_levels(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for n, m in zip(a, b):
        if n is None or m is None:
            out.append(None)
            continue
        pair = (tuple(n), tuple(m))
        level = _kept.get(pair)
        if level is None:
            if len(_kept) >= MOST_KEPT:
                _kept.clear()
            level = _kept[pair] = title_level(*map(list, pair))
        out.append(level)
    return pd.Series(out, dtype="Int32")


@F.pandas_udf(T.IntegerType())
def _id_levels(ap: pd.Series, ao: pd.Series, bp: pd.Series, bo: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else id_level(list(p), list(o), list(q), list(r)) for p, o, q, r in zip(ap, ao, bp, bo)], dtype="Int32")


def _levels() -> tuple[Column, Column]:
    """The levels of title and identifiers of pairs with a_ and b_ columns. What equal names or
    identifiers decide, or identifiers that are all valid, the JVM decides; only the other pairs
    go to Python, and names that were compared before are not compared again."""
    c = F.col
    plain_title = F.when((F.size("a_names") == 0) | (F.size("b_names") == 0), -1).when(F.arrays_overlap("a_names", "b_names"), 2)
    open_title = plain_title.isNull()
    title = F.coalesce(plain_title, _title_levels(F.when(open_title, c("a_names")), F.when(open_title, c("b_names"))))
    one, other = F.concat("a_printed", "a_online"), F.concat("b_printed", "b_online")
    both = (c("a_print_ok") & c("b_print_ok")) | (c("a_online_ok") & c("b_online_ok"))
    plain_ids = F.when((F.size(one) == 0) | (F.size(other) == 0), -1).when(F.arrays_overlap(one, other), 2).when(~c("a_slips") & ~c("b_slips"), F.when(both, 0).otherwise(-1))
    open_ids = plain_ids.isNull()
    ids = F.coalesce(plain_ids, _id_levels(*[F.when(open_ids, c(x)) for x in ("a_printed", "a_online", "b_printed", "b_online")]))
    return title, ids


def _keyed(classes: DataFrame) -> DataFrame:
    """Rows (rep, source, key, n) of the keys that n > 1 classes share."""
    keyed = classes.select("rep", "source", F.explode("keys").alias("key"))
    sizes = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    return materialize(join_by_counted_key(keyed, sizes, ["key"], "n"))


def _dealt(n: Column, by: Column) -> list[Column]:
    """Columns (_own, _met) of a row of a block of n: its part, and, a row each, the parts that it meets."""
    parts = F.ceil(n / F.lit(MOST_IN_BLOCK)).cast("int")
    return [F.pmod(F.xxhash64(by), parts).cast("int").alias("_own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_met")]


def candidate_pairs(classes: DataFrame, keyed: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (a, b), a < b, of classes of different sources that share a key that is not common."""
    keyed = _keyed(classes) if keyed is None else keyed
    blocks = keyed.filter(F.col("n") <= MOST_IN_BLOCK)
    left = blocks.select("key", F.col("rep").alias("a"), F.col("source").alias("_s"))
    right = blocks.select("key", F.col("rep").alias("b"), F.col("source").alias("_t"))
    return left.join(right, "key").filter((F.col("a") < F.col("b")) & (F.col("_s") != F.col("_t"))).select("a", "b").distinct()


def common_pairs(keyed: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of classes of different sources that share a common key: all of
    them, so their number grows with the square of the block; a task holds the pairs of two parts."""
    blocks = keyed.filter(F.col("n") > MOST_IN_BLOCK).select("key", "rep", "source", *_dealt(F.col("n"), F.col("rep")))
    left = blocks.select("key", F.col("rep").alias("a"), F.col("source").alias("_s"), "_own", "_met")
    right = blocks.select("key", F.col("rep").alias("b"), F.col("source").alias("_t"), F.col("_met").alias("_own"), F.col("_own").alias("_met"))
    return left.join(right, ["key", "_own", "_met"]).filter((F.col("a") < F.col("b")) & (F.col("_s") != F.col("_t"))).select("a", "b").distinct()


def _through_many(ways: DataFrame, keyed: DataFrame) -> DataFrame:
    """Rows (a, b, p), a < b, of classes x of different sources that have a via with very many ways
    (via, x, s, p) in common. Two that share a common key were compared themselves, so only sets of
    common keys without one in common meet: a common block is passed over without making its pairs."""
    common = keyed.filter(F.col("n") > MOST_IN_BLOCK).groupBy(F.col("rep").alias("x")).agg(F.array_sort(F.collect_set("key")).alias("common"))
    ways = materialize(ways.select("via", "x", "s", "p").join(common, "x", "left").withColumn("common", F.coalesce("common", F.array().cast("array<string>"))))
    sets = materialize(ways.groupBy("via", "common").agg(F.count(F.lit(1)).alias("n")))
    other = sets.select("via", F.col("common").alias("other"), F.col("n").alias("m"))
    meeting = sets.join(other, "via").filter(~F.arrays_overlap("common", "other")).select("via", "common", "other", F.greatest("n", "m").alias("n"))
    dealt = ways.join(meeting, ["via", "common"]).select("via", "common", "other", "x", "s", "p", *_dealt(F.col("n"), F.col("x")))
    swapped = {"common": "other", "other": "common", "_own": "_met", "_met": "_own"}
    right = dealt.select("via", *[F.col(c).alias(new) for c, new in swapped.items()], F.col("x").alias("y"), F.col("s").alias("t"), F.col("p").alias("q"))
    both = dealt.join(right, ["via", "common", "other", "_own", "_met"]).filter("x < y and s <> t")
    return both.select(F.col("x").alias("a"), F.col("y").alias("b"), (F.col("p") * F.col("q")).alias("p"))


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> dict[tuple[int, ...], float]:
    """The posterior of each pattern of levels, by expectation-maximisation over the patterns' counts.

    Fields are independent given a match or a non-match; a level of -1 says nothing. The starting
    values keep a little weight, so that rare levels cannot run away.
    """
    m = [list(START[f][0]) for f in FIELDS]
    u = [list(START[f][1]) for f in FIELDS]
    share = 0.7
    posterior: dict[tuple[int, ...], float] = {}
    for _ in range(EM_ROUNDS):
        for levels, _count in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(m[i][x] / u[i][x]) for i, x in enumerate(levels) if x >= 0)
            posterior[levels] = 1 / (1 + math.exp(-max(min(odds, 60), -60)))
        total = sum(n for _, n in patterns)
        if not total:
            break
        matched = sum(posterior[x] * n for x, n in patterns)
        share = min(max((matched + 0.7 * EM_BELIEF) / (total + EM_BELIEF), 0.01), 0.99)
        for i, f in enumerate(FIELDS):
            for table, start, weight in ((m[i], START[f][0], 1), (u[i], START[f][1], 0)):
                sums = [EM_BELIEF * s for s in start]
                for levels, n in patterns:
                    if levels[i] >= 0:
                        sums[levels[i]] += n * (posterior[levels] if weight else 1 - posterior[levels])
                table[:] = [s / sum(sums) for s in sums]
    return posterior


def link_records(
    df: DataFrame, *, key: str, source: str, title: str, formal_title: str, aliases: str, issn: str, eissn: str, publisher: str
) -> DataFrame:
    """Pairs (left, right, confidence) of records of different sources that are one entity.

    left is smaller than right by code point. Records alike in source and all compared fields form
    a class; classes are compared and their members' pairs come out. Two records that a third links
    with great confidence match too, with the product of both confidences, unless they were compared
    and found different. Null fields say nothing; records without any title and identifier, without
    a key or without a source match nothing; rows that repeat a key count once; other columns are
    ignored; an empty table gives no pairs.
    """
    spark = df.sparkSession
    own = df.filter(F.col(key).isNotNull() & F.col(source).isNotNull()).dropDuplicates([key])
    prepared = own.select(
        F.col(key).alias("id"), F.col(source).alias("source"), _prepare(*[F.col(c) for c in (title, formal_title, aliases, issn, eissn, publisher)]).alias("p")
    ).select("id", "source", "p.*")
    prepared = materialize(prepared)
    fields = ["source", "names", "printed", "online", "publisher"]
    marked = prepared.withColumn("class", F.sha2(F.to_json(F.struct(*fields)), 256))
    by_class = materialize(marked.groupBy("class").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    members = materialize(join_by_counted_key(marked.select("class", "id"), by_class, ["class"], "n").select("rep", "id"))
    classes = materialize(prepared.join(members.filter("rep = id").select("id"), "id", "left_semi").withColumnRenamed("id", "rep"))
    keyed = _keyed(classes)
    pairs = candidate_pairs(classes, keyed)
    if not keyed.filter(F.col("n") > MOST_IN_BLOCK).isEmpty():
        pairs = pairs.unionByName(common_pairs(keyed)).distinct()
    carried = ("rep", "source", "names", "printed", "online", "publisher", "print_ok", "online_ok", "slips")
    left = classes.select(*[F.col(c).alias(f"a_{c}") for c in carried])
    right = classes.select(*[F.col(c).alias(f"b_{c}") for c in carried])
    both = pairs.join(left, F.col("a") == F.col("a_rep")).join(right, F.col("b") == F.col("b_rep"))
    title_of, ids_of = _levels()
    house = F.when(F.col("a_publisher").isNull() | F.col("b_publisher").isNull(), F.lit(-1)).otherwise((F.col("a_publisher") == F.col("b_publisher")).cast("int"))
    compared = materialize(both.select("a", "b", "a_source", "b_source", ids_of.alias("ids"), title_of.alias("title"), house.alias("publisher")))
    counts = [((r[0], r[1], r[2]), r[3]) for r in compared.groupBy(*FIELDS).agg(F.count(F.lit(1))).collect()]
    posterior = estimate(sorted(counts))
    table = F.broadcast(spark.createDataFrame([(*x, float(p)) for x, p in posterior.items()], "ids int, title int, publisher int, p double"))
    scored = materialize(compared.join(table, list(FIELDS)).select("a", "b", "a_source", "b_source", "p"))
    matched = scored.filter(F.col("p") >= THRESHOLD)
    # two that a third links, unless they were compared themselves
    sure = scored.filter(F.col("p") >= SURE)
    ways = sure.select(F.col("a").alias("via"), F.col("b").alias("x"), F.col("b_source").alias("s"), "p").unionByName(
        sure.select(F.col("b").alias("via"), F.col("a").alias("x"), F.col("a_source").alias("s"), "p")
    )
    links = materialize(ways.groupBy("via").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    ways = materialize(join_by_counted_key(ways, links, ["via"], "n"))
    few, many = ways.filter(F.col("n") <= MOST_IN_BLOCK), ways.filter(F.col("n") > MOST_IN_BLOCK)
    hop = few.alias("l").join(few.alias("r"), F.col("l.via") == F.col("r.via")).filter("l.x < r.x and l.s <> r.s")
    hop = hop.select(F.col("l.x").alias("a"), F.col("r.x").alias("b"), (F.col("l.p") * F.col("r.p")).alias("p"))
    if not many.isEmpty():
        hop = hop.unionByName(_through_many(many, keyed))
    hop = hop.groupBy("a", "b").agg(F.max("p").alias("p"))
    hop = hop.join(scored.select("a", "b"), ["a", "b"], "left_anti")
    linked = matched.select("a", "b", "p").unionByName(hop.select("a", "b", "p"))
    out = linked.join(members.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a").join(members.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b")
    return out.select(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"), F.col("p").alias("confidence"))
