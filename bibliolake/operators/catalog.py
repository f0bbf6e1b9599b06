"""The journal catalog as tables: index, lookups, groups, scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliolake.functions.clean import display_method, display_title
from bibliolake.functions.keys import conservative_key, exact_key, lookup_keys, normalized_key, signatures

#: A catalog index is broadcast if Spark counts at most so many entries; else it is joined by shuffle.
MOST_BROADCAST = 50_000


def build_index(entries: DataFrame) -> DataFrame:
    """One row for each pair of signatures.

    entries: (ordinal, title, level, group, source, subject, internal_rank). The title and group of
    the smallest level survive, the first seen on ties; sources and subjects are united in the order
    in which they come; the internal rank is the least. Titles without a usable key are left out.
    """
    norm, dotted = signatures(F.col("title"))
    keyed = entries.select("*", norm.alias("signature"), dotted.alias("dotted")).filter((F.length("signature") >= 2) | (F.length("dotted") >= 2))
    first = F.struct("level", "ordinal")

    def united(c: str) -> Column:
        seen = F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("ordinal", F.col(c).alias("x")))))
        return F.array_distinct(F.transform(seen, lambda s: s["x"]))

    return keyed.groupBy("signature", "dotted").agg(
        F.min_by("title", first).alias("matched_title"),
        F.min("level").alias("priority_level"),
        F.min_by("group", first).alias("priority_group"),
        united("source").alias("source_catalogs"),
        united("subject").alias("subject_categories"),
        F.min("internal_rank").alias("ncs_internal_rank"),
        F.min("ordinal").alias("ordinal"),
    )


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint behind a check of the number of rows."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def lookup_general(queries: DataFrame, key: str, journal: str, index: DataFrame) -> DataFrame:
    """Each query's catalog entry by signatures: (key, status, match_method, matched_title, priority_level, priority_group, candidates).

    Entries that share a key are candidates; those of the very pair of signatures are preferred if
    no other entry has the same first signature; several remaining pairs are ambiguous.
    """
    keyed = queries.select(F.col(key), F.col(journal).alias("_j"), display_title(F.col(journal)).alias("_clean"))
    norm, dotted = signatures(F.col("_clean"))
    keyed = keyed.select(key, "_j", norm.alias("_n"), dotted.alias("_d"), F.explode_outer(lookup_keys(F.col("_clean"))).alias("_key"))
    sides = index.select(
        F.explode(F.array_distinct(F.array("signature", "dotted"))).alias("_key"), "signature", "dotted", "matched_title", "priority_level", "priority_group", "ordinal"
    ).filter(F.length("_key") >= 2)
    hits = keyed.join(small(sides), "_key", "left")
    candidate = F.when(F.col("signature").isNotNull(), F.struct("ordinal", "signature", "dotted", "matched_title", "priority_level", "priority_group"))
    per = hits.groupBy(key).agg(F.first("_j").alias("_j"), F.first("_n").alias("_n"), F.first("_d").alias("_d"), F.array_sort(F.collect_set(candidate)).alias("c"))
    exact = F.filter("c", lambda x: (x["signature"] == F.col("_n")) & (x["dotted"] == F.col("_d")))
    collisions = F.filter("c", lambda x: x["signature"] == F.col("_n"))
    chosen = F.when((F.size(exact) > 0) & (F.size(collisions) <= F.size(exact)), exact).otherwise(F.col("c"))
    pairs = F.array_distinct(F.transform("chosen", lambda x: F.struct(x["signature"], x["dotted"])))
    out = per.withColumn("chosen", chosen).withColumn("pairs", F.size(pairs))
    one = F.col("pairs") == 1
    return out.select(
        key,
        F.when(F.col("pairs") == 0, "unmatched").when(F.col("pairs") > 1, "ambiguous").otherwise("matched").alias("status"),
        F.when(one, display_method(F.col("_j"))).alias("match_method"),
        F.when(one, F.get("chosen", F.lit(0))["matched_title"]).alias("matched_title"),
        F.when(one, F.get("chosen", F.lit(0))["priority_level"]).alias("priority_level"),
        F.when(one, F.get("chosen", F.lit(0))["priority_group"]).alias("priority_group"),
        F.when(F.col("pairs") > 1, F.transform("chosen", lambda x: x["matched_title"])).otherwise(F.array().cast("array<string>")).alias("candidates"),
    )


TIERS = ["formal_title_exact", "controlled_alias", "conservative_normalized"]


def tier_keys(catalog: DataFrame) -> DataFrame:
    """(tier, key, journal_id, title) for every way in which an entry can be found by title."""
    titles = catalog.select("journal_id", F.col("formal_title").alias("title"), "aliases")
    by_title = titles.select(F.lit(0).alias("tier"), exact_key(F.col("title")).alias("key"), "journal_id", "title")
    alias = titles.select("journal_id", "title", F.explode("aliases").alias("_a")).filter(F.col("_a").isNotNull())
    by_alias = alias.select(F.lit(1).alias("tier"), exact_key(F.col("_a")).alias("key"), "journal_id", "title")
    by_rest = titles.select(F.lit(2).alias("tier"), normalized_key(F.col("title")).alias("key"), "journal_id", "title")
    return by_title.unionByName(by_alias).unionByName(by_rest).distinct()


def lookup_by_tier(queries: DataFrame, key: str, journal: str, catalog: DataFrame) -> DataFrame:
    """Each query's entry by exact title, else alias, else normalized title: the first way that finds
    any entry decides, and several entries by it are ambiguous. (key, status, match_method, journal_id, matched_title)."""
    ways = F.array(
        F.struct(F.lit(0).alias("tier"), exact_key(F.col(journal)).alias("key")),
        F.struct(F.lit(1).alias("tier"), exact_key(F.col(journal)).alias("key")),
        F.struct(F.lit(2).alias("tier"), normalized_key(F.col(journal)).alias("key")),
    )
    asked = queries.select(F.col(key).alias("_q"), F.explode(ways).alias("_w")).select("_q", "_w.tier", "_w.key")
    hits = asked.join(small(tier_keys(catalog)), ["tier", "key"], "left")
    per_tier = hits.groupBy("_q", "tier").agg(
        F.count("journal_id").alias("n"), F.min("journal_id").alias("journal_id"), F.min("title").alias("title"), F.count_distinct("journal_id").alias("ids")
    )
    found = F.when(F.col("n") > 0, F.col("tier"))
    per = per_tier.groupBy("_q").agg(F.min(found).alias("tier"), F.min_by(F.struct("ids", "journal_id", "title"), found).alias("best"))
    one = F.coalesce(F.col("best.ids") == 1, F.lit(False)) & F.col("tier").isNotNull()
    method = F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.col("tier") + 1)
    return per.select(
        F.col("_q").alias(key),
        F.when(F.col("tier").isNull(), "unmatched").when(one, "matched").otherwise("ambiguous").alias("status"),
        F.when(one, method).alias("match_method"),
        F.when(one, F.col("best.journal_id")).alias("journal_id"),
        F.when(one, F.col("best.title")).alias("matched_title"),
    )


def journals_by_group(index: DataFrame, group: str) -> DataFrame:
    """The distinct titles of a priority group, sorted. An unknown group fails."""
    own = index.filter(F.col("priority_group") == group).select("matched_title").distinct()
    if own.isEmpty():
        raise ValueError(f"no journals in group {group!r}")
    return own.orderBy("matched_title")


def scopes(catalog: DataFrame, rules: DataFrame) -> DataFrame:
    """(scope_id, journal_id, title) of the entries that each rule selects: (scope_id, levels,
    membership), and perhaps ids, a list that alone decides where it is not null."""
    if "ids" not in rules.columns:
        rules = rules.withColumn("ids", F.lit(None).cast("array<string>"))
    entries = catalog.select("journal_id", "formal_title", "priority_level", "index_memberships")
    hit = F.col("membership").isNull() | F.coalesce(F.array_contains("index_memberships", F.col("membership")), F.lit(False))
    levels = rules.filter(F.col("ids").isNull()).select("scope_id", "membership", F.explode(F.array_distinct("levels")).alias("priority_level"))
    by_level = entries.join(F.broadcast(levels), "priority_level").filter(hit)
    listed = rules.select("scope_id", F.explode(F.array_distinct("ids")).alias("journal_id"))
    by_id = entries.join(small(listed), "journal_id")
    return by_level.select("scope_id", "journal_id", F.col("formal_title").alias("title")).unionByName(by_id.select("scope_id", "journal_id", F.col("formal_title").alias("title")))


def wrong_scope_sizes(scope: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """(scope_id, entries, wanted) of the scopes whose number of entries is not the one given."""
    spark = scope.sparkSession
    wanted = F.broadcast(spark.createDataFrame(list(sizes.items()), "scope_id string, wanted long"))
    found = scope.groupBy("scope_id").agg(F.count(F.lit(1)).alias("entries"))
    both = found.join(wanted, "scope_id", "full").na.fill(0, ["entries"])
    return both.filter(~F.col("entries").eqNullSafe(F.col("wanted"))).select("scope_id", "entries", "wanted")


def identifiers(catalog: DataFrame) -> DataFrame:
    """(identifier, journal_id) of all print and online numbers."""
    none = F.array().cast("array<string>")
    own = F.concat(F.coalesce("issn", none), F.coalesce("eissn", none))
    return catalog.select(F.explode(own).alias("identifier"), "journal_id").filter(F.col("identifier").isNotNull()).distinct()


__all__ = ["build_index", "conservative_key", "identifiers", "journals_by_group", "lookup_by_tier", "lookup_general", "scopes", "small", "tier_keys"]
