"""Binding source rows to catalog entries: a cascade of ways, with an audit row for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bibliolake.common import join_by_counted_key, materialize, release
from bibliolake.functions.keys import conservative_key, exact_key
from bibliolake.operators.catalog import identifiers, small

METHODS = ["identifier", "formal_title_exact", "controlled_alias", "conservative_normalized"]
#: Rows come in this order where none is given; numbers of lines go before ids.
ORDER = ["index_name", "source_line", "source_record_id"]
#: Rounds before giving up; there are as many as the longest chain of rows of which each is bound by an
#: identifier that the one before it brought.
MOST_ROUNDS = 200


def _none() -> Column:
    return F.array().cast("array<string>")


def _way(method: str, journal: Column, candidates: Column) -> Column:
    return F.struct(F.lit(method).alias("method"), journal.cast("string").alias("journal_id"), candidates.alias("candidates"))


def _place(order: list[str], index_order: list[str] | None) -> Column:
    """The place of a row among all: indexes as index_order names them, others after it by name."""
    named = F.array_position(F.array(*[F.lit(x) for x in index_order or ["\x00"]]), F.col("index_name"))
    own = [F.when(named > 0, named).otherwise(2**31 - 1).alias("_place")] if index_order else []
    return F.struct(*own, *order)


def controlled_aliases(catalog: DataFrame) -> DataFrame:
    """(key, journal_id) of aliases; the last one in the order of entries wins a key."""
    own = catalog.select("journal_id", F.posexplode("aliases").alias("_p", "_a")).filter(F.col("_a").isNotNull())
    return own.groupBy(exact_key(F.col("_a")).alias("key")).agg(F.max_by("journal_id", F.struct("journal_id", "_p")).alias("journal_id"))


def aliases_of_sources(fixed: DataFrame, catalog: DataFrame, sources: DataFrame, index_name: str, *, order: list[str] = ORDER, wanted: int | None = None) -> DataFrame:
    """(key, alias, journal_id, origin): fixed aliases (alias, journal_id), then those that rows of one
    index state for the entry of the row's own title, the last one winning a key. A row with aliases
    whose title is no entry's fails, as does another number of keys than wanted."""
    by_title = catalog.groupBy(exact_key(F.col("formal_title")).alias("_t")).agg(F.max("journal_id").alias("_j"))
    stated = sources.filter((F.col("index_name") == index_name) & (F.size("aliases") > 0)).withColumn("_o", _place(order, None))
    stated = stated.select("_o", exact_key(F.col("formal_title")).alias("_t"), F.posexplode("aliases").alias("_p", "alias")).join(small(by_title), "_t", "left")
    lost = F.raise_error(F.concat(F.lit("aliases of no entry: "), F.col("_t")))
    later = stated.select("alias", F.coalesce("_j", lost).alias("journal_id"), F.lit("source").alias("origin"), "_o", "_p")
    earlier = fixed.select("alias", "journal_id", F.lit("fixed").alias("origin"))
    rows = earlier.unionByName(later, allowMissingColumns=True).filter(F.col("alias").isNotNull()).withColumn("key", exact_key(F.col("alias")))
    best = rows.groupBy("key").agg(F.max_by(F.struct("alias", "journal_id", "origin"), F.struct(F.col("origin") == "source", "_o", "_p", "alias")).alias("b")).select("key", "b.*")
    if wanted is not None and best.count() != wanted:
        raise ValueError(f"not {wanted} aliases")
    return best


def match_sources(
    sources: DataFrame, catalog: DataFrame, *, aliases: DataFrame | None = None, order: list[str] = ORDER, index_order: list[str] | None = None
) -> DataFrame:
    """One audit row for each source row: (source_record_id, index_name, method, status, journal_id, candidates, reasons).

    Ways in their order: the first of its identifiers that an entry has; the exact title if one entry
    has it; a controlled alias; the conservative title. Several entries for that identifier, or for
    a conservative title, are ambiguous; several for an exact title fall through. A row bound to an
    entry gives it its identifiers, so that later rows are found by them; a row with an identifier
    of another entry than the one it is bound to is an identifier_conflict and gives nothing.

    What a row meets depends on the rows before it only through identifiers, and an identifier that
    no entry had gets one entry at most, from the first row that is bound with it: later ones with
    it are bound to that entry or not at all. So rounds of one join and two aggregates find all
    first rows: each round is right for one more link of every chain, and the last changes nothing.
    Ids must be unique and not null; an identifier that a third of all rows have is joined without a
    shuffle of its rows.
    """
    aliases = controlled_aliases(catalog) if aliases is None else aliases
    rows = sources.select(
        "source_record_id", "index_name", _place(order, index_order).alias("_o"), exact_key(F.col("formal_title")).alias("_e"), conservative_key(F.col("formal_title")).alias("_c"),
        F.array_distinct(F.filter(F.concat(F.coalesce("issn", _none()), F.coalesce("eissn", _none())), lambda x: x.isNotNull())).alias("_ids"),
    )

    def by_key(key_of) -> DataFrame:
        keyed = catalog.select(key_of(F.col("formal_title")).alias("key"), "journal_id")
        return keyed.groupBy("key").agg(F.count_distinct("journal_id").alias("n"), F.min("journal_id").alias("j"), F.array_sort(F.collect_set("journal_id")).alias("c"))

    exact = by_key(exact_key).select(F.col("key").alias("_e"), F.struct("n", "j").alias("e"))
    alias = aliases.select(F.col("key").alias("_e"), F.col("journal_id").alias("a"))
    rest = by_key(conservative_key).select(F.col("key").alias("_c"), F.struct("n", "j", "c").alias("k"))
    titled = rows.join(small(exact), "_e", "left").join(small(alias), "_e", "left").join(small(rest), "_c", "left")
    nothing = F.lit(None)
    way = (
        F.when(F.col("e.n") == 1, _way(METHODS[1], F.col("e.j"), _none()))
        .when(F.col("a").isNotNull(), _way(METHODS[2], F.col("a"), _none()))
        .when(F.col("k.n") == 1, _way(METHODS[3], F.col("k.j"), _none()))
        .when(F.col("k.n") > 1, _way("ambiguous", nothing, F.col("k.c")))
        .otherwise(_way("out_of_scope", nothing, _none()))
    )
    rows = materialize(titled.select("source_record_id", "index_name", "_o", "_ids", way.alias("_t")))

    owners = identifiers(catalog).groupBy("identifier").agg(F.array_sort(F.collect_set("journal_id")).alias("owners"))
    asked = rows.select("source_record_id", "_o", F.posexplode("_ids").alias("_p", "identifier"))
    tally = asked.groupBy("identifier").agg(F.count(F.lit(1)).alias("_n"))
    asked = materialize(join_by_counted_key(asked, materialize(tally.join(owners, "identifier", "left")), ["identifier"], "_n"))
    counted = materialize(asked.filter("owners is null").groupBy("identifier").agg(F.first("_n").alias("_n")))

    def decided(given: DataFrame | None) -> DataFrame:
        """All rows with their decision, given the first binding (identifier, first, to) of identifiers."""
        known = asked.filter("owners is not null").select("source_record_id", "_p", "identifier", "owners")
        if given is not None:
            own = join_by_counted_key(asked.filter("owners is null").drop("_n"), given, ["identifier"], "_n")
            known = known.unionByName(own.filter(F.col("first") < F.col("_o")).select("source_record_id", "_p", "identifier", F.array("to").alias("owners")))
        met = known.groupBy("source_record_id").agg(F.array_sort(F.collect_list(F.struct("_p", "identifier", "owners"))).alias("_met"))
        both = rows.join(met, "source_record_id", "left")
        first = F.get("_met", F.lit(0))["owners"]
        picked = F.when(F.col("_met").isNull(), F.col("_t")).when(F.size(first) == 1, _way(METHODS[0], first[0], _none())).otherwise(_way("identifier_conflict", nothing, first))
        both = both.withColumn("_d", picked)
        foreign = F.transform(F.filter("_met", lambda x: ~F.array_contains(x["owners"], F.col("_d.journal_id"))), lambda x: x["identifier"])
        both = both.withColumn("reasons", F.when(F.col("_d.journal_id").isNotNull() & F.col("_met").isNotNull(), foreign).otherwise(_none()))
        veto = F.size("reasons") > 0
        bound = F.when(~veto, F.col("_d.journal_id"))
        method = F.when(veto, F.lit("identifier_conflict")).otherwise(F.col("_d.method"))
        candidates = F.when(F.col("_d.journal_id").isNotNull(), F.array("_d.journal_id")).otherwise(F.col("_d.candidates"))
        return both.select("source_record_id", "index_name", "_o", "_ids", method.alias("method"), bound.alias("journal_id"), candidates.alias("candidates"), "reasons")

    given: DataFrame | None = None
    for _ in range(MOST_ROUNDS):
        bound = decided(given).filter("journal_id is not null").select("_o", "journal_id", F.explode("_ids").alias("identifier"))
        least = bound.groupBy("identifier").agg(F.min(F.struct("_o", "journal_id")).alias("m"))
        following = materialize(least.join(counted, "identifier").select("identifier", F.col("m._o").alias("first"), F.col("m.journal_id").alias("to"), "_n"))
        if given is None:
            stable = following.isEmpty()
        else:
            both = following.join(given.select("identifier", F.struct("first", "to").alias("_before")), "identifier", "full")
            stable = both.filter(~F.struct("first", "to").eqNullSafe(F.col("_before"))).isEmpty()
            release(given)
        given = following
        if stable:
            break
    else:
        raise RuntimeError(f"bindings not stable after {MOST_ROUNDS} rounds")
    found = decided(given)
    status = F.when(F.col("journal_id").isNotNull(), "matched").when(F.col("method") == "out_of_scope", "out_of_scope").otherwise("ambiguous")
    why = F.when((status == "ambiguous") & (F.size("reasons") == 0), F.array("method")).otherwise(F.col("reasons"))
    return found.select("source_record_id", "index_name", "method", status.alias("status"), "journal_id", "candidates", why.alias("reasons"))


def identifier_conflicts(audit: DataFrame) -> DataFrame:
    """Rows whose identifiers belong to another entry than the one that they would be bound to, or to
    several: (source_record_id, candidates, reasons)."""
    return audit.filter(F.col("method") == "identifier_conflict").select("source_record_id", "candidates", "reasons")


_MEMBERSHIP = ["index_name", "index_version", "source_title", "source_record_id", "source_file", "source_line", "subject_categories", "method"]


def memberships(audit: DataFrame, sources: DataFrame, catalog: DataFrame, *, order: list[str] = ORDER, index_order: list[str] | None = None) -> DataFrame:
    """One row for each membership that a matched row brings its entry: journal_id, what the row says of
    itself, the method, and new_index, whether it is the first to bring this index to an entry that
    did not have it. A row that repeats another brings nothing; no entry's rows come into one cell."""
    hit = audit.filter(F.col("status") == "matched").select("source_record_id", "journal_id", "method")
    rows = hit.join(sources, "source_record_id").withColumn("_o", _place(order, index_order)).select("journal_id", "_o", *_MEMBERSHIP).dropDuplicates(["journal_id", *_MEMBERSHIP])
    first = rows.groupBy("journal_id", "index_name").agg(F.min("_o").alias("_first"), F.count(F.lit(1)).alias("_n"))
    held = catalog.select("journal_id", F.coalesce("index_memberships", _none()).alias("_held"))
    first = materialize(first.join(held, "journal_id"))
    both = join_by_counted_key(rows, first, ["journal_id", "index_name"], "_n")
    new = (F.col("_o") == F.col("_first")) & ~F.array_contains("_held", F.col("index_name"))
    return both.select("journal_id", *_MEMBERSHIP, new.alias("new_index"), F.col("_o").alias("place"))


def _firsts(rows: DataFrame, keys: list[str], value: Column, name: str, order: Column) -> DataFrame:
    """Distinct values of each key as a list, in the order in which they first come."""
    each = rows.select(*keys, order.alias("_o"), F.posexplode(value).alias("_p", "_x")).filter(F.col("_x").isNotNull())
    one = each.groupBy(*keys, "_x").agg(F.min(F.struct("_o", "_p")).alias("_at"))
    return one.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda s: s["_x"]).alias(name))


def bind_memberships(audit: DataFrame, sources: DataFrame, catalog: DataFrame, *, order: list[str] = ORDER, index_order: list[str] | None = None) -> DataFrame:
    """Each entry that matched rows belong to, after binding: (journal_id, records, indexes, new_indexes,
    categories, source_catalogs, issn, eissn). Lists keep what the entry had and add what is new in
    the order in which rows bring it; categories is a map from each index to its own list."""
    rows = memberships(audit, sources, catalog, order=order, index_order=index_order)
    rows = materialize(rows.join(sources.select("source_record_id", "issn", "eissn"), "source_record_id"))
    o = F.col("place")
    counts = rows.groupBy("journal_id").agg(F.count(F.lit(1)).alias("records"))
    indexes = _firsts(rows, ["journal_id"], F.array("index_name"), "_indexes", o)
    categories = _firsts(rows, ["journal_id", "index_name"], F.coalesce("subject_categories", _none()), "_c", o)
    # an index without categories keeps an empty list
    every = rows.select("journal_id", "index_name").distinct().join(categories, ["journal_id", "index_name"], "left")
    maps = every.groupBy("journal_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("index_name", F.coalesce("_c", _none()).alias("_c"))))).alias("categories"))
    out = catalog.select("journal_id", *[F.coalesce(c, _none()).alias(f"_had_{c}") for c in ("index_memberships", "source_catalogs", "issn", "eissn")]).join(counts, "journal_id").join(indexes, "journal_id").join(maps, "journal_id")
    for c in ("issn", "eissn"):
        out = out.join(_firsts(rows, ["journal_id"], F.coalesce(c, _none()), f"_{c}", o), "journal_id", "left")

    def grown(had: str, new: str) -> Column:
        return F.array_distinct(F.concat(had, F.coalesce(new, _none())))

    return out.select(
        "journal_id",
        "records",
        grown("_had_index_memberships", "_indexes").alias("indexes"),
        F.array_except("_indexes", "_had_index_memberships").alias("new_indexes"),
        "categories",
        grown("_had_source_catalogs", "_indexes").alias("source_catalogs"),
        grown("_had_issn", "_issn").alias("issn"),
        grown("_had_eissn", "_eissn").alias("eissn"),
    )


def expected_gaps(catalog: DataFrame, audit: DataFrame, expected: DataFrame) -> DataFrame:
    """(journal_id, index_name) that rules (priority_level, index_name) expect and an entry has neither
    by itself nor by a row that was matched to it."""
    bound = audit.filter(F.col("status") == "matched").select("journal_id", "index_name")
    held = catalog.select("journal_id", F.explode("index_memberships").alias("index_name"))
    has = bound.unionByName(held).distinct()
    return catalog.select("journal_id", "priority_level").join(F.broadcast(expected), "priority_level").join(has, ["journal_id", "index_name"], "left_anti").select("journal_id", "index_name")


def full_audit(audit: DataFrame, gaps: DataFrame) -> DataFrame:
    """The audit of all rows, and one row for each membership that is expected and not there."""
    missing = gaps.select(
        F.concat_ws(":", F.lit("EXPECTED"), "index_name", "journal_id").alias("source_record_id"), "index_name", F.lit("expected_index_membership").alias("method"),
        F.lit("expected_but_unmatched").alias("status"), "journal_id", F.array("journal_id").alias("candidates"), F.array("index_name").alias("reasons"),
    )
    return audit.unionByName(missing)


def match_counts(audit: DataFrame) -> DataFrame:
    """Rows of each source by status."""

    def of(s: str) -> object:
        return F.count_if(F.col("status") == s)

    return audit.groupBy("index_name").agg(
        F.count(F.lit(1)).alias("total"), of("matched").alias("matched"), of("out_of_scope").alias("out_of_scope"), of("ambiguous").alias("ambiguous")
    )


def pairwise_intersections(audit: DataFrame) -> DataFrame:
    """(left_index, right_index, journals): entries that both indexes have, pairs without any too."""
    own = audit.filter(F.col("status") == "matched").select("index_name", "journal_id").distinct()
    # all pairs of the names of indexes, from one sorted set
    names = audit.agg(F.array_sort(F.collect_set("index_name")).alias("s")).select("s", F.posexplode("s").alias("_i", "left_index"))
    pairs = names.select("left_index", F.explode(F.expr("slice(s, _i + 2, size(s))")).alias("right_index"))
    # an entry has few indexes: its pairs come from one small set, not from joining rows with rows
    sets = own.groupBy("journal_id").agg(F.array_sort(F.collect_set("index_name")).alias("s"))
    both = sets.select(F.explode("s").alias("left_index"), "s").select("left_index", F.explode("s").alias("right_index")).filter("left_index < right_index")
    counted = both.groupBy("left_index", "right_index").agg(F.count(F.lit(1)).alias("journals"))
    return pairs.join(counted, ["left_index", "right_index"], "left").na.fill(0, ["journals"])
