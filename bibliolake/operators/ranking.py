"""Annotation of records with catalog priority, stable order, eligibility, page caps, three-way split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bibliolake.common import join_by_counted_key, materialize
from bibliolake.functions.clean import verifiable_year
from bibliolake.functions.text import strip
from bibliolake.operators.catalog import lookup_general, small
from bibliolake.plans.expressions import TOPIC_FIELDS

LAST = 999


_OF_JOURNAL = ["journal_matched_title", "journal_match_status", "journal_match_method", "priority_level", "priority_group", "ncs_internal_rank"]


def journal_entries(papers: DataFrame, index: DataFrame) -> DataFrame:
    """One row for each distinct writing of a journal with its catalog entry and its number of papers
    (_rows), so that the catalog join does not grow with the number of papers."""
    index = materialize(index)  # it is read several times
    names = materialize(papers.filter(F.col("journal_raw").isNotNull()).groupBy("journal_raw").agg(F.count(F.lit(1)).alias("_rows")))
    found = lookup_general(names, "journal_raw", "journal_raw", index).join(names, "journal_raw")
    found = found.join(small(index.select("matched_title", "ncs_internal_rank")), "matched_title", "left").select(
        "journal_raw",
        F.col("matched_title").alias("journal_matched_title"),
        F.col("status").alias("journal_match_status"),
        F.col("match_method").alias("journal_match_method"),
        "priority_level",
        "priority_group",
        "ncs_internal_rank",
        "_rows",
    )
    return materialize(found)


def annotate(papers: DataFrame, index: DataFrame) -> DataFrame:
    """papers with the catalog entry that their journal means."""
    rows = papers.drop(*_OF_JOURNAL)
    known = join_by_counted_key(rows.filter(F.col("journal_raw").isNotNull()), journal_entries(rows, index), ["journal_raw"], "_rows").drop("_rows")
    return known.unionByName(rows.filter(F.col("journal_raw").isNull()), allowMissingColumns=True)


def _or_last(c: str) -> Column:
    """Null and 0 go last alike."""
    return F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(LAST))


def rank_order(ordinal: str = "paper_id") -> list[Column]:
    """Level (unmatched last), internal rank, topic field, result rank, then arrival: a total order."""
    field = F.lit(LAST)
    for n, name in reversed(list(enumerate(TOPIC_FIELDS, start=1))):
        field = F.when(F.col("topic_match_field") == name, F.lit(n)).otherwise(field)
    return [F.col("priority_level").isNull(), _or_last("priority_level"), _or_last("ncs_internal_rank"), field, F.coalesce("result_rank", F.lit(0)), F.col(ordinal)]


def top_ranked(annotated: DataFrame, k: int) -> DataFrame:
    return annotated.orderBy(*rank_order()).limit(k)


def top_papers(papers: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """The first k of the annotated papers in rank order. A paper's place is decided by its journal
    first, so journals are ranked and their papers counted until k are reached; only papers of the
    journals up to there are annotated and ordered."""
    rows = papers.drop(*_OF_JOURNAL)
    entries = journal_entries(rows, index).withColumn("_place", F.struct(*[c.alias(f"p{i}") for i, c in enumerate(rank_order()[:3])]))
    # every place has a paper, so k places are enough
    places = entries.groupBy("_place").agg(F.sum("_rows").alias("n")).orderBy("_place").limit(k).collect()
    reached, last = 0, None
    for place, n in places:
        last, reached = place, reached + n
        if reached >= k:
            break
    unplaced = last is None or last[0] or reached < k  # journals without an entry, and papers without a journal, are needed
    if not unplaced:
        entries = entries.filter(F.col("_place") <= F.struct(F.lit(last[0]), F.lit(last[1]), F.lit(last[2])))
    entries = entries.drop("_place")
    found = join_by_counted_key(rows.filter(F.col("journal_raw").isNotNull()), entries, ["journal_raw"], "_rows").drop("_rows")
    if unplaced:
        found = found.unionByName(rows.filter(F.col("journal_raw").isNull()), allowMissingColumns=True)
    return top_ranked(found, k)


def split_eligible(annotated: DataFrame, titles: DataFrame, *, facet_applied: bool | None = None) -> DataFrame:
    """annotated with eligible: the matched title is in titles (matched_title), or the facet was
    confirmed for all where the rule is a facet."""
    if facet_applied is not None:
        return annotated.withColumn("eligible", F.lit(facet_applied))
    listed = titles.select(F.col("matched_title").alias("journal_matched_title")).distinct().withColumn("_hit", F.lit(True))
    return annotated.join(listed, "journal_matched_title", "left").withColumn("eligible", F.coalesce("_hit", F.lit(False))).drop("_hit")


def split_by_scope(records: DataFrame, scope: DataFrame, levels: list[int], membership: str | None, facet_applied: bool = True) -> DataFrame:
    """records (journal_id, priority_level, index_memberships) with eligible: id in the scope, level
    and membership allowed, facet confirmed. A null id, level or membership is not eligible."""
    ids = scope.select("journal_id").distinct().withColumn("_hit", F.lit(True))
    member = F.lit(True) if membership is None else F.coalesce(F.array_contains("index_memberships", membership), F.lit(False))
    hit = F.coalesce("_hit", F.lit(False)) & F.coalesce(F.col("priority_level").isin(levels), F.lit(False)) & member & F.lit(facet_applied)
    return records.join(ids, "journal_id", "left").withColumn("eligible", hit).drop("_hit")


def bucket_rows(rows: DataFrame, *, kind: str, title: str, journal: str, year: str, wanted: str, as_of_year: int) -> DataFrame:
    """rows with bucket: excluded (another document type), incomplete, or complete."""
    full = (F.coalesce(strip(F.col(title)), F.lit("")) != "") & (F.coalesce(strip(F.col(journal)), F.lit("")) != "") & verifiable_year(F.col(year), as_of_year)
    bucket = F.when(~F.col(kind).eqNullSafe(wanted), "excluded").when(full, "complete").otherwise("incomplete")
    return rows.withColumn("bucket", bucket)


def cap_page(rows: DataFrame, page: list[str], order: list[str], limit: int) -> DataFrame:
    """At most limit complete rows of each page, in order; incomplete rows stay, excluded ones go."""
    nth = F.row_number().over(W.partitionBy(*page, "bucket").orderBy(*order))
    return rows.withColumn("_n", nth).filter((F.col("bucket") == "incomplete") | ((F.col("bucket") == "complete") & (F.col("_n") <= limit))).drop("_n")
