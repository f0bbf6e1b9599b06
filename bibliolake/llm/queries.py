"""Queries of the operators of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibliolake.common import table
from bibliolake.llm import abuse, copies, encode, fusion, linkage, mixing, reflist, topn, unify


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    channel = F.concat_ws("|", F.coalesce("topic_match_field", F.lit("-")), F.coalesce("journal_match_status", F.lit("-")), F.col("manual_review_required").cast("string"))
    return fusion.fuse(
        fusion.claims_of(
            table(spark, sf_dir, "merge_groups"),
            table(spark, sf_dir, "papers"),
            group="group_id",
            key="paper_id",
            counts=["citations", "downloads"],
            lists=["matched_topic_fields", "matched_search_groups"],
            seen="retrieved_at",
            doubtful="manual_review_required",
            source=channel,
        )
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of each group and field, where one record alone is latest, sure and complete."""
    found = _fused(spark, sf_dir).filter(F.col("is_full") & (F.col("full_records") == 1))
    return found.select(F.col("g").alias("group_id"), "field", F.col("record").alias("paper_id"))


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record built for each group, one column a field, with its least sure posterior."""
    fields = ["citations", "downloads", "matched_topic_fields", "matched_search_groups"]
    one = _fused(spark, sf_dir).groupBy(F.col("g").alias("group_id"))
    picks = [F.max(F.when(F.col("field") == f, F.translate("value", "\x1f", ","))).alias(f) for f in fields]
    return one.agg(*picks, F.round(F.min("posterior"), 6).alias("least_posterior"))


def p2_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changed values beside their consistent form."""
    parts = [
        unify.changed_values(table(spark, sf_dir, "papers"), "paper_id", {"title": "papers.title", "journal_raw": "papers.journal_raw"}),
        unify.changed_values(table(spark, sf_dir, "journals"), "journal_id", {"formal_title": "journals.formal_title"}),
        unify.changed_values(table(spark, sf_dir, "search_requests"), "request_id", {"query": "search_requests.query"}),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with a character that is not the ordinary one for what is seen."""
    return p2_unified(spark, sf_dir).select("field", "row_key")


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "papers").filter(~F.coalesce(F.col("journal_match_status") == "matched", F.lit(False)))
    return reflist.map_to_list(papers, "paper_id", "journal_raw", table(spark, sf_dir, "journals"), "journal_id", "formal_title", "aliases")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal that each unmatched paper's free-typed journal means, or none."""
    return _mapped(spark, sf_dir).select("paper_id", F.col("entry").alias("journal_id"))


def p4_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values without an entry and how often each was typed."""
    return _mapped(spark, sf_dir).filter(F.col("entry") == reflist.NONE).groupBy("journal_raw").agg(F.count(F.lit(1)).alias("papers"))


def p4_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries within the distance of each value that was typed freely, with the edits to each."""
    papers = table(spark, sf_dir, "papers").filter(~F.coalesce(F.col("journal_match_status") == "matched", F.lit(False)))
    return reflist.near_entries(papers, "journal_raw", table(spark, sf_dir, "journals"), "journal_id", "formal_title", "aliases")


def p4_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that mean several entries alike, and so none, with these entries."""
    ties = _mapped(spark, sf_dir).filter(F.size("candidates") > 1)
    return ties.groupBy("journal_raw", F.array_join("candidates", "|").alias("journal_ids")).agg(F.count(F.lit(1)).alias("papers"))


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of one journal from different indexes with their confidence."""
    fields = {f: f for f in ("title", "formal_title", "aliases", "issn", "eissn", "publisher")} | {"title": "source_title"}
    return linkage.link_records(table(spark, sf_dir, "source_records"), key="source_record_id", source="index_name", **fields)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of one journal from different indexes."""
    return p5_links(spark, sf_dir).select(F.col("left").alias("left_record_id"), F.col("right").alias("right_record_id"))


P6_TEXTS, P6_NAMES = ["title", "journal_raw", "publication_date"], ["authors"]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers that repeat another in a different writing, each with the smallest paper_id of its group."""
    found = copies.group_copies(table(spark, sf_dir, "papers"), "paper_id", P6_TEXTS, P6_NAMES)
    return found.select(F.col("first").alias("first_paper_id"), F.col("copy").alias("copy_paper_id"))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of each group of copies with the number of its copies."""
    found = copies.count_copies(table(spark, sf_dir, "papers"), "paper_id", P6_TEXTS, P6_NAMES)
    return found.select(F.col("first").alias("first_paper_id"), "copies")


def _last_if_missing(column: str) -> Column:
    """0 and null go after all other values."""
    return F.coalesce(F.nullif(F.col(column), F.lit(0)), F.lit(2**30)).cast("long")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best papers of each search query."""
    level, rank = _last_if_missing("priority_level"), _last_if_missing("result_rank")
    # ranks are 32 bits with a sign, counted from the least one
    score = F.shiftleft(level, 32).bitwiseOR(rank + F.lit(2**31).cast("long"))
    # levels outside 0 .. 62 share a bucket on their side, the missing ones between them have their own ranks
    step = F.when(level < 63, F.greatest(level, F.lit(-1))).when(level < 2**30, F.lit(63)).when(level == 2**30, F.lit(64)).otherwise(F.lit(65))
    bucket = step * 1024 + F.when(step.isin(-1, 63, 65), F.lit(0)).otherwise(F.greatest(F.least(rank, F.lit(1023)), F.lit(0)))
    papers = table(spark, sf_dir, "papers")
    return topn.top_n(papers, "search_query", score, ["paper_id"], 10, ["paper_id"], bucket=bucket).select("search_query", "paper_id")


P1_SQL = """
WITH c AS (
  SELECT DISTINCT g.group_id, p.paper_id, p.retrieved_at AS seen, p.manual_review_required AS doubt, f.field, f.value, f.entries
  FROM (SELECT DISTINCT group_id, paper_id FROM merge_groups WHERE group_id IS NOT NULL) g
  JOIN (SELECT *,
    list_sort(list_distinct(list_filter(list_transform(matched_topic_fields, lambda x: trim(x)), lambda x: x <> ''))) AS tf,
    list_sort(list_distinct(list_filter(list_transform(matched_search_groups, lambda x: trim(x)), lambda x: x <> ''))) AS sg
    FROM papers) p USING (paper_id),
  LATERAL (VALUES
    ('citations', CASE WHEN p.citations >= 0 THEN CAST(p.citations AS VARCHAR) END, CAST(NULL AS VARCHAR[])),
    ('downloads', CASE WHEN p.downloads >= 0 THEN CAST(p.downloads AS VARCHAR) END, CAST(NULL AS VARCHAR[])),
    ('matched_topic_fields', CASE WHEN len(p.tf) > 0 THEN array_to_string(p.tf, '|') END, p.tf),
    ('matched_search_groups', CASE WHEN len(p.sg) > 0 THEN array_to_string(p.sg, '|') END, p.sg)) AS f(field, value, entries)
  WHERE f.value IS NOT NULL),
w AS (SELECT group_id, field, max(seen) AS seen, bool_or(NOT doubt) AS sure FROM c GROUP BY ALL),
u AS (SELECT group_id, field, count(DISTINCT e) AS n FROM (SELECT group_id, field, unnest(entries) AS e FROM c WHERE entries IS NOT NULL) GROUP BY ALL),
full_ones AS (
  SELECT c.group_id, c.field, c.paper_id, count(*) OVER (PARTITION BY c.group_id, c.field) AS n
  FROM c JOIN w USING (group_id, field) LEFT JOIN u USING (group_id, field)
  WHERE c.seen = w.seen AND (NOT c.doubt OR NOT w.sure) AND (c.entries IS NULL OR len(c.entries) = u.n))
SELECT group_id, field, paper_id FROM full_ones WHERE n = 1
"""

P7_SQL = """
SELECT search_query, paper_id FROM (
  SELECT search_query, paper_id, row_number() OVER (PARTITION BY search_query ORDER BY
    coalesce(nullif(priority_level, 0), 1073741824), coalesce(nullif(result_rank, 0), 1073741824), paper_id) AS n
  FROM papers WHERE search_query IS NOT NULL) WHERE n <= 10
"""

def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return encode.encode_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of each language decode to what they were, and their numbers of ids."""
    docs = table(spark, sf_dir, "documents").select("lang", "text", encode.encoder(spark)("text").alias("ids"))
    back = docs.withColumn("same", (encode.decoder(spark)("ids") == F.coalesce("text", F.lit(""))).cast("int"))
    return back.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("same").alias("same"), F.sum(F.size("ids")).alias("ids"))


def _mixed(spark: SparkSession, sf_dir: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", encode.counter(spark)("text").alias("tokens"))
    # a text that is there and not empty has a token
    content = docs.filter(F.length("text") > 0) if keep else None
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.mix(sized, targets, key="doc_id", source="source", size="tokens", weight="target_weight", cap="max_repeats", content=content, keep=keep)


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of sources, one row for each copy of a document, globally shuffled."""
    return _mixed(spark, sf_dir, ["text"])[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's target and actual share of the mixture."""
    return _mixed(spark, sf_dir, [])[1]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels")
    return abuse.score_documents(docs, labels, key="doc_id", text="text", label="abusive", keep=["source"])


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that themselves contain abusive, hateful or sexually explicit language."""
    return _scored(spark, sf_dir).filter(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document."""
    return _scored(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of abusive documents of each source."""
    bad = (F.col("score") >= abuse.THRESHOLD).cast("int")
    return _scored(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(bad).alias("abusive"), F.avg(bad).alias("rate"))


QUERIES = {
    "p1_found": p1_found,
    "p1_records": p1_records,
    "p2_found": p2_found,
    "p2_unified": p2_unified,
    "p4_found": p4_found,
    "p4_unmatched": p4_unmatched,
    "p4_near": p4_near,
    "p4_ties": p4_ties,
    "p5_found": p5_found,
    "p5_links": p5_links,
    "p6_found": p6_found,
    "p6_counts": p6_counts,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p8_round_trip": p8_round_trip,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
}

ORACLE = {"p1_found": P1_SQL, "p7_found": P7_SQL}
