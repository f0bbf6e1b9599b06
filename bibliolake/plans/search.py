"""Searches as batch jobs over page snapshots: policies, plans, parse, merge, annotate, cut."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bibliolake.common import materialize
from bibliolake.operators import catalog, control, dedup, ranking
from bibliolake.plans import expressions
from bibliolake.sources import pages

MOST_PER_REQUEST = 50


@dataclass(frozen=True)
class Policy:
    """How a group is searched: by a list of titles, or by a facet of the site."""

    group: str
    facet: str | None = None
    levels: list[int] = field(default_factory=list)
    membership: str | None = None


def check_limit(limit: int, most: int = MOST_PER_REQUEST) -> int:
    if isinstance(limit, bool) or not 1 <= limit <= most:
        raise ValueError(f"limit must be 1 to {most}")
    return limit


def group_plans(index: DataFrame, policy: Policy, topic: str) -> DataFrame:
    """The plans of a group: one by its facet, or batches of its titles; nothing is run."""
    if policy.facet:
        spark = index.sparkSession
        one = spark.range(1).select(F.lit(1).alias("index"), F.lit(1).alias("total"), F.array().cast("array<string>").alias("journals"))
        return one.select("*", expressions.topic_expression(F.lit(topic)).alias("expression"), F.lit(expressions.PAGE_SIZE).alias("page_size"), F.lit(expressions.TOPIC_FIELDS[0]).alias("topic_field"))
    own = catalog.journals_by_group(index, policy.group).select(F.lit(policy.group).alias("group"), "matched_title")
    return expressions.batches(own, ["group"], "matched_title", ["matched_title"], topic).drop("group")


def public_search(snapshots: DataFrame, index: DataFrame, *, limit: int, as_of_year: int) -> DataFrame:
    """Records of result pages (page_id, html): parsed, split, capped by page, annotated, in rank order."""
    check_limit(limit)
    rows = pages.parse_pages(snapshots, "page_id", "html").filter(F.col("pos").isNotNull())
    split = ranking.bucket_rows(rows, kind="document_type", title="title", journal="journal_raw", year="publication_year", wanted=pages.WANTED, as_of_year=as_of_year)
    capped = ranking.cap_page(split, ["page_id"], ["pos"], limit).withColumn("paper_id", F.xxhash64("page_id", "pos"))
    known = capped.withColumn("topic_match_field", F.lit(None).cast("string"))
    return ranking.annotate(known, index).orderBy("page_id", *ranking.rank_order("pos"))


#: A request is tried so often, the second time only after a network error; what a cache may hold.
MOST_ATTEMPTS, STORABLE = 2, ["success", "partial", "no_results"]


def served_requests(requests: DataFrame, attempts: DataFrame, *, as_of_year: int) -> DataFrame:
    """What a public search gives for each request (request_id, query, row_limit, requested_at) of a log,
    by its attempts (request_id, attempt, state, html; see control.page_state):
    (request_id, status, from_cache, complete, incomplete, excluded).

    A network error is tried once more. Another state than success ends with itself and no rows; a page
    of another format is page_contract_changed. A page's complete rows are cut at row_limit; it is
    partial with incomplete ones, else a success, or no_results without any. Only successes, partial and
    empty results are stored, for a day, by query and limit; a request that the cache answers has the
    status of the one that stored it. A limit out of range, or a request without attempts that the
    cache does not answer, is configuration_error.
    """
    tried = attempts.filter(F.col("attempt") <= MOST_ATTEMPTS).withColumn("_again", (F.col("state") == "network_error") & (F.col("attempt") < MOST_ATTEMPTS))
    last = tried.groupBy("request_id").agg(F.min_by(F.struct("state", "html"), F.struct(F.col("_again").cast("int"), "attempt")).alias("a")).select("request_id", "a.state", "a.html")
    parsed = pages.parse_pages(last.filter("state = 'success'"), "request_id", "html").withColumnRenamed("state", "page")
    split = ranking.bucket_rows(parsed, kind="document_type", title="title", journal="journal_raw", year="publication_year", wanted=pages.WANTED, as_of_year=as_of_year)
    there = F.col("pos").isNotNull()
    counts = split.groupBy("request_id").agg(F.first("page").alias("page"), *[F.count_if(there & (F.col("bucket") == b)).alias(b) for b in ("complete", "incomplete", "excluded")])
    asked = requests.select("request_id", "query", "row_limit", "requested_at").join(last.select("request_id", "state"), "request_id", "left").join(counts, "request_id", "left")
    asked = asked.na.fill(0, ["complete", "incomplete", "excluded"]).withColumn("complete", F.least("complete", F.greatest("row_limit", F.lit(0)).cast("long")))
    fine = F.coalesce(F.col("row_limit").between(1, MOST_PER_REQUEST), F.lit(False))
    asked = asked.withColumns({c: F.when(fine, F.col(c)).otherwise(F.lit(0)) for c in ("complete", "incomplete", "excluded")})
    read = F.when(F.col("page").isin("heading_without_table", "table_without_rows"), "page_contract_changed").when(F.col("incomplete") > 0, "partial").when(F.col("complete") > 0, "success").otherwise("no_results")
    status = F.when(~fine | F.col("state").isNull(), "configuration_error").when(F.col("state") == "success", read).otherwise(F.col("state"))
    known = asked.withColumn("status", status).withColumn("key", control.cache_key(F.col("query"))).withColumn("may", F.col("status").isin(STORABLE) & F.col("key").isNotNull())
    known = materialize(known)
    cached = control.cache_hits(known.filter(fine), ["key", "row_limit"], "request_id", "requested_at", storable="may").withColumnRenamed("ident", "request_id")
    both = known.join(cached, "request_id", "left").withColumn("from_cache", F.coalesce("hit", F.lit(False)))
    # a hit has what the last request of its key brought that was not one
    w = W.partitionBy("key", "row_limit").orderBy("requested_at", "request_id").rowsBetween(W.unboundedPreceding, 0)
    own = F.when(~F.col("from_cache"), F.struct("status", "complete", "incomplete", "excluded"))
    return both.withColumn("_r", F.last(own, ignorenulls=True).over(w)).select("request_id", "_r.status", "from_cache", "_r.complete", "_r.incomplete", "_r.excluded")


def expression_outcome(results: DataFrame, *, stopped: str | None = None) -> str:
    """The status of a user's expression from the rows of its one batch (bucket), and the state that
    stopped it, if one did."""
    n = {r.bucket: r.n for r in results.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    if stopped:
        return "partial" if n.get("complete") else stopped
    if not n.get("complete"):
        return "no_results"
    return "partial" if n.get("incomplete") else "success"


def group_search(records: DataFrame, index: DataFrame, policy: Policy, *, limit: int, as_of_year: int) -> DataFrame:
    """The best limit records of a search's arrivals (papers with paper_id in the order of arrival):
    merged into works, annotated, restricted to the group, in rank order."""
    works = dedup.merge_records(records, as_of_year=as_of_year)
    best = works.select("paper_id", "topic_match_field").join(records.drop("topic_match_field"), "paper_id")
    annotated = ranking.annotate(best, index)
    kept = ranking.split_eligible(annotated, catalog.journals_by_group(index, policy.group), facet_applied=True if policy.facet else None)
    return kept.filter("eligible").drop("eligible").orderBy(*ranking.rank_order()).limit(limit)


def save_checkpoint(results: DataFrame, path: str, token: str) -> None:
    """The results (batch, ...) of finished batches under a plan's token."""
    results.withColumn("token", F.lit(token)).write.mode("overwrite").partitionBy("token").parquet(path)


def load_checkpoint(spark: SparkSession, path: str, token: str, valid) -> DataFrame:
    """What was saved under the same token, without any batch that has an invalid row."""
    own = spark.read.parquet(path).filter(F.col("token") == token).drop("token")
    return control.keep_whole_batches(own, ["batch"], valid)


def remaining(plans: DataFrame, done: DataFrame) -> DataFrame:
    """The plans whose batch is not done yet."""
    return plans.join(done.select(F.col("batch").alias("index")).distinct(), "index", "left_anti")
