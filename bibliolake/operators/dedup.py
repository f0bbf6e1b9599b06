"""Duplicate records by title key and shared authors: components, best record, merged metadata."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bibliolake.common import join_by_counted_key, materialize
from bibliolake.functions.clean import completeness, declared_first
from bibliolake.functions.keys import people_keys, work_key
from bibliolake.plans.expressions import TOPIC_FIELDS

#: Rounds of label spreading before giving up, and the largest group (in records' shared people) that
#: one task links by itself.
MOST_ROUNDS, MOST_LOCAL = 60, 100_000


def _linked_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find group by group over rows (g, r, a) that come sorted by g; one group is held at a time."""
    current, parent, first = None, {}, {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def done() -> pd.DataFrame:
        records = list(parent)
        return pd.DataFrame({"g": [current] * len(records), "r": records, "label": [find(x) for x in records]})

    for batch in batches:
        out = []
        for g, r, a in zip(batch["g"], batch["r"], batch["a"]):
            if g != current:
                if parent:
                    out.append(done())
                current, parent, first = g, {}, {}
            parent.setdefault(r, r)
            x, y = find(r), find(first.setdefault(a, r))
            if x != y:
                parent[max(x, y)] = min(x, y)  # a root is the smallest of its component
        if out:
            yield pd.concat(out)
    if parent:
        yield done()


def _spread_labels(edges: DataFrame) -> DataFrame:
    """(g, r, label): labels spread from records to (group, person) pairs and back, and jump along
    labels, until none changes. Each round is written out, which cuts the lineage."""
    labels = materialize(edges.select("g", "r", F.col("r").alias("label")).distinct())
    for _ in range(MOST_ROUNDS):
        by_person = edges.join(labels, ["g", "r"]).groupBy("g", "a").agg(F.min("label").alias("least"))
        spread = edges.join(by_person, ["g", "a"]).groupBy("g", "r").agg(F.min("least").alias("label"))
        jump = spread.select("g", F.col("r").alias("label"), F.col("label").alias("further"))
        following = materialize(spread.join(jump, ["g", "label"], "left").select("g", "r", F.least("label", F.coalesce("further", "label")).alias("label")))
        changed = following.join(labels.withColumnRenamed("label", "old"), ["g", "r"]).filter("label <> old").limit(1).count()
        labels = following
        if not changed:
            return labels
    raise RuntimeError(f"components not stable after {MOST_ROUNDS} rounds")


def author_components(records: DataFrame, group: str, key: str, people: str, keep: list[str] | None = None) -> DataFrame:
    """(group, key, component, then keep): records of a group that share a person, directly or through others,
    are one component, named by its smallest key; a record without people has a null component.

    A record meets a person, never another record, so a person of many records costs their number
    and not their pairs; people of one record link nothing and are left out first. Groups of at most
    MOST_LOCAL such rows are linked whole, each in one task; larger ones by spreading labels.
    """
    base = records.select(F.col(group).alias("g"), F.col(key).alias("r"), F.array_distinct(F.col(people)).alias("p"), *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep or [])])
    each = base.select("g", "r", F.explode("p").alias("a"))
    shared = each.groupBy("g", "a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g", "a")
    edges = materialize(each.join(shared, ["g", "a"], "left_semi"))
    sizes = edges.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    large = materialize(sizes.filter(F.col("n") > MOST_LOCAL).select("g"))
    few = edges.join(large, "g", "left_anti")
    schema = T.StructType([edges.schema["g"], edges.schema["r"], T.StructField("label", edges.schema["r"].dataType)])
    labels = few.repartition("g").sortWithinPartitions("g").mapInPandas(_linked_groups, schema)
    if not large.isEmpty():
        labels = labels.unionByName(_spread_labels(materialize(edges.join(large, "g", "left_semi"))))
    alone = F.when(F.size("p") > 0, F.col("r"))
    return base.join(labels, ["g", "r"], "left").select(F.col("g").alias(group), F.col("r").alias(key), F.coalesce("label", alone).alias("component"), *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep or [])])


def merge_records(papers: DataFrame, *, as_of_year: int, with_journal: bool = False, order: str = "paper_id") -> DataFrame:
    """One row for each work: the best record of each component with the metadata of all.

    Works are told apart by title and year (and journal, in the stricter variant), then by authors.
    Records without authors join a group's only component, after its other records; with several
    components they are a work of their own. The first of the most complete records is best; topic
    fields and search groups are united in the order of arrival, declared fields first.
    """
    parts = [work_key(F.coalesce("title", F.lit("")))]
    if with_journal:
        parts.append(work_key(F.coalesce("journal_raw", F.lit(""))))
    parts.append(F.coalesce(F.col("publication_year").cast("string"), F.lit("")))
    none = F.array().cast("array<string>")
    rows = papers.select(
        F.col(order).alias("ord"),
        F.xxhash64(*parts).alias("_h"),
        F.concat_ws("\x1f", *parts).alias("work"),
        people_keys(F.col("authors")).alias("people"),
        completeness(*[F.col(c) for c in ("title", "journal_raw", "publication_year", "authors", "publication_date", "citations", "downloads")], as_of_year).alias("score"),
        F.nullif("topic_match_field", F.lit("")).alias("topic"),
        F.coalesce("matched_topic_fields", none).alias("fields"),
        F.coalesce("matched_search_groups", none).alias("groups"),
    )
    rows = materialize(rows.withColumn("work", F.sha2("work", 256)).drop("_h"))
    comps = materialize(author_components(rows, "work", "ord", "people", ["score", "topic", "fields", "groups"]))
    # only records without people ask for their work's components, of which the least and greatest tell if there is one
    told = comps.filter(F.col("component").isNotNull()).withColumn("unit", F.col("component").cast("long")).withColumn("late", F.lit(0))
    asking = comps.filter(F.col("component").isNull())
    works = materialize(asking.groupBy("work").agg(F.count(F.lit(1)).alias("_n")))
    spread = comps.join(works.select("work"), "work", "left_semi").groupBy("work").agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
    known = materialize(works.join(spread, "work"))
    only = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.lit(-1)).cast("long")
    late = join_by_counted_key(asking, known, ["work"], "_n").withColumn("unit", F.coalesce(only, F.lit(-1))).withColumn("late", F.lit(1))
    placed = told.unionByName(late.select(*told.columns))
    arrival = F.struct("late", "ord")

    def cells(c: str) -> Column:
        return F.transform(F.col(c), lambda x, i: F.struct(F.lit(c).alias("c"), x.alias("x"), i.alias("i")))

    each = placed.select("work", "unit", "late", "ord", F.explode(F.concat(cells("fields"), cells("groups"))).alias("e")).filter("e.x <> ''")
    first = each.groupBy("work", "unit", "e.c", "e.x").agg(F.min(F.struct("late", "ord", "e.i")).alias("_first"))

    def united(c: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("c") == c, F.struct("_first", "x")))), lambda s: s["x"]).alias(c)

    lists = first.groupBy("work", "unit").agg(united("fields"), united("groups"))
    best = placed.groupBy("work", "unit").agg(
        F.max_by("ord", F.struct("score", -F.col("late"), -F.col("ord"))).alias("best"),
        F.max("score").alias("score"),
        F.count(F.lit(1)).alias("records"),
        F.min_by("topic", F.when(F.col("topic").isNotNull(), arrival)).alias("topic_match_field"),
    )
    out = best.join(lists, ["work", "unit"], "left")
    return out.select(
        F.col("best").alias(order),
        "records",
        "score",
        "topic_match_field",
        F.coalesce(declared_first(F.col("fields"), TOPIC_FIELDS), none).alias("matched_topic_fields"),
        F.coalesce("groups", none).alias("matched_search_groups"),
    )


def joined(c: Column) -> Column:
    return F.array_join(c, "|")
