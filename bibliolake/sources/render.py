"""Text forms of a catalog and of an audit: tables by level, statistics, summaries, hashes."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bibliolake.functions.clean import table_cell
from bibliolake.operators.matching import match_counts

COLUMNS = ["ordinal", "formal_title", "journal_id", "issn", "eissn", "subjects", "memberships"]


def catalog_rows(catalog: DataFrame) -> DataFrame:
    """(priority_level, ordinal, line): a table line for each entry, numbered within its level by id."""
    none = F.array().cast("array<string>")
    n = F.row_number().over(W.partitionBy("priority_level").orderBy("journal_id"))
    lists = {"issn": "issn", "eissn": "eissn", "subjects": "subject_categories", "memberships": "index_memberships"}
    cells = catalog.select(
        "priority_level",
        n.alias("ordinal"),
        "journal_id",
        table_cell(F.col("formal_title")).alias("formal_title"),
        *[table_cell(F.array_join(F.coalesce(F.col(c), none), "<br>")).alias(name) for name, c in lists.items()],
    )
    return cells.select("priority_level", "ordinal", F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in COLUMNS]), F.lit(" |")).alias("line"))


def catalog_text(catalog: DataFrame, version: str) -> str:
    """The whole catalog as one text with a table for each level and a hash of its content. A catalog
    is a list kept by people: rows are streamed to the driver, one at a time."""
    parts = [f"# Catalog {version}", ""]
    level = None
    for row in catalog_rows(catalog).orderBy("priority_level", "ordinal").toLocalIterator():
        if row.priority_level != level:
            level = row.priority_level
            parts += ["", f"## Level {level}", "", "| " + " | ".join(COLUMNS) + " |", "|" + " --- |" * len(COLUMNS)]
        parts.append(row.line)
    body = "\n".join(parts) + "\n"
    return body + f"\n<!-- sha256 {hashlib.sha256(body.encode()).hexdigest()} -->\n"


def audit_summary(audit: DataFrame) -> str:
    """Counts of an audit by source and status."""
    counts = sorted(match_counts(audit).collect(), key=lambda r: r.index_name)
    lines = ["| source | total | matched | out of scope | ambiguous |", "| --- | --- | --- | --- | --- |"]
    lines += [f"| {r.index_name} | {r.total} | {r.matched} | {r.out_of_scope} | {r.ambiguous} |" for r in counts]
    return "\n".join(lines) + "\n"
