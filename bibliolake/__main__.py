"""Command line: `validate CATALOG.json` and `lookup CATALOG.json TITLE...`, JSON out, short errors."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="bibliolake")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("validate", "lookup"):
        command = commands.add_parser(name)
        command.add_argument("catalog")
        if name == "lookup":
            command.add_argument("titles", nargs="+")
    asked = parser.parse_args(args)
    from bibliolake.operators import catalog, checks
    from bibliolake.registry import ship
    from bibliolake.sources.files import read_catalog_json

    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    try:
        journals = read_catalog_json(spark, asked.catalog)
        if asked.command == "validate":
            found = {r.check: r.failures for r in checks.catalog_checks(journals, list(range(1, 13))).collect()}
            print(json.dumps({"valid": not any(found.values()), "journals": journals.count(), "failures": found}))
            return int(any(found.values()))
        queries = spark.createDataFrame(list(enumerate(asked.titles)), "n int, title string")
        out = catalog.lookup_by_tier(queries, "n", "title", journals).join(queries, "n").orderBy("n")
        for line in out.select(F.to_json(F.struct("title", "status", "match_method", "journal_id", "matched_title"), {"ignoreNullFields": "false"})).toLocalIterator():
            print(line[0])
        return 0
    except Exception as error:  # a short message, no trace
        print(json.dumps({"error": str(error).splitlines()[0][:200]}), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
