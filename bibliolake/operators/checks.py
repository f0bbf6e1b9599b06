"""Integrity checks and canonical forms: counts, uniqueness, references, JSON, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sorted_within(c: Column, kind: T.DataType) -> Column:
    """A value with the fields of structs and the keys of maps in order, however deep."""
    if isinstance(kind, T.StructType):
        own = F.struct(*[_sorted_within(c.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(c.isNotNull(), own)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _sorted_within(x, kind.elementType))
    if isinstance(kind, T.MapType):
        keys = F.array_sort(F.map_keys(c))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: _sorted_within(F.element_at(c, k), kind.valueType)))
    return c


def canonical_json(schema: T.StructType, columns: list[str]) -> Column:
    """Columns of a table of this schema as one JSON object with sorted keys, at every depth, no spaces,
    nulls kept, text not escaped."""
    own = [_sorted_within(F.col(f"`{c}`"), schema[c].dataType).alias(c) for c in sorted(columns)]
    return F.to_json(F.struct(*own), {"ignoreNullFields": "false"})


def reject_floats(df: DataFrame) -> None:
    """Fails if any column, however deep, is a fraction: canonical forms have none."""

    def walk(kind: T.DataType, path: str) -> None:
        if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
            raise ValueError(f"fraction in {path}")
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}")
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, f"{path}[]")
        elif isinstance(kind, T.MapType):
            walk(kind.keyType, f"{path}.key")
            walk(kind.valueType, f"{path}.value")

    for f in df.schema.fields:
        walk(f.dataType, f.name)


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    return F.sha2(canonical_json(df.schema, columns), 256)


def table_hash(df: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """One hash for a table, whatever the order and partitions of its rows: the hash of its row
    hashes, summed in parts. (rows, hash)"""
    h = df.select(F.sha2(F.concat_ws("\x1f", F.col(key).cast("string"), canonical_json(df.schema, columns or df.columns)), 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(5)]
    one = h.agg(F.count(F.lit(1)).alias("rows"), *parts)
    return one.select("rows", F.sha2(F.concat_ws(",", *[F.coalesce(F.col(f"p{i}"), F.lit(0)).cast("string") for i in range(5)]), 256).alias("hash"))


def _stacked(one: DataFrame) -> DataFrame:
    pairs = ", ".join(f"'{n}', cast({n} as bigint)" for n in one.columns)
    return one.selectExpr(f"stack({len(one.columns)}, {pairs}) AS (check, failures)")


def catalog_checks(catalog: DataFrame, levels: list[int], *, level_counts: list[int] | None = None) -> DataFrame:
    """(check, failures): one row for each rule of a catalog; 0 means that it holds. With level_counts,
    one number for each level, the number of entries of each level and of all is checked too."""
    wanted = {}
    if level_counts is not None:
        differ = [F.abs(F.count_if(F.col("priority_level") == level) - F.lit(n)) for level, n in zip(levels, level_counts, strict=True)]
        wanted = {"wrong_level_counts": sum(differ[1:], differ[0]), "wrong_rows": F.abs(F.count(F.lit(1)) - F.lit(sum(level_counts)))}
    own = {
        "repeated_ids": F.count(F.lit(1)) - F.count_distinct("journal_id"),
        "repeated_titles": F.count("formal_title") - F.count_distinct("formal_title"),
        "blank_titles": F.count_if(F.coalesce(F.trim("formal_title"), F.lit("")) == ""),
        "unknown_levels": F.count_if(~F.coalesce(F.col("priority_level").isin(levels), F.lit(False))),
        "wrong_groups": F.count_if(~F.col("priority_group").eqNullSafe(F.format_string("level_%02d", F.col("priority_level")))),
        "no_memberships": F.count_if(F.coalesce(F.size("index_memberships"), F.lit(0)) == 0),
    }
    return _stacked(catalog.agg(*[c.alias(n) for n, c in (own | wanted).items()]))


def bundle_checks(catalog: DataFrame, evidence: DataFrame, artifacts: DataFrame, *, wanted_artifacts: int = 7) -> DataFrame:
    """(check, failures) of what goes out together: a number of snapshots (filename) of different names,
    evidence (evidence_id) without repeats, and no evidence of an entry that the registry lacks."""
    files = artifacts.agg(F.abs(F.count(F.lit(1)) - wanted_artifacts).alias("wrong_artifacts"), (F.count(F.lit(1)) - F.count_distinct("filename")).alias("repeated_artifacts"))
    known = evidence.agg((F.count(F.lit(1)) - F.count_distinct("evidence_id")).alias("repeated_evidence"))
    none = F.array().cast("array<string>")
    cited = catalog.select(F.explode(F.concat(F.coalesce("evidence_ids", none), F.coalesce("formal_title_evidence_ids", none))).alias("cited"))
    lost = missing_references(cited, "cited", evidence, "evidence_id").agg(F.count(F.lit(1)).alias("unknown_evidence"))
    return _stacked(files).unionByName(_stacked(known)).unionByName(_stacked(lost))


def missing_references(df: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Values of column that target's key lacks; nulls refer to nothing."""
    return df.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).distinct().join(target.select(F.col(key).alias("value")), "value", "left_anti")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows equally often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
