"""CSV and JSON catalogs, snapshots of files, and sinks that write whole or not at all."""

from __future__ import annotations

import csv
import hashlib
import io
import os
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bibliolake.functions.clean import rewritten_title
from bibliolake.functions.keys import exact_key
from bibliolake.functions.text import strip
from bibliolake.operators.catalog import small
from bibliolake.operators.checks import canonical_json, reject_floats

# The columns of an index export; the fields of a catalog's entries.
INDEX_COLUMNS = ["Journal title", "ISSN", "eISSN", "Publisher name", "Publisher address", "Languages", "Web of Science Categories"]
_TEXTS = T.ArrayType(T.StringType())
_MEMBERSHIP = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("index_name", "index_version", "source_title", "source_record_id", "source_file")]
    + [T.StructField("source_line", T.IntegerType()), T.StructField("subject_categories", _TEXTS), T.StructField("match_method", T.StringType())]
)
CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("journal_id", T.StringType(), False),
        T.StructField("formal_title", T.StringType(), False),
        T.StructField("formal_title_evidence_ids", _TEXTS, False),
        T.StructField("aliases", _TEXTS, False),
        T.StructField("issn", _TEXTS, False),
        T.StructField("eissn", _TEXTS, False),
        T.StructField("priority_level", T.IntegerType(), False),
        T.StructField("priority_group", T.StringType(), False),
        T.StructField("priority_decision", T.MapType(T.StringType(), T.StringType()), False),
        T.StructField("ncs_internal_rank", T.IntegerType()),
        T.StructField("environment_subfields", _TEXTS, False),
        T.StructField("subject_categories", _TEXTS, False),
        T.StructField("formal_evidence", _TEXTS, False),
        T.StructField("evidence_ids", _TEXTS, False),
        T.StructField("index_memberships", _TEXTS, False),
        T.StructField("index_subject_categories", T.MapType(T.StringType(), _TEXTS), False),
        T.StructField("source_memberships", T.ArrayType(_MEMBERSHIP), False),
        T.StructField("source_catalogs", _TEXTS, False),
        T.StructField("catalog_version", T.StringType(), False),
        T.StructField("catalog_date", T.StringType(), False),
        T.StructField("revision_date", T.StringType(), False),
        T.StructField("manual_review_required", T.BooleanType(), False),
        T.StructField("review_reasons", _TEXTS, False),
        T.StructField("cnki_routing", T.MapType(T.StringType(), T.StringType()), False),
    ]
)

_EXPORTED = T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("line", T.IntegerType())] + [T.StructField(f"c{i}", T.StringType()) for i in range(len(INDEX_COLUMNS))]))


@F.pandas_udf(_EXPORTED)
def _read_export(paths: pd.Series, texts: pd.Series) -> pd.Series:
    """The rows of whole files with their number and the number of their last line."""
    found = []
    for path, text in zip(paths, texts):
        reader = csv.DictReader(io.StringIO(text, newline=""))
        if sorted(reader.fieldnames or []) != sorted(INDEX_COLUMNS):
            raise ValueError(f"{path} has other columns than an index export")
        rows = []
        for n, row in enumerate(reader, start=1):
            if not (row["Journal title"] or "").strip():
                raise ValueError(f"{path}: no title in line {reader.line_num}")
            rows.append((n, reader.line_num, *[row[c] for c in INDEX_COLUMNS]))
        found.append(rows)
    return pd.Series(found)


def read_index_csv(spark: SparkSession, path: str, index_name: str, index_version: str = "", titles: DataFrame | None = None) -> DataFrame:
    """Source records of index exports: columns in any order, but no others and none missing; a blank
    title fails. A record's line is its last one, as quoted cells may hold line ends; its id counts
    the rows of its file. titles (key, title) overrides display titles, key being the exact key;
    then titles of databases become those that are known. A file is one task, many files spread."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^\\x{feff}", "").alias("text"))
    rows = raw.select("path", F.explode(_read_export("path", "text")).alias("r"))

    def cell(name: str) -> Column:
        return strip(F.coalesce(F.col(f"r.c{INDEX_COLUMNS.index(name)}"), F.lit("")))

    def filled(values: Column) -> Column:
        return F.filter(values, lambda x: x != "")

    out = rows.select(
        F.lit(index_name).alias("index_name"),
        F.lit(index_version).alias("index_version"),
        F.element_at(F.split("path", "/"), -1).alias("source_file"),
        F.col("r.line").alias("source_line"),
        F.format_string(f"{index_name}:%05d", "r.n").alias("source_record_id"),
        cell("Journal title").alias("source_title"),
        F.array().cast("array<string>").alias("aliases"),
        filled(F.array(cell("ISSN"))).alias("issn"),
        filled(F.array(cell("eISSN"))).alias("eissn"),
        filled(F.transform(F.split(cell("Web of Science Categories"), r"\|"), strip)).alias("subject_categories"),
    )
    if titles is None:
        return out.withColumn("formal_title", rewritten_title(F.col("source_title")))
    joined = out.join(small(titles), exact_key(F.col("source_title")) == F.col("key"), "left")
    return joined.withColumn("formal_title", rewritten_title(F.coalesce("title", "source_title"))).drop("key", "title")


def read_catalog_json(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a JSON catalog {journals: [...]}; a wrong type fails, and so does an entry that
    lacks a field of the contract (only the internal rank may be null)."""
    schema = T.StructType([T.StructField("journals", T.ArrayType(CATALOG_SCHEMA))])
    own = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = own.select(F.explode("journals").alias("j")).select("j.*")
    return rows.select(*[F.col(f.name) if f.nullable else required(f.name, "journal_id").alias(f.name) for f in CATALOG_SCHEMA.fields])


def required(column: str, key: str) -> Column:
    """A column that fails the query where it is null: readers take every column for nullable, whatever
    the schema says."""
    c = F.col(column)
    missing = F.raise_error(F.concat(F.lit(f"no {column} in "), F.coalesce(F.col(key), F.lit("an entry"))))
    return F.coalesce(c, missing.cast(CATALOG_SCHEMA[column].dataType))


def snapshot(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(name, bytes, sha256) of files."""
    raw = spark.read.format("binaryFile").load(paths)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def different_files(left: DataFrame, right: DataFrame) -> DataFrame:
    """Names whose snapshots differ or that one side lacks."""
    pairs = left.alias("l").join(right.alias("r"), "name", "full")
    return pairs.filter(~F.col("l.sha256").eqNullSafe(F.col("r.sha256"))).select("name")


def write_bytes(path: str, content: bytes, *, check: bool = False) -> None:
    """Write a file whole or not at all; with check, compare and never write."""
    if check:
        with open(path, "rb") as f:
            if f.read() != content:
                raise ValueError(f"{os.path.basename(path)} differs")
        return
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, part = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "wb") as f:
        f.write(content)
    os.replace(part, path)


def write_mirrors(paths: list[str], content: bytes, *, check: bool = False) -> None:
    for path in paths:
        write_bytes(path, content, check=check)


def catalog_payload(catalog: DataFrame, key: str = "journal_id") -> DataFrame:
    """(key, json): one canonical JSON object for each entry; fractions are refused."""
    reject_floats(catalog)
    return catalog.select(key, canonical_json(catalog.schema, catalog.columns).alias("json"))


def write_jsonl(df: DataFrame, path: str, key: str) -> None:
    """Canonical JSON lines in the order of key, in as many files as the table has partitions."""
    catalog_payload(df, key).repartitionByRange(key).sortWithinPartitions(key).select("json").write.mode("overwrite").text(path)


def self_hashed(payload: str, placeholder: str = "0" * 64) -> str:
    """A payload with the placeholder of its hash field replaced by the hash of the whole."""
    return payload.replace(placeholder, hashlib.sha256(payload.encode()).hexdigest(), 1)


def holds_self_hash(payload: str, found: str, placeholder: str = "0" * 64) -> bool:
    return hashlib.sha256(payload.replace(found, placeholder, 1).encode()).hexdigest() == found
