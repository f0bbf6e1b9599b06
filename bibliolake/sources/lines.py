"""Text catalogs as tables: lines with carried headings, lists, named tables, marked blocks.

A file is one record; its lines come out with their physical numbers, and headings are carried down
by a window per file. Files are catalogs kept by people, so one file fits a task; many files spread.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bibliolake.functions.clean import catalog_title, internal_rank, list_title, main_title, original_titles, split_breaks
from bibliolake.functions.text import strip


# The line of a classification's code; columns of the lists, prefixes of their ids.
CODE_LINE = r"^分类代码：`(.+)`。\s*$"
LIST_COLUMNS, LIST_NAME, LIST_VERSION = ["序号", "期刊名称", "学科名称"], "CSSCI", "2025-2026"
CLASSED_COLUMNS, CLASSED_NAME, CLASSED_VERSION = ["顺序", "原目录序号", "期刊名称", "备注"], "PKU_CORE", "2023"
BASELINE_BEGIN, BASELINE_END, BASELINE_ID = "## 四、十二级主目录", "## 附录一", "ENVJ-%06d"
BASELINE_TITLES = ["基线题名", "期刊名称"]


def locate(setting: str | None, *candidates: str) -> str:
    """The first of a configured path and default places that is a file."""
    for path in [setting, *candidates]:
        if path and os.path.isfile(path):
            return path
    raise FileNotFoundError("no catalog file")


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text) of whole files: no byte order mark, one kind of line end."""
    raw = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return raw.select("path", F.replace(F.regexp_replace("text", "^\\x{feff}", ""), F.lit("\r\n"), F.lit("\n")).alias("text"))


def lines(texts: DataFrame) -> DataFrame:
    """(path, line_no, line), line_no from 1."""
    return texts.select("path", F.posexplode(F.split("text", "\n")).alias("_p", "line")).select("path", (F.col("_p") + 1).alias("line_no"), "line")


def carried(value: Column, *, by: str = "path") -> Column:
    """The last value at or above a line of its file."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(by).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))


def source_blocks(texts: DataFrame) -> DataFrame:
    """(path, name, text) of blocks between begin and end marks; a repeated or unclosed mark fails."""
    begin = r"<!-- SOURCE_BEGIN: ([^>]+?) -->"
    parts = texts.select("path", F.split("text", r"(?=<!-- SOURCE_BEGIN: )").alias("_parts"))
    each = parts.select("path", F.explode("_parts").alias("_b")).withColumn("name", F.trim(F.regexp_extract("_b", begin, 1))).filter("name <> ''")
    at = F.expr("instr(_b, concat('<!-- SOURCE_END: ', name, ' -->'))")
    start = F.length(F.regexp_extract("_b", begin, 0))
    count = F.count(F.lit(1)).over(W.partitionBy("path", "name"))
    body = strip(F.substring(F.col("_b"), start + 1, F.col("_at") - start - 1))
    bad = (F.col("_at") == 0) | (F.col("_n") > 1)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad block marks: "), F.col("name")))).otherwise(body)
    return each.withColumn("_at", at).withColumn("_n", count).select("path", "name", checked.alias("text"))


def bullets(rows: DataFrame, headings: list[tuple[str, int, str]], default: tuple[int, str]) -> DataFrame:
    """(path, line_no, title, level, group) of "* " lines; a line that contains a heading's words
    sets level and group for what follows, the first heading of the list that fits."""
    level, group = F.lit(None).cast("int"), F.lit(None).cast("string")
    for words, n, name in reversed(headings):
        hit = F.col("line").contains(words)
        level, group = F.when(hit, F.lit(n)).otherwise(level), F.when(hit, F.lit(name)).otherwise(group)
    marked = rows.withColumn("_l", level).withColumn("_g", group)
    placed = marked.withColumn("level", F.coalesce(carried(F.col("_l")), F.lit(default[0]))).withColumn("group", F.coalesce(carried(F.col("_g")), F.lit(default[1])))
    own = placed.filter(F.col("_l").isNull() & F.col("line").startswith("* "))
    return own.select("path", "line_no", catalog_title(F.col("line")).alias("title"), "level", "group")


def bold_spans(rows: DataFrame, pinned_from: str, pinned_to: str, generic: list[str]) -> DataFrame:
    """(path, line_no, pos, title, internal_rank) of the bold texts of "* " lines, or of the whole line
    if none is bold; labels with generic words are left out. The rank is 1 between the first line
    that contains pinned_from and the first that contains pinned_to, 2 elsewhere; a file that lacks
    either, or has them the other way round, fails."""

    def first(words: str) -> Column:
        return F.min(F.when(F.col("line").contains(words), F.col("line_no"))).over(W.partitionBy("path"))

    placed = rows.withColumn("_from", first(pinned_from)).withColumn("_to", first(pinned_to))
    sound = F.coalesce(F.col("_from") < F.col("_to"), F.lit(False))
    rank = F.when(~sound, F.raise_error(F.concat(F.lit("no pinned region in "), F.col("path"))).cast("int"))
    rank = rank.when((F.col("line_no") > F.col("_from")) & (F.col("line_no") < F.col("_to")), 1).otherwise(2)
    bullet = r"(?U)^\s*\*\s+"
    bold = F.regexp_extract_all("line", F.lit(r"\*\*([^*]+)\*\*"), F.lit(1))
    labels = F.when(F.size(bold) > 0, bold).otherwise(F.array(F.regexp_replace("line", bullet, "")))
    # the rank is worked out for every line, so that a file without any bullet fails too
    ranked = placed.withColumn("internal_rank", rank).filter(F.col("internal_rank").isNotNull() & F.col("line").rlike(bullet))
    out = ranked.select("path", "line_no", "internal_rank", F.posexplode(labels).alias("pos", "_t"))
    for word in generic:
        out = out.filter(~F.col("_t").contains(word))
    return out.select("path", "line_no", "pos", catalog_title(F.col("_t")).alias("title"), "internal_rank").filter("title <> ''")


def numbered(rows: DataFrame) -> DataFrame:
    """(path, line_no, title, category) of "n. title" lines under the "### category" above them."""
    category = carried(F.nullif(strip(F.regexp_extract("line", r"^###\s+(.+)$", 1)), F.lit("")))
    own = rows.withColumn("category", category).withColumn("_t", F.regexp_extract("line", r"^\d+\.\s+(.+)$", 1)).filter("_t <> ''")
    return own.select("path", "line_no", list_title(F.col("_t")).alias("title"), "category")


def positional_table(rows: DataFrame) -> DataFrame:
    """(path, line_no, title, subject) of table lines whose first cell is a number: the two cells after it."""
    own = rows.select("path", "line_no", F.split("line", r"\|").alias("_c")).filter((F.size("_c") > 4) & (F.col("_c")[0] == "") & F.trim(F.col("_c")[1]).rlike("^[0-9]+$"))
    return own.select("path", "line_no", strip(F.col("_c")[2]).alias("title"), strip(F.col("_c")[3]).alias("subject")).filter("title <> '' and subject <> ''")


def cells(line: Column) -> Column:
    """The cells of a table line; an escaped bar is no border."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda x: F.replace(F.trim(x), F.lit("\\|"), F.lit("|")))


def named_tables(rows: DataFrame, required: list[str]) -> DataFrame:
    """(path, table_no, line_no, values map) of every table whose heading names all required columns.

    A table is a heading line, a separator line and lines with bars. A repeated heading or a row of
    another width fails; so does a file without any such table.
    """
    w = W.partitionBy("path").orderBy("line_no")
    bar = F.trim("line").startswith("|")
    separator = bar & F.trim("line").rlike(r"^\|?(?:\s*:?-{3,}:?\s*\|)+\s*:?-*:?\s*$")
    marked = rows.withColumn("_sep", separator).withColumn("_bar", bar)
    head = F.col("_bar") & F.coalesce(F.lead("_sep").over(w), F.lit(False)) & ~F.col("_sep")
    marked = marked.withColumn("_head", head)
    numbers = marked.withColumn("table_no", F.sum(F.col("_head").cast("int")).over(w))
    heads = numbers.withColumn("_names", carried(F.when(F.col("_head"), cells(F.col("line"))).when(~F.col("_bar"), F.array().cast("array<string>"))))
    is_row = F.col("_bar") & ~F.col("_head") & ~F.col("_sep") & (F.size(F.array_intersect("_names", F.array(*[F.lit(r) for r in required]))) == len(required))
    own = heads.withColumn("_row", F.coalesce(is_row, F.lit(False))).withColumn("_cells", cells(F.col("line")))
    bad = (F.size("_cells") != F.size("_names")) | (F.size(F.array_distinct("_names")) != F.size("_names"))
    # guarded by what a row is, as a filter may be evaluated after what stands here
    values = F.when(F.col("_row") & bad, F.raise_error(F.format_string("bad table row at line %d", "line_no"))).when(F.col("_row"), F.map_from_arrays("_names", "_cells"))
    return own.filter("_row").select("path", "table_no", "line_no", values.alias("values"))


def assert_tables(rows: DataFrame, found: DataFrame) -> DataFrame:
    """found, after failing for a file of rows that gave no table row."""
    missing = rows.select("path").distinct().join(found.select("path").distinct(), "path", "left_anti")
    if not missing.isEmpty():
        raise ValueError("a file has no table with the required columns")
    return found


def display_titles(numbered_rows: DataFrame, key: Column) -> DataFrame:
    """(key, title): one display title for each key; two different ones fail."""
    per = numbered_rows.groupBy(key.alias("key")).agg(F.min("title").alias("title"), F.max("title").alias("_other"))
    return per.select("key", F.when(F.col("title") != F.col("_other"), F.raise_error(F.concat(F.lit("two titles for "), F.col("key")))).otherwise(F.col("title")).alias("title"))


def between(texts: DataFrame, begin: str, end: str) -> DataFrame:
    """(path, text) between two marks, verbatim."""
    return texts.select("path", F.expr(f"substring_index(substring_index(text, '{begin}', -1), '{end}', 1)").alias("text")).filter(F.col("text") != "")


def coded_tables(rows: DataFrame, required: list[str], code: str = CODE_LINE) -> DataFrame:
    """named_tables with the code line and "### heading" above each row; a heading resets the code."""
    heading = F.nullif(strip(F.regexp_extract("line", r"^###\s+(.+)$", 1)), F.lit(""))
    own = F.when(heading.isNotNull(), F.lit("")).otherwise(F.nullif(F.regexp_extract("line", code, 1), F.lit("")))
    context = rows.select("path", "line_no", carried(heading).alias("heading"), F.nullif(carried(own), F.lit("")).alias("code"))
    return named_tables(rows, required).join(context, ["path", "line_no"])


def _source_records(rows: DataFrame, name: str, version: str, ident: Column, aliases: Column, categories: Column) -> DataFrame:
    """Source records of rows (path, line_no, values) of tables; their titles stay as they are."""
    none = F.array().cast("array<string>")
    return rows.select(
        F.lit(name).alias("index_name"),
        F.lit(version).alias("index_version"),
        F.element_at(F.split("path", "/"), -1).alias("source_file"),
        F.col("line_no").alias("source_line"),
        ident.alias("source_record_id"),
        F.col("values")["期刊名称"].alias("source_title"),
        F.col("values")["期刊名称"].alias("formal_title"),
        aliases.alias("aliases"),
        none.alias("issn"),
        none.alias("eissn"),
        categories.alias("subject_categories"),
    )


def read_list(texts: DataFrame) -> DataFrame:
    """Source records of a list with numbers and subjects; a file without its table fails."""
    rows = lines(texts)
    found = assert_tables(rows, named_tables(rows, LIST_COLUMNS))
    ident = F.format_string(f"{LIST_NAME}:%04d", F.col("values")["序号"].cast("int"))
    return _source_records(found, LIST_NAME, LIST_VERSION, ident, F.array().cast("array<string>"), F.array(F.col("values")["学科名称"]))


def read_classed_list(texts: DataFrame, branch: str) -> DataFrame:
    """Source records of a list whose tables stand under a heading and the code of its class; a former
    title in the remark is an alias, whole. A table without a heading, or a file without any, fails."""
    rows = lines(texts)
    found = coded_tables(rows, CLASSED_COLUMNS)
    assert_tables(rows, found)
    values = F.col("values")
    headed = F.coalesce(F.col("heading"), F.raise_error(F.format_string("no heading above line %d", "line_no")))
    ident = F.format_string(f"{CLASSED_NAME}:{branch}:%04d", values["原目录序号"].cast("int"))
    categories = F.filter(F.array(headed, F.col("code")), lambda x: x.isNotNull())
    return _source_records(found, CLASSED_NAME, CLASSED_VERSION, ident, original_titles(values["备注"]), categories)


def read_baseline(texts: DataFrame, headings: list[str], evidence_ids: dict[str, str] | None = None) -> DataFrame:
    """The entries of a master directory, one file: (ordinal, journal_id, formal_title, priority_level,
    ncs_internal_rank, environment_subfields, formal_evidence, evidence_ids).

    Of the region between its marks, the tables under the headings of the levels count, in order and
    one for each. An id is the stated one, else made of the entry's ordinal. A missing region, an
    unknown heading, tables that are not one for each level in order, a table with formal titles but
    no baseline titles, an id or a title that repeats fail.
    """
    everything = lines(texts)

    def first(c: Column) -> Column:
        return F.min(F.when(c, F.col("line_no"))).over(W.partitionBy("path"))

    marked = everything.withColumn("_from", first(F.col("line") == BASELINE_BEGIN))
    marked = marked.withColumn("_to", first(F.col("line").startswith(BASELINE_END) & (F.col("line_no") > F.col("_from"))))
    lost = F.raise_error(F.concat(F.lit("no main directory in "), F.col("path"))).cast("int")
    region = marked.filter(F.col("line_no").between(F.coalesce("_from", lost) + 1, F.coalesce("_to", lost) - 1)).select("path", "line_no", "line")
    heading = F.regexp_extract("line", r"^###\s+(.+)$", 1)
    place = F.array_position(F.array(*[F.lit(h) for h in headings]), heading).cast("int")
    unknown = F.raise_error(F.concat(F.lit("an unknown level: "), heading)).cast("int")
    levels = region.withColumn("_l", F.when(heading != "", F.when(place > 0, place).otherwise(unknown)))
    levels = levels.select("path", "line_no", carried(F.col("_l")).alias("priority_level"))
    found = named_tables(region, ["序号"]).join(levels, ["path", "line_no"]).filter(F.col("priority_level").isNotNull())
    values = F.col("values")
    titled = [F.map_contains_key(values, F.lit(n)) for n in (*BASELINE_TITLES, "正式题名", "期刊ID")]
    found = found.filter(titled[0] | titled[1] | titled[2])
    tables = found.groupBy("path").agg(F.transform(F.array_sort(F.collect_set(F.struct("table_no", "priority_level"))), lambda x: x["priority_level"]).alias("_levels"))
    wrong = tables.filter(F.col("_levels") != F.sequence(F.lit(1), F.lit(len(headings))))
    if not wrong.isEmpty() or tables.isEmpty():
        raise ValueError("the tables are not one for each level in order")
    unbased = F.raise_error(F.format_string("no baseline titles at line %d", "line_no"))
    cell = F.when((titled[2] | titled[3]) & ~titled[0], unbased.cast("string")).otherwise(F.coalesce(values[BASELINE_TITLES[0]], values[BASELINE_TITLES[1]]))
    numbered_rows = found.withColumn("ordinal", F.row_number().over(W.partitionBy("path").orderBy("line_no")))
    known = F.create_map(*[F.lit(x) for pair in (evidence_ids or {"": ""}).items() for x in pair])
    none = F.array().cast("array<string>")
    entries = numbered_rows.select(
        "path",
        "ordinal",
        F.coalesce(F.nullif(F.trim(values["期刊ID"]), F.lit("")), F.format_string(BASELINE_ID, "ordinal")).alias("journal_id"),
        main_title(cell).alias("formal_title"),
        "priority_level",
        internal_rank(cell).alias("ncs_internal_rank"),
        F.coalesce(split_breaks(values["环境细分领域"]), none).alias("environment_subfields"),
        F.coalesce(split_breaks(values["正式证据"]), none).alias("formal_evidence"),
    )
    entries = entries.withColumn("evidence_ids", F.filter(F.transform("formal_evidence", lambda x: F.element_at(known, x)), lambda x: x.isNotNull()))
    for c in ("journal_id", "formal_title"):
        repeated = F.count(F.lit(1)).over(W.partitionBy("path", c)) > 1
        entries = entries.withColumn(c, F.when(repeated, F.raise_error(F.concat(F.lit("repeated: "), F.col(c)))).otherwise(F.col(c)))
    return entries


def structure(texts: DataFrame) -> DataFrame:
    """(path, levels, groups, version, blocks) that a master catalog states in its head and marks."""
    found = texts.select(
        "path",
        F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^  - level: (\d+)$"), F.lit(1)), lambda x: x.cast("int")).alias("levels"),
        F.regexp_extract_all("text", F.lit(r'(?m)^    group: "([^"]+)"$'), F.lit(1)).alias("groups"),
        F.nullif(F.regexp_extract("text", r'(?m)^catalog_version: "([^"]+)"$', 1), F.lit("")).alias("version"),
        F.transform(F.regexp_extract_all("text", F.lit(r"<!-- SOURCE_BEGIN: ([^>]+?) -->"), F.lit(1)), lambda x: F.trim(x)).alias("blocks"),
    )
    return found


def check_structure(texts: DataFrame, *, levels: list[int], groups: list[str], version: str, blocks: list[str]) -> DataFrame:
    """(path, part) of every part of a master catalog that is not as expected, in this very order."""

    def same(c: str, wanted: list, kind: str) -> Column:
        return F.col(c) == F.array(*[F.lit(x) for x in wanted]).cast(f"array<{kind}>")

    checks = {
        "levels": same("levels", levels, "int"),
        "groups": same("groups", groups, "string"),
        "version": F.col("version").eqNullSafe(version),
        "blocks": same("blocks", blocks, "string"),
    }
    wrong = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    return structure(texts).select("path", F.explode(wrong).alias("part"))
