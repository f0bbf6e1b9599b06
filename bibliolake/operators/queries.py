"""Queries of the core operators, each beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibliolake.common import table
from bibliolake.functions import clean, keys, text
from bibliolake.operators import catalog, checks, control, dedup, matching, ranking
from bibliolake.plans import expressions
from bibliolake.sources import lines, pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The year against which years are verified.
AS_OF_YEAR = 2026
TOPIC = "湿地"
#: Scope rules: (scope_id, levels, membership).
SCOPE_RULES = [("top", [1, 2, 3], None), ("axsci_upper", [1, 2, 3, 4, 5, 6], "AXSCI"), ("core", [7, 8, 9, 10], "CORE_N"), ("all", list(range(1, 13)), None)]
#: A scope that is a list of ids, one of them unknown.
LISTED = ["ENVJ-000003", "ENVJ-000001", "ENVJ-000003", "ENVJ-9"]
#: Indexes that entries of a level are expected in.
EXPECTED = [(8, "AXSCI"), (9, "CORE_N"), (10, "HANLIST"), (11, "SOCIX"), (12, "SOCIX")]


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _list(x: str) -> str:
    """SQL for a joined list."""
    return f"array_to_string({x}, '|')"


def _strings(c) -> object:
    return F.array_join(c, "|")


# keys and cleaning


@query(
    f"""SELECT paper_id, {keys.sql_title_key("title")} AS k, {keys.sql_dotted_key("title")} AS dotted,
    {keys.sql_without_the(keys.sql_title_key("title"))} AS signature, {keys.sql_without_the(keys.sql_dotted_key("title"))} AS dotted_signature,
    {keys.sql_spelling_key("title")} AS spelling FROM papers"""
)
def title_keys(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("title")
    a, b = keys.signatures(t)
    return table(spark, sf, "papers").select(
        "paper_id", keys.title_key(t).alias("k"), keys.dotted_key(t).alias("dotted"), a.alias("signature"), b.alias("dotted_signature"), keys.spelling_key(t).alias("spelling")
    )


@query(
    f"""SELECT paper_id, {keys.sql_exact_key("journal_raw")} AS exact, {keys.sql_normalized_key("journal_raw")} AS normalized,
    {keys.sql_conservative_key("journal_raw")} AS conservative FROM papers"""
)
def journal_keys(spark: SparkSession, sf: str) -> DataFrame:
    j = F.col("journal_raw")
    return table(spark, sf, "papers").select("paper_id", keys.exact_key(j).alias("exact"), keys.normalized_key(j).alias("normalized"), keys.conservative_key(j).alias("conservative"))


_SQL_PEOPLE = f"""list_sort(list_distinct(list_filter(list_transform(authors, lambda a: regexp_replace({text.sql_folded("a")}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')), lambda a: a <> '')))"""


@query(f"SELECT paper_id, coalesce({_list(_SQL_PEOPLE)}, '') AS people FROM papers")
def author_identity(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "papers").select("paper_id", _strings(F.array_sort(keys.people_keys(F.col("authors")))).alias("people"))


def _sql_clean(x: str, n: int) -> str:
    return f"substring({text.sql_strip(f"regexp_replace({x}, '[\\p{{Cc}}\\p{{Cf}}]', '', 'g')")}, 1, {n})"


@query(
    f"""SELECT paper_id, {_sql_clean("title", 500)} AS title, {_sql_clean("journal_raw", 300)} AS journal,
    {_list(f"list_filter(list_transform(authors, lambda a: {_sql_clean('a', 120)}), lambda a: a <> '')[1:50]")} AS authors FROM papers"""
)
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "papers").select(
        "paper_id",
        clean.clean_text(F.col("title"), clean.TITLE_CHARS).alias("title"),
        clean.clean_text(F.col("journal_raw"), clean.JOURNAL_CHARS).alias("journal"),
        _strings(clean.clean_authors(F.col("authors"))).alias("authors"),
    )


@query(f"SELECT request_id, {text.sql_collapsed(text.sql_nfkc('query'))} AS asked, {text.sql_collapsed(text.sql_folded('query'))} AS cache_key FROM search_requests")
def query_keys(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("query")
    return table(spark, sf, "search_requests").select("request_id", clean.query_text(q).alias("asked"), control.cache_key(q).alias("cache_key"))


_WRITTEN, _SQL_SPACES = "[-/:年A-Za-z0-9]+", f"{text.SQL_SPACE}+"


def _sql_year(x: str) -> str:
    """The first date's year: the words from the first year on, each against the forms that it may have."""
    tail = f"nullif(regexp_extract({x}, '(?s)(?:^|[^A-Za-z0-9])((?:19|20)[0-9][0-9](?:$|[^0-9年].*))', 1), '')"
    words = f"regexp_extract({tail}, '^({_WRITTEN})(?:{_SQL_SPACES}({_WRITTEN}))?(?:{_SQL_SPACES}({_WRITTEN}))?', ['d', 't', 'm'])"
    day = "try_cast(concat_ws('-', w.d[1:4], lpad(coalesce(nullif(split_part(translate(w.d, '/', '-'), '-', 2), ''), '1'), 2, '0'), lpad(coalesce(nullif(split_part(translate(w.d, '/', '-'), '-', 3), ''), '1'), 2, '0')) AS DATE)"
    timely = "NOT regexp_matches(w.t, '^(?:[0-9]{1,2}:|[-/:])') OR (regexp_full_match(w.t, '(?:[01]?[0-9]|2[0-3])(?::[0-5][0-9]){1,2}') AND NOT regexp_matches(w.m, '^(?:[0-9]{1,2}:|[-/:])'))"
    whole = "regexp_full_match(w.d, '[0-9]{4}(?:-[0-9]{1,2}(?:-[0-9]{1,2})?|/[0-9]{1,2}(?:/[0-9]{1,2})?)?')"
    return f"list_transform([{words}], lambda w: CASE WHEN {whole} AND {day} IS NOT NULL AND ({timely}) THEN CAST(w.d[1:4] AS INTEGER) END)[1]"


@query(f"SELECT raw_id, {_sql_year('publication_date')} AS year FROM raw_rows")
def publication_years(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raw_rows").select("raw_id", clean.publication_year(F.col("publication_date")).alias("year"))


def _sql_count(x: str) -> str:
    digits = f"regexp_replace({x}, '[,，]|{text.SQL_SPACE}', '', 'g')"
    return f"CASE WHEN regexp_full_match({digits}, '[0-9]+') THEN try_cast({digits} AS INTEGER) END"


@query(f"SELECT raw_id, {_sql_count('citations')} AS citations, {_sql_count('downloads')} AS downloads, {_sql_count('result_rank')} AS result_rank FROM raw_rows")
def counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raw_rows").select("raw_id", *[clean.count_of(F.col(c)).alias(c) for c in ("citations", "downloads", "result_rank")])


@query(f"SELECT raw_id, {_list(f"list_filter(list_transform(regexp_split_to_array(authors, '[;；,，]'), lambda a: {text.sql_strip('a')}), lambda a: a <> '')")} AS names FROM raw_rows")
def split_authors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raw_rows").select("raw_id", _strings(clean.split_names(F.col("authors"))).alias("names"))


def _sql_lines() -> str:
    return "CAST(paper_id % 97 AS VARCHAR) || '. **' || journal_raw || '**' || CASE WHEN paper_id % 3 = 0 THEN ' - 说明文字' ELSE '' END || '；'"


@query(
    f"""WITH a AS (SELECT paper_id, {text.sql_strip(_sql_lines())} AS r FROM papers),
    b AS (SELECT paper_id, {text.sql_strip(f"replace(regexp_replace(regexp_replace(r, '^[0-9]+\\.{text.SQL_SPACE}+', ''), '^{text.SQL_SPACE}*\\*+{text.SQL_SPACE}*', ''), '**', '')")} AS r FROM a),
    c AS (SELECT paper_id, r, regexp_extract(r, '^(.+?) - [一-鿿].*$', 1) AS noted FROM b),
    d AS (SELECT paper_id, CASE WHEN noted <> '' THEN regexp_replace({text.sql_strip("noted")}, '{text.SQL_SPACE}*(?:[（(][^（）()]+[）)]|\\[[^\\]]+\\]|【[^】]+】)$', '') ELSE r END AS r FROM c)
    SELECT paper_id, regexp_replace(r, '^[ .；;，,]+|[ .；;，,]+$', '', 'g') AS title FROM d"""
)
def list_titles(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(
        (F.col("paper_id") % 97).cast("string"), F.lit(". **"), F.col("journal_raw"), F.lit("**"), F.when(F.col("paper_id") % 3 == 0, " - 说明文字").otherwise(""), F.lit("；")
    )
    return table(spark, sf, "papers").select("paper_id", clean.list_title(line).alias("title"))


@query(
    f"""WITH a AS (SELECT paper_id, {text.sql_strip(text.sql_nfkc("(journal_raw || CASE paper_id % 4 WHEN 0 THEN '（网络首发）' WHEN 1 THEN '[网络首发]' WHEN 2 THEN '网络首发' ELSE '' END)"))} AS j FROM papers),
    b AS (SELECT paper_id, j, {text.sql_strip("regexp_replace(j, '(?:\\(网络首发\\)|\\[网络首发\\]|【网络首发】|网络首发)$', '')")} AS t FROM a)
    SELECT paper_id, t AS title, CASE WHEN t <> j THEN 'controlled_display_suffix' WHEN t = j THEN 'normalized_exact' END AS method FROM b"""
)
def display_titles(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("paper_id") % 4
    j = F.concat("journal_raw", F.when(m == 0, "（网络首发）").when(m == 1, "[网络首发]").when(m == 2, "网络首发").otherwise(""))
    return table(spark, sf, "papers").select("paper_id", clean.display_title(j).alias("title"), clean.display_method(j).alias("method"))


@query(
    f"""WITH v AS (SELECT journal_id, {text.sql_strip("formal_title")} AS a, {text.sql_strip(text.sql_nfkc("formal_title"))} AS b FROM journals),
    w AS (SELECT journal_id, a, b, translate(b, '（）［］　', '()[] ') AS c, translate(b, '()[]', '（）［］') AS d FROM v)
    SELECT journal_id, {_list("list_sort(list_distinct(list_filter([a, b, c, d], lambda x: x <> '')))")} AS variants FROM w"""
)
def width_variants(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "journals").select("journal_id", _strings(F.array_sort(clean.name_variants(F.col("formal_title")))).alias("variants"))


@query(
    """SELECT paper_id, (CASE WHEN trim(coalesce(title, '')) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(coalesce(journal_raw, '')) <> '' THEN 1 ELSE 0 END
    + CASE WHEN publication_year BETWEEN 1900 AND 2027 THEN 1 ELSE 0 END + CASE WHEN trim(coalesce(publication_date, '')) <> '' THEN 1 ELSE 0 END
    + CASE WHEN citations IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN downloads IS NOT NULL THEN 1 ELSE 0 END
    + coalesce(len(list_filter(authors, lambda a: a IS NOT NULL)), 0))::INTEGER AS score FROM papers"""
)
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    cols = [F.col(c) for c in ("title", "journal_raw", "publication_year", "authors", "publication_date", "citations", "downloads")]
    return table(spark, sf, "papers").select("paper_id", clean.completeness(*cols, AS_OF_YEAR).alias("score"))


@query(
    f"""WITH s AS (SELECT paper_id, list_filter(matched_topic_fields, lambda x: x <> '') AS v FROM papers)
    SELECT paper_id, coalesce({_list("list_concat(list_filter(['TI','SU','KY','TKA'], lambda x: list_contains(v, x)), list_filter(v, lambda x, i: x NOT IN ('TI','SU','KY','TKA') AND list_position(v, x) = i))")}, '') AS fields FROM s"""
)
def ordered_metadata(spark: SparkSession, sf: str) -> DataFrame:
    own = clean.declared_first(F.col("matched_topic_fields"), expressions.TOPIC_FIELDS)
    return table(spark, sf, "papers").select("paper_id", F.coalesce(_strings(own), F.lit("")).alias("fields"))


@query(
    f"""WITH s AS (SELECT journal_id, list_distinct(list_concat(coalesce(aliases, []), [formal_title, concat('（', formal_title), concat('(', formal_title), 'ﬁne', 'fine']))  AS v FROM journals)
    SELECT journal_id, {_list(f"list_transform(list_sort(list_transform(v, lambda x: {{'n': {text.sql_nfkc('x')}, 'x': x}})), lambda y: y.x)")} AS names FROM s"""
)
def ordered_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Names in the order of their compatibility form; brackets of both widths and ligatures are planted."""
    t, none = F.col("formal_title"), F.array().cast("array<string>")
    names = F.concat(F.coalesce("aliases", none), F.array(t, F.concat(F.lit("（"), t), F.concat(F.lit("("), t), F.lit("ﬁne"), F.lit("fine")))
    return table(spark, sf, "journals").select("journal_id", _strings(clean.ordered_strings(names)).alias("names"))


@query("SELECT doc_id, coalesce(nullif(replace(replace(text, '|', '\\|'), chr(10), '<br>'), ''), '—') AS cell FROM documents")
def table_cells(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", clean.table_cell(F.col("text")).alias("cell"))


# catalog


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog entries as they are read: each journal from each of its catalogs, every third once more with an article."""
    own = table(spark, sf, "journals").select(
        F.expr("cast(substring(journal_id, 6) as int) * 20").alias("n"), "formal_title", "priority_level", "priority_group", "subject_categories", "ncs_internal_rank", F.posexplode("source_catalogs").alias("i", "source")
    )
    first = own.select(
        (F.col("n") + F.col("i")).alias("ordinal"), F.col("formal_title").alias("title"), F.col("priority_level").alias("level"), F.col("priority_group").alias("group"),
        "source", F.get("subject_categories", F.col("i")).alias("subject"), F.col("ncs_internal_rank").alias("internal_rank"),
    )
    again = own.filter("i = 0 and n % 60 = 0").select(
        (F.col("n") + 10).alias("ordinal"), F.concat(F.lit("The "), F.col("formal_title")).alias("title"), F.greatest(F.col("priority_level") - 1, F.lit(1)).alias("level"),
        F.lit("again").alias("group"), F.lit("AGAIN").alias("source"), F.lit(None).cast("string").alias("subject"), F.lit(None).cast("int").alias("internal_rank"),
    )
    return first.unionByName(again)


_SQL_ENTRIES = f"""own AS (SELECT CAST(substring(journal_id, 6) AS INTEGER) * 20 AS n, formal_title, priority_level, priority_group, subject_categories, ncs_internal_rank, source_catalogs, unnest(generate_series(1, len(source_catalogs))) AS i FROM journals),
entries AS (SELECT n + i - 1 AS ordinal, formal_title AS title, priority_level AS level, priority_group AS grp, source_catalogs[i] AS source, subject_categories[i] AS subject, ncs_internal_rank AS internal_rank FROM own
  UNION ALL SELECT n + 10, concat('The ', formal_title), greatest(priority_level - 1, 1), 'again', 'AGAIN', NULL, NULL FROM own WHERE i = 1 AND n % 60 = 0),
signed AS (SELECT *, {keys.sql_without_the(keys.sql_title_key("title"))} AS signature, {keys.sql_without_the(keys.sql_dotted_key("title"))} AS dotted FROM entries),
idx AS (SELECT signature, dotted, arg_min(title, level * 1000000 + ordinal) AS matched_title, min(level) AS priority_level, arg_min(grp, level * 1000000 + ordinal) AS priority_group,
  list(source ORDER BY ordinal) AS sources, list(subject ORDER BY ordinal) FILTER (subject IS NOT NULL) AS subjects, min(internal_rank) AS ncs_internal_rank, min(ordinal) AS ordinal
  FROM signed WHERE length(signature) >= 2 OR length(dotted) >= 2 GROUP BY signature, dotted)"""


@query(
    f"""WITH {_SQL_ENTRIES} SELECT signature, dotted, matched_title, priority_level, priority_group,
    {_list("list_filter(sources, lambda x, i: list_position(sources, x) = i)")} AS sources, coalesce({_list("list_filter(subjects, lambda x, i: list_position(subjects, x) = i)")}, '') AS subjects, ncs_internal_rank FROM idx"""
)
def build_index(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.build_index(_entries(spark, sf)).select(
        "signature", "dotted", "matched_title", "priority_level", "priority_group",
        _strings("source_catalogs").alias("sources"), _strings("subject_categories").alias("subjects"), "ncs_internal_rank",
    )


@query(f"WITH {_SQL_ENTRIES} SELECT DISTINCT matched_title FROM idx WHERE priority_group = 'level_09'")
def journals_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.journals_by_group(catalog.build_index(_entries(spark, sf)), "level_09")


@query("SELECT priority_level, count(*) AS journals FROM journals GROUP BY 1")
def level_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "journals").groupBy("priority_level").agg(F.count(F.lit(1)).alias("journals"))


@query(
    """SELECT CAST(count_if(priority_level <= 10) AS BIGINT) AS upper, CAST(count_if(list_contains(index_memberships, 'CORE_N')) AS BIGINT) AS core,
    CAST(count_if(priority_level <= 10 AND list_contains(index_memberships, 'CORE_N')) AS BIGINT) AS both_ways, CAST(count_if(priority_level > 10 AND list_contains(index_memberships, 'CORE_N')) AS BIGINT) AS added FROM journals"""
)
def catalog_statistics(spark: SparkSession, sf: str) -> DataFrame:
    upper, core = F.col("priority_level") <= 10, F.array_contains("index_memberships", "CORE_N")
    return table(spark, sf, "journals").agg(
        F.count_if(upper).alias("upper"), F.count_if(core).alias("core"), F.count_if(upper & core).alias("both_ways"), F.count_if(~upper & core).alias("added")
    )


_SQL_CLEANED = text.sql_strip(f"regexp_replace({text.sql_strip(text.sql_nfkc('journal_raw'))}, '(?:\\(网络首发\\)|\\[网络首发\\]|【网络首发】|网络首发)$', '')")
_SQL_LOOKUP = f"""asked AS (SELECT DISTINCT journal_raw FROM papers WHERE journal_raw IS NOT NULL),
cleaned AS (SELECT journal_raw, {_SQL_CLEANED} AS c, {text.sql_strip(text.sql_nfkc("journal_raw"))} AS w FROM asked),
q AS (SELECT *, {keys.sql_without_the(keys.sql_title_key("c"))} AS n, {keys.sql_without_the(keys.sql_dotted_key("c"))} AS d FROM cleaned),
sides AS (SELECT DISTINCT unnest([signature, dotted]) AS k, signature, dotted, matched_title, priority_level, priority_group, ncs_internal_rank, ordinal FROM idx),
hits AS (SELECT DISTINCT q.journal_raw, q.n, q.d, s.* FROM (SELECT *, unnest(list_distinct([n, d])) AS k FROM q) q JOIN sides s ON q.k = s.k AND length(q.k) >= 2),
flags AS (SELECT DISTINCT journal_raw, signature, dotted, matched_title, priority_level, priority_group, ncs_internal_rank, ordinal, signature = n AS same, signature = n AND dotted = d AS exact FROM hits),
tally AS (SELECT journal_raw, count_if(exact) AS e, count_if(same) AS s FROM flags GROUP BY 1),
chosen AS (SELECT f.* FROM flags f JOIN tally t USING (journal_raw) WHERE NOT (t.e > 0 AND t.s <= t.e) OR f.exact),
per AS (SELECT journal_raw, count(*) AS pairs, arg_min(matched_title, ordinal) AS t, arg_min(priority_level, ordinal) AS l, arg_min(priority_group, ordinal) AS g, arg_min(ncs_internal_rank, ordinal) AS r, list(matched_title ORDER BY ordinal) AS cs FROM chosen GROUP BY 1),
found AS (SELECT q.journal_raw, CASE WHEN pairs IS NULL THEN 'unmatched' WHEN pairs > 1 THEN 'ambiguous' ELSE 'matched' END AS status,
  CASE WHEN pairs = 1 THEN CASE WHEN c <> w THEN 'controlled_display_suffix' ELSE 'normalized_exact' END END AS match_method,
  CASE WHEN pairs = 1 THEN t END AS matched_title, CASE WHEN pairs = 1 THEN l END AS priority_level, CASE WHEN pairs = 1 THEN g END AS priority_group, CASE WHEN pairs = 1 THEN r END AS internal,
  CASE WHEN pairs > 1 THEN cs ELSE [] END AS candidates FROM q LEFT JOIN per USING (journal_raw))"""


@query(
    f"""WITH {_SQL_ENTRIES}, {_SQL_LOOKUP} SELECT journal_raw, status, match_method, matched_title, priority_level, priority_group, {_list("candidates")} AS candidates FROM found"""
)
def lookup_general(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "papers").select("journal_raw").filter("journal_raw is not null").distinct()
    found = catalog.lookup_general(names, "journal_raw", "journal_raw", catalog.build_index(_entries(spark, sf)))
    return found.withColumn("candidates", _strings("candidates"))


@query(
    f"""WITH t AS (SELECT 0 AS tier, {keys.sql_exact_key("formal_title")} AS k, journal_id, formal_title AS title FROM journals
      UNION SELECT 1, {keys.sql_exact_key("a")}, journal_id, formal_title FROM (SELECT journal_id, formal_title, unnest(aliases) AS a FROM journals) WHERE a IS NOT NULL
      UNION SELECT 2, {keys.sql_normalized_key("formal_title")}, journal_id, formal_title FROM journals),
    q AS (SELECT DISTINCT journal_raw, {keys.sql_exact_key("journal_raw")} AS e, {keys.sql_normalized_key("journal_raw")} AS n FROM papers WHERE journal_raw IS NOT NULL),
    h AS (SELECT q.journal_raw, t.tier, count(DISTINCT journal_id) AS ids, min(journal_id) AS j, min(title) AS m FROM q JOIN t ON (tier < 2 AND k = e) OR (tier = 2 AND k = n) GROUP BY 1, 2),
    b AS (SELECT journal_raw, min(tier) AS tier, arg_min(ids, tier) AS ids, arg_min(j, tier) AS j, arg_min(m, tier) AS m FROM h GROUP BY 1)
    SELECT q.journal_raw, CASE WHEN tier IS NULL THEN 'unmatched' WHEN ids = 1 THEN 'matched' ELSE 'ambiguous' END AS status,
      CASE WHEN ids = 1 THEN (['formal_title_exact', 'controlled_alias', 'conservative_normalized'])[tier + 1] END AS match_method,
      CASE WHEN ids = 1 THEN j END AS journal_id, CASE WHEN ids = 1 THEN m END AS matched_title FROM q LEFT JOIN b USING (journal_raw)"""
)
def lookup_env(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "papers").select("journal_raw").filter("journal_raw is not null").distinct()
    return catalog.lookup_by_tier(names, "journal_raw", "journal_raw", table(spark, sf, "journals"))


def _scope_rules(spark: SparkSession) -> DataFrame:
    rules = spark.createDataFrame(SCOPE_RULES, "scope_id string, levels array<int>, membership string").withColumn("ids", F.lit(None).cast("array<string>"))
    return rules.unionByName(spark.createDataFrame([("listed", None, None, LISTED)], "scope_id string, levels array<int>, membership string, ids array<string>"))


_SQL_RULES = ", ".join(f"('{s}', {lv}, {'NULL' if m is None else repr(m)})" for s, lv, m in SCOPE_RULES)


@query(
    f"""SELECT scope_id, journal_id, formal_title AS title FROM journals, (VALUES {_SQL_RULES}) r(scope_id, levels, membership)
    WHERE list_contains(levels, priority_level) AND (membership IS NULL OR list_contains(index_memberships, membership))
    UNION ALL SELECT 'listed', journal_id, formal_title FROM journals WHERE journal_id IN {tuple(LISTED)}"""
)
def scopes(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.scopes(table(spark, sf, "journals"), _scope_rules(spark))


# matching sources

_SQL_MATCH = f"""planted AS (SELECT CAST(substring(journal_id, 6) AS INTEGER) AS n, journal_id, formal_title FROM journals WHERE CAST(substring(journal_id, 6) AS INTEGER) % 20 = 0),
src AS (SELECT source_record_id, index_name, index_version, source_file, source_line, source_title, formal_title, issn, eissn, subject_categories FROM source_records
  UNION ALL SELECT 'P1:' || journal_id, 'AXSCI', 'p', 'planted', 1000000 + n, formal_title, formal_title, ['new-' || n], [], ['b', 'a'] FROM planted
  UNION ALL SELECT 'P2:' || journal_id, 'CORE_N', 'p', 'planted', 1000000 + n, 'other', 'other', ['new-' || n], ['more-' || n], ['c'] FROM planted
  UNION ALL SELECT 'P3:' || journal_id, 'HANLIST', 'p', 'planted', 1000000 + n, 'third', 'third', [], ['more-' || n], [] FROM planted
  UNION ALL SELECT 'P4:' || journal_id, 'SOCIX', 'p', 'planted', 1000000 + n, formal_title, formal_title, ['more-' || n, 'new-' || (n + 20)], NULL, [] FROM planted),
ids AS (SELECT DISTINCT unnest(list_concat(coalesce(issn, []), coalesce(eissn, []))) AS identifier, journal_id FROM journals),
owners AS (SELECT identifier, list(journal_id ORDER BY journal_id) AS o FROM ids WHERE identifier IS NOT NULL GROUP BY 1),
ex AS (SELECT {keys.sql_exact_key("formal_title")} AS e, count(DISTINCT journal_id) AS en, min(journal_id) AS ej FROM journals GROUP BY 1),
al AS (SELECT {keys.sql_exact_key("a")} AS e, arg_max(journal_id, journal_id || printf('%05d', i)) AS aj FROM (SELECT journal_id, aliases[i] AS a, i FROM (SELECT journal_id, aliases, unnest(generate_series(1, len(aliases))) AS i FROM journals)) WHERE a IS NOT NULL GROUP BY 1),
co AS (SELECT {keys.sql_conservative_key("formal_title")} AS k, count(DISTINCT journal_id) AS kn, min(journal_id) AS kj, list_sort(list_distinct(list(journal_id))) AS kc FROM journals GROUP BY 1),
m AS (SELECT *, {keys.sql_exact_key("formal_title")} AS e, {keys.sql_conservative_key("formal_title")} AS k, list_filter(list_concat(coalesce(issn, []), coalesce(eissn, [])), lambda x: x IS NOT NULL) AS l,
  row_number() OVER (ORDER BY index_name, source_line, source_record_id) AS n FROM src),
held AS MATERIALIZED (SELECT n, list({{'i': identifier, 'o': coalesce(o, [])}} ORDER BY p) AS h FROM (SELECT n, l[p] AS identifier, p FROM (SELECT n, l, unnest(generate_series(1, len(l))) AS p FROM m)) LEFT JOIN owners USING (identifier) GROUP BY 1),
w AS MATERIALIZED (SELECT m.n, source_record_id, index_name, l, coalesce(h, []) AS h, CASE WHEN en = 1 THEN 'formal_title_exact' WHEN aj IS NOT NULL THEN 'controlled_alias'
  WHEN kn = 1 THEN 'conservative_normalized' WHEN kn > 1 THEN 'ambiguous' ELSE 'out_of_scope' END AS tm, CASE WHEN en = 1 THEN ej WHEN aj IS NOT NULL THEN aj WHEN kn = 1 THEN kj END AS tj,
  CASE WHEN coalesce(en, 0) <> 1 AND aj IS NULL AND kn > 1 THEN kc ELSE [] END AS tc FROM m LEFT JOIN held USING (n) LEFT JOIN ex USING (e) LEFT JOIN al USING (e) LEFT JOIN co USING (k)),
walk AS MATERIALIZED (SELECT CAST(0 AS BIGINT) AS n, CAST(MAP {{}} AS MAP(VARCHAR, VARCHAR)) AS reg, CAST(NULL AS VARCHAR) AS source_record_id, CAST(NULL AS VARCHAR) AS index_name, CAST(NULL AS VARCHAR) AS method, CAST(NULL AS VARCHAR) AS journal_id, CAST([] AS VARCHAR[]) AS candidates, CAST([] AS VARCHAR[]) AS reasons
  UNION ALL SELECT n, CASE WHEN j IS NOT NULL AND len(veto) = 0 THEN map_concat(map_from_entries(list_transform(list_filter(list_distinct(list_transform(list_filter(h, lambda x: len(x.o) = 0), lambda x: x.i)), lambda x: reg[x] IS NULL), lambda x: {{'k': x, 'v': j}})), reg) ELSE reg END,
    source_record_id, index_name, CASE WHEN len(veto) > 0 THEN 'identifier_conflict' ELSE method END, CASE WHEN len(veto) = 0 THEN j END,
    CASE WHEN j IS NOT NULL THEN [j] WHEN method = 'identifier_conflict' THEN met[1].o ELSE tc END, CASE WHEN len(veto) > 0 THEN veto WHEN j IS NULL AND method <> 'out_of_scope' THEN [method] ELSE [] END
  FROM (SELECT *, CASE WHEN j IS NULL THEN [] ELSE list_transform(list_filter(met, lambda x: NOT list_contains(x.o, j)), lambda x: x.i) END AS veto
    FROM (SELECT *, CASE WHEN len(met) = 0 THEN tm WHEN len(met[1].o) = 1 THEN 'identifier' ELSE 'identifier_conflict' END AS method, CASE WHEN len(met) = 0 THEN tj WHEN len(met[1].o) = 1 THEN met[1].o[1] END AS j
      FROM (SELECT w.*, reg, list_filter(list_transform(w.h, lambda x: {{'i': x.i, 'o': CASE WHEN len(x.o) > 0 THEN x.o WHEN reg[x.i] IS NOT NULL THEN [reg[x.i]] ELSE [] END}}), lambda x: len(x.o) > 0) AS met FROM walk JOIN w ON w.n = walk.n + 1)))),
audit AS (SELECT source_record_id, index_name, method, CASE WHEN journal_id IS NOT NULL THEN 'matched' WHEN method = 'out_of_scope' THEN method ELSE 'ambiguous' END AS status, journal_id, candidates, reasons FROM walk WHERE n > 0)"""


def _source_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The source records, and planted ones after them in each index: rows that bring an entry new
    identifiers, rows found by those only, in chains of two, and rows with identifiers of two entries."""
    own = table(spark, sf, "source_records").select("source_record_id", "index_name", "index_version", "source_file", "source_line", "source_title", "formal_title", "issn", "eissn", "subject_categories")
    j = table(spark, sf, "journals").select(F.expr("cast(substring(journal_id, 6) as int)").alias("n"), "journal_id", "formal_title").filter("n % 20 = 0")
    new, more, after = F.format_string("new-%d", "n"), F.format_string("more-%d", "n"), F.format_string("new-%d", F.col("n") + 20)
    none, t = F.array().cast("array<string>"), F.col("formal_title")
    for name, index, title, issn, eissn, subjects in (
        ("P1", "AXSCI", t, F.array(new), none, ["b", "a"]),
        ("P2", "CORE_N", F.lit("other"), F.array(new), F.array(more), ["c"]),
        ("P3", "HANLIST", F.lit("third"), none, F.array(more), []),
        ("P4", "SOCIX", t, F.array(more, after), F.lit(None).cast("array<string>"), []),
    ):
        planted = j.select(
            F.concat_ws(":", F.lit(name), "journal_id").alias("source_record_id"), F.lit(index).alias("index_name"), F.lit("p").alias("index_version"), F.lit("planted").alias("source_file"),
            (F.col("n") + 1_000_000).alias("source_line"), title.alias("source_title"), title.alias("formal_title"), issn.alias("issn"), eissn.alias("eissn"),
            F.array(*[F.lit(x) for x in subjects]).cast("array<string>").alias("subject_categories"),
        )
        own = own.unionByName(planted)
    return own


def _audit(spark: SparkSession, sf: str) -> DataFrame:
    return matching.match_sources(_source_rows(spark, sf), table(spark, sf, "journals"))


@query(f"WITH RECURSIVE {_SQL_MATCH} SELECT source_record_id, index_name, method, status, journal_id, {_list('candidates')} AS candidates, {_list('reasons')} AS reasons FROM audit")
def match_audit(spark: SparkSession, sf: str) -> DataFrame:
    return _audit(spark, sf).withColumn("candidates", _strings("candidates")).withColumn("reasons", _strings("reasons"))


@query(f"WITH RECURSIVE {_SQL_MATCH} SELECT source_record_id, {_list('candidates')} AS candidates, {_list('reasons')} AS reasons FROM audit WHERE method = 'identifier_conflict'")
def identifier_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    found = matching.identifier_conflicts(_audit(spark, sf))
    return found.withColumn("candidates", _strings("candidates")).withColumn("reasons", _strings("reasons"))


@query(f"WITH RECURSIVE {_SQL_MATCH} SELECT index_name, count(*) AS total, CAST(count_if(status = 'matched') AS BIGINT) AS matched, CAST(count_if(status = 'out_of_scope') AS BIGINT) AS out_of_scope, CAST(count_if(status = 'ambiguous') AS BIGINT) AS ambiguous FROM audit GROUP BY 1")
def match_counts(spark: SparkSession, sf: str) -> DataFrame:
    return matching.match_counts(_audit(spark, sf))


_SQL_EXPECTED = ", ".join(f"({n}, '{x}')" for n, x in EXPECTED)


_SQL_GAPS = f"""gaps AS (SELECT j.journal_id, e.index_name FROM journals j JOIN (VALUES {_SQL_EXPECTED}) e(priority_level, index_name) USING (priority_level)
  WHERE NOT coalesce(list_contains(j.index_memberships, e.index_name), FALSE) AND NOT EXISTS (SELECT 1 FROM audit a WHERE a.status = 'matched' AND a.journal_id = j.journal_id AND a.index_name = e.index_name))"""


def _gaps(spark: SparkSession, sf: str, audit: DataFrame) -> DataFrame:
    return matching.expected_gaps(table(spark, sf, "journals"), audit, spark.createDataFrame(EXPECTED, "priority_level int, index_name string"))


@query(f"WITH RECURSIVE {_SQL_MATCH}, {_SQL_GAPS} SELECT journal_id, index_name FROM gaps")
def expected_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return _gaps(spark, sf, _audit(spark, sf))


@query(f"WITH RECURSIVE {_SQL_MATCH}, {_SQL_GAPS} SELECT status, count(*) AS rows FROM (SELECT status FROM audit UNION ALL SELECT 'expected_but_unmatched' FROM gaps) GROUP BY 1")
def audit_status(spark: SparkSession, sf: str) -> DataFrame:
    audit = _audit(spark, sf)
    return matching.full_audit(audit, _gaps(spark, sf, audit)).groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


@query(
    f"""WITH RECURSIVE {_SQL_MATCH}, n AS (SELECT DISTINCT index_name FROM audit), o AS (SELECT DISTINCT index_name, journal_id FROM audit WHERE status = 'matched')
    SELECT a.index_name AS left_index, b.index_name AS right_index, (SELECT count(*) FROM o x JOIN o y ON x.journal_id = y.journal_id WHERE x.index_name = a.index_name AND y.index_name = b.index_name) AS journals
    FROM n a JOIN n b ON a.index_name < b.index_name"""
)
def pairwise_intersections(spark: SparkSession, sf: str) -> DataFrame:
    return matching.pairwise_intersections(_audit(spark, sf))


_SQL_BOUND = f"""{_SQL_MATCH}, b AS (SELECT * EXCLUDE (q) FROM (SELECT a.journal_id, a.method, m.index_name, index_version, source_title, source_record_id, source_file, source_line, subject_categories, coalesce(issn, []) AS issn, coalesce(eissn, []) AS eissn, n,
  row_number() OVER (PARTITION BY a.journal_id, a.method, m.index_name, index_version, source_title, source_record_id, source_file, source_line, subject_categories ORDER BY n) AS q FROM audit a JOIN m USING (source_record_id) WHERE a.status = 'matched') WHERE q = 1)"""


@query(
    f"""WITH RECURSIVE {_SQL_BOUND} SELECT b.journal_id, b.index_name, source_record_id, source_line, {_list("b.subject_categories")} AS subjects, method,
    n = min(n) OVER (PARTITION BY b.journal_id, b.index_name) AND NOT coalesce(list_contains(j.index_memberships, b.index_name), FALSE) AS new_index FROM b JOIN journals j USING (journal_id)"""
)
def source_memberships(spark: SparkSession, sf: str) -> DataFrame:
    found = matching.memberships(_audit(spark, sf), _source_rows(spark, sf), table(spark, sf, "journals"))
    return found.select("journal_id", "index_name", "source_record_id", "source_line", _strings("subject_categories").alias("subjects"), "method", "new_index")


def _sql_grown(had: str, new: str) -> str:
    """A list that an entry had, then what is new, each once."""
    both = f"list_concat(coalesce({had}, []), coalesce({new}, []))"
    return _list(f"list_filter({both}, lambda x, i: list_position({both}, x) = i)")


@query(
    f"""WITH RECURSIVE {_SQL_BOUND}, c AS (SELECT journal_id, list(index_name || '=' || cs ORDER BY index_name) AS cats FROM (SELECT journal_id, index_name, array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i), ',') AS cs
      FROM (SELECT journal_id, index_name, flatten(list(subject_categories ORDER BY n)) AS s FROM b GROUP BY 1, 2)) GROUP BY 1),
    g AS (SELECT journal_id, count(*) AS records, list(index_name ORDER BY n) AS xs, flatten(list(issn ORDER BY n)) AS p, flatten(list(eissn ORDER BY n)) AS e FROM b GROUP BY 1)
    SELECT journal_id, records, {_sql_grown("j.index_memberships", "xs")} AS indexes, {_list("list_filter(xs, lambda y, i: list_position(xs, y) = i AND NOT list_contains(coalesce(j.index_memberships, []), y))")} AS new_indexes,
      {_list("cats")} AS categories, {_sql_grown("j.source_catalogs", "xs")} AS source_catalogs, {_sql_grown("j.issn", "p")} AS issn, {_sql_grown("j.eissn", "e")} AS eissn FROM g JOIN c USING (journal_id) JOIN journals j USING (journal_id)"""
)
def source_bindings(spark: SparkSession, sf: str) -> DataFrame:
    found = matching.bind_memberships(_audit(spark, sf), _source_rows(spark, sf), table(spark, sf, "journals"))
    maps = F.transform(F.map_entries("categories"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")))
    return found.select("journal_id", "records", *[_strings(c).alias(c) for c in ("indexes", "new_indexes", "source_catalogs", "issn", "eissn")], _strings(maps).alias("categories"))


# ranking and eligibility

_SQL_ANNOTATED = f"""{_SQL_ENTRIES}, {_SQL_LOOKUP}, papers_a AS (SELECT p.paper_id, p.topic_match_field, p.result_rank, f.matched_title, f.status, f.priority_level, f.priority_group, f.internal
  FROM papers p LEFT JOIN found f USING (journal_raw))"""


def _annotated(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.annotate(table(spark, sf, "papers"), catalog.build_index(_entries(spark, sf)))


@query(
    f"""WITH {_SQL_ANNOTATED} SELECT paper_id, matched_title AS journal_matched_title, priority_level, result_rank FROM papers_a
    ORDER BY priority_level IS NULL, coalesce(nullif(priority_level, 0), 999), coalesce(nullif(internal, 0), 999),
      CASE topic_match_field WHEN 'TI' THEN 1 WHEN 'SU' THEN 2 WHEN 'KY' THEN 3 WHEN 'TKA' THEN 4 ELSE 999 END, coalesce(result_rank, 0), paper_id LIMIT 20"""
)
def rank_papers_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: look up, annotate, rank, cut."""
    found = ranking.top_papers(table(spark, sf, "papers"), catalog.build_index(_entries(spark, sf)), 20)
    return found.select("paper_id", "journal_matched_title", "priority_level", "result_rank")


@query(
    f"""WITH {_SQL_ANNOTATED} SELECT paper_id, coalesce(matched_title IN (SELECT matched_title FROM idx WHERE priority_group = 'level_06'), FALSE) AS eligible FROM papers_a"""
)
def eligibility_general(spark: SparkSession, sf: str) -> DataFrame:
    index = catalog.build_index(_entries(spark, sf))
    return ranking.split_eligible(_annotated(spark, sf), catalog.journals_by_group(index, "level_06")).select("paper_id", "eligible")


@query(
    """SELECT p.paper_id, coalesce(j.journal_id IS NOT NULL AND j.priority_level IN (4, 5, 6) AND list_contains(j.index_memberships, 'AXSCI'), FALSE) AS eligible
    FROM papers p LEFT JOIN journals j ON p.journal_matched_title = j.formal_title"""
)
def eligibility_env(spark: SparkSession, sf: str) -> DataFrame:
    journals = table(spark, sf, "journals")
    by_title = journals.select("journal_id", "priority_level", "index_memberships", F.col("formal_title").alias("journal_matched_title"))
    records = table(spark, sf, "papers").select("paper_id", "journal_matched_title").join(by_title, "journal_matched_title", "left")
    scope = catalog.scopes(journals, _scope_rules(spark)).filter(F.col("scope_id") == "axsci_upper")
    return ranking.split_by_scope(records, scope, [4, 5, 6], "AXSCI").select("paper_id", "eligible")


_SQL_BUCKET = f"""rows_b AS (SELECT raw_id, page_id, CASE WHEN document_type IS DISTINCT FROM '期刊' THEN 'excluded'
  WHEN coalesce({text.sql_strip("title")}, '') <> '' AND coalesce({text.sql_strip("journal")}, '') <> '' AND {_sql_year('publication_date')} BETWEEN 1900 AND 2027 THEN 'complete' ELSE 'incomplete' END AS bucket FROM raw_rows)"""


def _bucketed(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "raw_rows").withColumn("_y", clean.publication_year(F.col("publication_date")))
    return ranking.bucket_rows(rows, kind="document_type", title="title", journal="journal", year="_y", wanted="期刊", as_of_year=AS_OF_YEAR)


@query(f"WITH {_SQL_BUCKET} SELECT raw_id, bucket FROM rows_b")
def bucket_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _bucketed(spark, sf).select("raw_id", "bucket")


@query(
    f"""WITH {_SQL_BUCKET} SELECT raw_id, page_id, bucket FROM (SELECT *, row_number() OVER (PARTITION BY page_id, bucket ORDER BY raw_id) AS n FROM rows_b)
    WHERE bucket = 'incomplete' OR (bucket = 'complete' AND n <= 5)"""
)
def page_cap(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.cap_page(_bucketed(spark, sf), ["page_id"], ["raw_id"], 5).select("raw_id", "page_id", "bucket")


# duplicate records

_SQL_WORKS = f"""w AS (SELECT paper_id, concat_ws(chr(31), {text.sql_casefold(text.sql_collapsed("coalesce(title, '')"))}, coalesce(CAST(publication_year AS VARCHAR), '')) AS work, coalesce({_SQL_PEOPLE}, []) AS people, * EXCLUDE (paper_id) FROM papers),
e AS (SELECT work, paper_id, unnest(people) AS a FROM w),
links AS (SELECT DISTINCT x.work, x.paper_id AS u, y.paper_id AS v FROM e x JOIN e y ON x.work = y.work AND x.a = y.a),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
comp AS (SELECT u AS paper_id, min(v) AS component FROM reach GROUP BY 1)"""


@query(f"WITH RECURSIVE {_SQL_WORKS} SELECT w.paper_id, comp.component FROM w LEFT JOIN comp USING (paper_id)")
def author_components(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "papers").select(
        "paper_id",
        F.concat_ws("\x1f", keys.work_key(F.coalesce("title", F.lit(""))), F.coalesce(F.col("publication_year").cast("string"), F.lit(""))).alias("work"),
        keys.people_keys(F.col("authors")).alias("people"),
    )
    return dedup.author_components(rows, "work", "paper_id", "people").select("paper_id", "component")


def _sql_merged(works: str) -> str:
    """The best record of each work with the metadata of all, those without authors last."""
    at = "(late * 100000000000 + paper_id)"

    def united(c: str, alias: str) -> str:
        first = f"SELECT work, unit, x, min({at} * 1000 + i) AS pl FROM (SELECT work, unit, late, paper_id, unnest({c}) AS x, unnest(generate_series(1, len({c}))) AS i FROM p) WHERE x <> '' GROUP BY 1, 2, 3"
        return f"{alias} AS (SELECT work, unit, list(x ORDER BY pl) AS {alias}_l FROM ({first}) GROUP BY 1, 2)"

    return f"""WITH RECURSIVE {works}, n AS (SELECT work, count(DISTINCT component) AS n, min(component) AS only FROM w LEFT JOIN comp USING (paper_id) GROUP BY 1),
    p AS (SELECT w.*, n.n, coalesce(c.component, CASE WHEN n.n = 1 THEN n.only ELSE -1 END) AS unit, CASE WHEN c.component IS NULL THEN 1 ELSE 0 END AS late,
      (CASE WHEN trim(coalesce(title, '')) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(coalesce(journal_raw, '')) <> '' THEN 1 ELSE 0 END + CASE WHEN publication_year BETWEEN 1900 AND 2027 THEN 1 ELSE 0 END
      + CASE WHEN trim(coalesce(publication_date, '')) <> '' THEN 1 ELSE 0 END + CASE WHEN citations IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN downloads IS NOT NULL THEN 1 ELSE 0 END
      + coalesce(len(list_filter(authors, lambda a: a IS NOT NULL)), 0))::INTEGER AS score FROM w LEFT JOIN comp c USING (paper_id) JOIN n USING (work)),
    {united("matched_topic_fields", "f")}, {united("matched_search_groups", "g")}
    SELECT arg_max(paper_id, score * 1000000000000 - {at}) AS paper_id, count(*) AS records, max(score) AS score,
      arg_min(topic_match_field, {at}) FILTER (topic_match_field <> '') AS topic_match_field,
      coalesce({_list("list_concat(list_filter(['TI','SU','KY','TKA'], lambda x: list_contains(any_value(f_l), x)), list_filter(any_value(f_l), lambda x: x NOT IN ('TI','SU','KY','TKA')))")}, '') AS fields,
      coalesce({_list("any_value(g_l)")}, '') AS groups FROM p LEFT JOIN f USING (work, unit) LEFT JOIN g USING (work, unit) GROUP BY work, unit"""


def _merged(spark: SparkSession, sf: str, with_journal: bool) -> DataFrame:
    merged = dedup.merge_records(table(spark, sf, "papers"), as_of_year=AS_OF_YEAR, with_journal=with_journal)
    return merged.select("paper_id", "records", "score", "topic_match_field", _strings("matched_topic_fields").alias("fields"), _strings("matched_search_groups").alias("groups"))


@query(_sql_merged(_SQL_WORKS))
def merge_records(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf, False)


@query(_sql_merged(_SQL_WORKS.replace("coalesce(CAST(publication_year", f"{text.sql_casefold(text.sql_collapsed("coalesce(journal_raw, '')"))}, coalesce(CAST(publication_year", 1)))
def merge_records_strict(spark: SparkSession, sf: str) -> DataFrame:
    """The variant that tells works apart by journal too."""
    return _merged(spark, sf, True)


# expressions

_SQL_TERMS = f"""t AS (SELECT journal_id, priority_group, formal_title, {text.sql_strip("formal_title")} AS a, {text.sql_strip(text.sql_nfkc("formal_title"))} AS b FROM journals),
v AS (SELECT journal_id, priority_group, formal_title, [a, b, translate(b, '（）［］　', '()[] '), translate(b, '()[]', '（）［］')] AS vs FROM t),
terms AS (SELECT journal_id, priority_group, formal_title, list_transform(list_filter(vs, lambda x, i: x <> '' AND list_position(vs, x) = i), lambda x: concat('LY=''', x, '''')) AS ts FROM v)"""


@query(f"WITH {_SQL_TERMS} SELECT journal_id, concat('(', array_to_string(ts, ' OR '), ')') AS clause FROM terms")
def journal_clause(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "journals").select("journal_id", expressions.clause(expressions.journal_terms(F.col("formal_title"))).alias("clause"))


_SQL_PLANS = f"""{_SQL_TERMS}, fields AS (SELECT * FROM (VALUES ('TI', 0), ('SU', 1), ('KY', 2), ('TKA', 3)) f(field, field_no)),
s AS (SELECT priority_group, field, field_no, length(field) + {len(" %= '湿地' AND ()")} AS head, formal_title, ts, row_number() OVER (PARTITION BY priority_group, field ORDER BY journal_id, formal_title) AS n,
  list_sum(list_transform(ts, lambda x: length(x))) AS c, len(ts) AS k FROM terms, fields),
r AS (SELECT priority_group, field, n, 1 AS b, CAST(head + c + 4 * (k - 1) AS BIGINT) AS size FROM s WHERE n = 1
  UNION ALL SELECT s.priority_group, s.field, s.n, CASE WHEN r.size + s.c + 4 * s.k <= 3000 THEN r.b ELSE r.b + 1 END,
    CAST(CASE WHEN r.size + s.c + 4 * s.k <= 3000 THEN r.size + s.c + 4 * s.k ELSE s.head + s.c + 4 * (s.k - 1) END AS BIGINT) FROM r JOIN s ON s.priority_group = r.priority_group AND s.field = r.field AND s.n = r.n + 1),
g AS (SELECT priority_group, field, field_no, b, count(*) AS journals, concat(field, ' %= ''湿地'' AND (', array_to_string(flatten(list(s.ts ORDER BY n)), ' OR '), ')') AS x FROM r JOIN s USING (priority_group, field, n) GROUP BY 1, 2, 3, 4)"""


@query(
    f"""WITH RECURSIVE {_SQL_PLANS}
    SELECT priority_group, b AS index, CAST(count(*) OVER (PARTITION BY priority_group) AS INTEGER) AS total, CAST(journals AS INTEGER) AS journals, CAST(length(x) AS INTEGER) AS chars, md5(x) AS digest FROM g WHERE field = 'TI'"""
)
def expression_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = expressions.batches(table(spark, sf, "journals"), ["priority_group"], "formal_title", ["journal_id"], TOPIC)
    return rows.select("priority_group", "index", "total", F.size("journals").alias("journals"), F.length("expression").alias("chars"), F.md5("expression").alias("digest"))


@query(
    f"""WITH RECURSIVE {_SQL_PLANS}, one AS (SELECT priority_group, field_no, b, concat('{{"catalog_version":"v4","expression":', to_json(x), ',"page_size":50,"scope_id":"wet","source_category":{{"code":"P01","label":"核心"}},"topic_field":"', field, '"}}') AS j FROM g)
    SELECT priority_group, CAST(field_no AS INTEGER) AS field_no, sha256(concat('[', string_agg(j, ',' ORDER BY b), ']')) AS token FROM one GROUP BY 1, 2"""
)
def plan_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The whole ladder of plans of each group, as one hash a field."""
    known = dict(scope_id="wet", catalog_version="v4", source_category=("P01", "核心"))
    return expressions.plan_token(expressions.field_ladder(table(spark, sf, "journals"), ["priority_group"], "formal_title", ["journal_id"], TOPIC, **known), ["priority_group", "field_no"])


_SQL_ASKED = "concat(CASE request_id % 3 WHEN 0 THEN 'SU %= ''' WHEN 1 THEN 'TI=''' ELSE '' END, query, CASE request_id % 5 WHEN 0 THEN ''' AND YE >= 2000' WHEN 1 THEN ''' AND LY=''x''' ELSE '''' END)"


@query(
    f"""WITH a AS (SELECT request_id, regexp_extract_all({_SQL_ASKED}, '\\b([A-Z][A-Z0-9]*)\\s*(?:%=|>=|<=|=|>|<|\\bBETWEEN\\b)', 1) AS f FROM search_requests WHERE query IS NOT NULL)
    SELECT request_id, {_list("f")} AS fields, len(f) > 0 AND len(list_filter(f, lambda x: x NOT IN {tuple(expressions.FIELDS)})) = 0 AS valid FROM a"""
)
def expression_fields(spark: SparkSession, sf: str) -> DataFrame:
    m, n = F.col("request_id") % 3, F.col("request_id") % 5
    asked = F.concat(F.when(m == 0, "SU %= '").when(m == 1, "TI='").otherwise(""), F.col("query"), F.when(n == 0, "' AND YE >= 2000").when(n == 1, "' AND LY='x'").otherwise("'"))
    rows = table(spark, sf, "search_requests").filter("query is not null")
    return rows.select("request_id", _strings(expressions.field_tokens(asked)).alias("fields"), expressions.is_expression(asked).alias("valid"))


# control as data

_SQL_ATTEMPTS = """attempts AS (SELECT user_id AS run, CAST((n - 1) // 3 + 1 AS INTEGER) AS batch, CAST((n - 1) % 3 + 1 AS INTEGER) AS attempt,
  CASE event_type WHEN 'purchase' THEN 'success' WHEN 'view' THEN 'success' WHEN 'click' THEN 'challenge' WHEN 'signup' THEN 'no_results' ELSE 'network_error' END AS status
  FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events))"""


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    rows = table(spark, sf, "events").select("user_id", "event_type", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"))
    kind = F.col("event_type")
    status = F.when(kind.isin("purchase", "view"), "success").when(kind == "click", "challenge").when(kind == "signup", "no_results").otherwise("network_error")
    return rows.select(F.col("user_id").alias("run"), F.expr("cast((n - 1) div 3 + 1 as int)").alias("batch"), F.expr("cast((n - 1) % 3 + 1 as int)").alias("attempt"), status.alias("status"))


@query(
    f"""WITH {_SQL_ATTEMPTS}, b AS (SELECT *, coalesce(count_if(status = 'challenge') OVER w, 0) AS c, coalesce(count_if(status = 'network_error') OVER w, 0) AS e,
      coalesce(bool_or(status IN ('success', 'no_results')) OVER w, FALSE) AS over_ FROM attempts WINDOW w AS (PARTITION BY run, batch ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    p AS (SELECT run, batch, bool_or(status IN ('success', 'no_results')) AS done, arg_max(status, attempt) AS last FROM b WHERE NOT over_ AND c <= 3 AND e <= 1 GROUP BY 1, 2),
    s AS (SELECT run, min(batch) FILTER (NOT done) AS stopped_at, count(*) AS batches, arg_min(last, batch) FILTER (NOT done) AS terminal_status FROM p GROUP BY 1)
    SELECT run, (SELECT count(*) FROM p WHERE p.run = s.run AND (s.stopped_at IS NULL OR p.batch < s.stopped_at)) AS completed, batches, stopped_at, terminal_status FROM s"""
)
def scheduler_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return control.run_outcomes(_attempts(spark, sf), ["run"]).select("run", "completed", "batches", "stopped_at", "terminal_status")


@query(
    f"""WITH RECURSIVE {_SQL_ATTEMPTS}, kept AS (SELECT DISTINCT run, batch FROM attempts WHERE batch % 3 = 1), n AS (SELECT run, batch, list({{'s': status}} ORDER BY attempt) AS l FROM attempts GROUP BY 1, 2),
    t AS (SELECT run, batch, l, list_position(list_transform(l, lambda x: x.s IN ('success', 'no_results')), TRUE) AS good,
      (list_filter(list_transform(l, lambda x, i: CASE WHEN x.s NOT IN ('success', 'no_results', 'challenge', 'network_error') THEN i WHEN x.s = 'network_error' AND len(list_filter(l[1:i], lambda y: y.s = 'network_error')) = 2 THEN i END), lambda x: x IS NOT NULL))[1] AS bad FROM n),
    d AS (SELECT run, batch, k.batch IS NOT NULL AS resumed, CASE WHEN k.batch IS NOT NULL THEN TRUE WHEN bad IS NULL THEN good IS NOT NULL ELSE coalesce(good < bad, FALSE) END AS done,
      CASE WHEN k.batch IS NOT NULL THEN 'success' WHEN bad IS NOT NULL AND coalesce(good, 99) > bad THEN l[bad].s WHEN good IS NOT NULL THEN l[good].s ELSE l[-1].s END AS last FROM t LEFT JOIN kept k USING (run, batch)),
    e AS (SELECT run, min(batch) FILTER (NOT done) AS fail, min(batch) FILTER (batch >= 4 AND last = 'success') AS lim, arg_min(last, batch) FILTER (NOT done) AS status FROM d GROUP BY 1)
    SELECT e.run, (SELECT count(*) FROM d WHERE d.run = e.run AND done AND (batch <= lim OR lim IS NULL) AND (batch < fail OR fail IS NULL)) AS completed, CASE WHEN lim IS NULL OR fail < lim THEN fail END AS stopped_at,
      CASE WHEN lim IS NULL OR fail < lim THEN status END AS terminal_status, lim IS NOT NULL AND (fail IS NULL OR lim < fail) AS limit_reached FROM e"""
)
def scheduler_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of which every third batch is in a checkpoint, and whose limit is reached from the fourth batch on."""
    log = _attempts(spark, sf)
    kept, stops = log.filter("batch % 3 = 1").select("run", "batch"), log.filter("batch >= 4").select("run", "batch")
    return control.run_outcomes(log, ["run"], kept, stops).select("run", "completed", "stopped_at", "terminal_status", "limit_reached")


@query(
    """WITH i AS (SELECT DISTINCT search_query AS run, coalesce(result_rank, 0) AS batch, title AS item, priority_level <= 6 AS q FROM papers WHERE search_query IS NOT NULL),
    f AS (SELECT run, item, min(batch) AS batch FROM i WHERE q GROUP BY 1, 2), n AS (SELECT run, batch, count(*) AS new_items FROM f GROUP BY 1, 2),
    b AS (SELECT DISTINCT run, batch FROM i), t AS (SELECT run, batch, coalesce(new_items, 0) AS new_items, CAST(sum(coalesce(new_items, 0)) OVER (PARTITION BY run ORDER BY batch) AS BIGINT) AS total FROM b LEFT JOIN n USING (run, batch))
    SELECT run, batch, new_items, total FROM t WHERE total - new_items < 10"""
)
def ladder_until_limit(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "papers").filter("search_query is not null").select(
        F.col("search_query").alias("run"), F.coalesce("result_rank", F.lit(0)).alias("batch"), F.col("title").alias("item"), F.coalesce(F.col("priority_level") <= 6, F.lit(False)).alias("q")
    )
    return control.batches_until_limit(rows, ["run"], "batch", "item", "q", 10)


@query(
    """SELECT search_query AS run, CAST(sum(n) AS BIGINT) AS records, coalesce(bool_and(applied), FALSE) AS facet_applied, arg_min(category_total, batch) FILTER (category_total IS NOT NULL) AS category_total FROM
    (SELECT search_query, coalesce(result_rank, 0) AS batch, count(*) AS n, bool_and(NOT manual_review_required) AS applied, max(citations) AS category_total FROM papers WHERE search_query IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""
)
def batch_totals(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "papers").filter("search_query is not null").groupBy(F.col("search_query").alias("run"), F.coalesce("result_rank", F.lit(0)).alias("batch"))
    rows = per.agg(F.count(F.lit(1)).alias("records"), F.bool_and(~F.col("manual_review_required")).alias("applied"), F.max("citations").alias("category_total"))
    return control.batch_totals(rows, ["run"])


@query(
    """WITH r AS (SELECT request_id, edition, date_trunc('day', requested_at) AS day, epoch_us(requested_at) AS t, row_number() OVER (PARTITION BY edition, date_trunc('day', requested_at) ORDER BY requested_at, request_id) AS i FROM search_requests),
    s AS (SELECT *, max(t - i * 6000000) OVER (PARTITION BY edition, day ORDER BY i) + i * 6000000 AS start FROM r)
    SELECT request_id, start, start - greatest(t, coalesce(lag(start) OVER (PARTITION BY edition, day ORDER BY i), t)) AS delay FROM s"""
)
def rate_gate(spark: SparkSession, sf: str) -> DataFrame:
    """One gate for each edition and day."""
    rows = table(spark, sf, "search_requests").withColumn("day", F.date_trunc("day", "requested_at"))
    return control.gate_starts(rows, ["edition", "day"], "requested_at", ["request_id"]).select("request_id", "start", "delay")


@query(
    f"""WITH RECURSIVE r AS (SELECT request_id, concat_ws(chr(31), {text.sql_collapsed(text.sql_folded("query"))}, CAST(row_limit AS VARCHAR)) AS k, epoch_us(requested_at) AS t FROM search_requests WHERE query IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, request_id) AS n FROM r),
    c AS (SELECT k, n, request_id, FALSE AS hit, t AS stored FROM o WHERE n = 1
      UNION ALL SELECT o.k, o.n, o.request_id, o.t < c.stored + 86400000000, CASE WHEN o.t < c.stored + 86400000000 THEN c.stored ELSE o.t END FROM c JOIN o ON o.k = c.k AND o.n = c.n + 1)
    SELECT request_id, hit FROM c"""
)
def cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "search_requests").filter("query is not null").withColumn("key", control.cache_key(F.col("query"))).withColumn("n", F.col("row_limit").cast("string"))
    return control.cache_hits(rows, ["key", "n"], "request_id", "requested_at").select(F.col("ident").alias("request_id"), "hit")


@query(
    """WITH r AS (SELECT request_id, edition, date_trunc('day', requested_at) AS day, requested_at, epoch_us(requested_at) AS t, (30 + CASE WHEN coalesce(outcome, '') NOT IN ('success', 'partial', 'no_results') THEN 180 ELSE 0 END) * 1000000 AS d FROM search_requests),
    s AS (SELECT *, coalesce(CAST(sum(d) OVER (PARTITION BY edition, day ORDER BY requested_at, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS s FROM r),
    x AS (SELECT request_id, t, s + max(t - s) OVER (PARTITION BY edition, day ORDER BY requested_at, request_id ROWS UNBOUNDED PRECEDING) AS start FROM s)
    SELECT request_id, start, start - t AS delay FROM x"""
)
def throttle(spark: SparkSession, sf: str) -> DataFrame:
    """One throttle for each edition and day."""
    rows = table(spark, sf, "search_requests").withColumn("day", F.date_trunc("day", "requested_at"))
    rows = rows.withColumn("bad", ~F.coalesce("outcome", F.lit("")).isin("success", "partial", "no_results"))
    return control.throttled_starts(rows, ["edition", "day"], "requested_at", ["request_id"], "bad").select("request_id", "start", "delay")


@query()
def bounded_cache(spark: SparkSession, sf: str) -> DataFrame:
    """One cache of 1,024 entries; tests hold it against a plain simulation."""
    rows = table(spark, sf, "search_requests").filter("query is not null").withColumn("key", control.cache_key(F.col("query")))
    return control.bounded_cache_hits(rows, ["key", "row_limit"], "request_id", "requested_at").select(F.col("ident").alias("request_id"), "hit")


_SQL_SNAPSHOTS = """snapshots AS (SELECT raw_id, CASE raw_id % 11 WHEN 0 THEN 403 WHEN 1 THEN 429 WHEN 2 THEN 503 ELSE 200 END AS code,
  CASE raw_id % 7 WHEN 0 THEN 'login.example.org' ELSE 'search.example.org' END AS host, CASE raw_id % 5 WHEN 0 THEN '/verify/home' WHEN 1 THEN '/other' ELSE '/results/list' END AS path,
  CASE raw_id % 13 WHEN 0 THEN '安全验证' ELSE title END AS title, CASE raw_id % 3 WHEN 0 THEN '抱歉，未检索到相关文献' WHEN 1 THEN '访问过于频繁' ELSE journal END AS body, raw_id % 2 = 0 AS has_table FROM raw_rows)"""


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("raw_id")
    return table(spark, sf, "raw_rows").select(
        "raw_id",
        F.when(i % 11 == 0, 403).when(i % 11 == 1, 429).when(i % 11 == 2, 503).otherwise(200).alias("code"),
        F.when(i % 7 == 0, "login.example.org").otherwise("search.example.org").alias("host"),
        F.when(i % 5 == 0, "/verify/home").when(i % 5 == 1, "/other").otherwise("/results/list").alias("path"),
        F.when(i % 13 == 0, "安全验证").otherwise(F.col("title")).alias("title"),
        F.when(i % 3 == 0, "抱歉，未检索到相关文献").when(i % 3 == 1, "访问过于频繁").otherwise(F.col("journal")).alias("body"),
        (i % 2 == 0).alias("has_table"),
    )


@query(
    f"""WITH {_SQL_SNAPSHOTS} SELECT raw_id, CASE WHEN code IN (401, 403) THEN 'forbidden' WHEN code = 429 THEN 'rate_limited' WHEN code BETWEEN 500 AND 599 THEN 'network_error'
    WHEN path LIKE '%/verify/%' OR coalesce(title, '') LIKE '%安全验证%' THEN 'challenge_detected' WHEN host = 'login.example.org' THEN 'login_required'
    WHEN host = 'search.example.org' AND path LIKE '/results%' AND has_table THEN 'success' WHEN NOT has_table AND coalesce(body, '') LIKE '%未检索到相关文献%' THEN 'no_results'
    WHEN NOT has_table AND coalesce(body, '') LIKE '%访问过于频繁%' THEN 'rate_limited' ELSE 'page_contract_changed' END AS state FROM snapshots"""
)
def page_state(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    state = control.page_state(c("code"), c("host"), c("path"), c("title"), c("body"), c("has_table"), result_host="search.example.org", result_path="/results", login_host="login.example.org")
    return _snapshots(spark, sf).select("raw_id", state.alias("state"))


@query(
    f"""WITH {_SQL_SNAPSHOTS} SELECT raw_id, CASE WHEN has_table THEN 'success' WHEN coalesce(body, '') LIKE '%未检索到相关文献%' THEN 'no_results' WHEN path LIKE '/verify%' THEN 'challenge_detected' ELSE 'page_contract_changed' END AS state FROM snapshots"""
)
def outcome_state(spark: SparkSession, sf: str) -> DataFrame:
    return _snapshots(spark, sf).select("raw_id", control.outcome_state(F.col("has_table"), F.col("body"), F.col("path").startswith("/verify")).alias("state"))


@query(
    """SELECT request_id, CASE WHEN outcome NOT IN ('success', 'partial', 'no_results') AND row_limit < 20 THEN outcome WHEN outcome NOT IN ('success', 'partial', 'no_results') THEN 'partial'
    WHEN request_id % 4 > 0 THEN 'partial' WHEN request_id % 3 > 0 THEN 'success' ELSE 'no_results' END AS status FROM search_requests"""
)
def derived_status(spark: SparkSession, sf: str) -> DataFrame:
    terminal = F.when(~F.col("outcome").isin("success", "partial", "no_results"), F.col("outcome"))
    return table(spark, sf, "search_requests").select(
        "request_id", control.derived_status(terminal, F.col("row_limit") >= 20, F.col("request_id") % 3, F.col("request_id") % 4).alias("status")
    )


_PLANTED = ["see ", "TI=a AND LY=", "ＳＵ %= ", "my Cookie is ", "ftp://", "/srv/", "~/", "\\\\host", "$HOME/", "%UserProfile%", "C:/", "f ile: /", "file:x ", "<b> ", "a < b ", "q:r ", "www.a.org "]
_SQL_STORED = f"""t AS (SELECT paper_id, title, (['', {", ".join("'" + x + "'" for x in _PLANTED)}])[paper_id % {len(_PLANTED) + 1} + 1] || title AS raw FROM papers),
u AS (SELECT paper_id, {text.sql_strip(f"regexp_replace({text.sql_nfkc('raw')}, '[\\p{{Cc}}\\p{{Cf}}]', '', 'g')")} AS v FROM t), l AS (SELECT paper_id, v, {text.sql_casefold("v")} AS f FROM u),
x AS (SELECT *, trim(substring(f, strpos(f, ':') + 1)) AS target, regexp_replace(split_part(f, ':', 1), '{text.SQL_SPACE}', '', 'g') AS scheme FROM l)"""


@query(
    f"""WITH {_SQL_STORED} SELECT paper_id, CASE WHEN contains(f, 'su %=') OR contains(f, 'ly=') OR contains(f, 'ye between') OR contains(f, '://') OR contains(f, 'cookie') OR (contains(v, '<') AND contains(v, '>'))
      OR left(v, 1) IN ('/', '\\', '~') OR starts_with(f, '$home') OR starts_with(f, '${{home}}') OR starts_with(f, '%userprofile%') OR regexp_matches(v, '^\\p{{L}}:[\\\\/]')
      OR (contains(f, ':') AND scheme = 'file' AND (left(target, 1) IN ('/', '\\') OR regexp_matches(target, '^\\p{{L}}:[\\\\/]'))) THEN NULL ELSE {text.sql_strip("substring(v, 1, 60)")} END AS kept FROM x"""
)
def storable_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Titles with planted beginnings of paths, addresses, expressions and markup, and harmless ones."""
    begins = F.array(F.lit(""), *[F.lit(x) for x in _PLANTED])
    raw = F.concat(F.get(begins, (F.col("paper_id") % (len(_PLANTED) + 1)).cast("int")), "title")
    return table(spark, sf, "papers").select("paper_id", control.storable_text(raw, 60).alias("kept"))


# pages, texts, checks


def _sql_read(x: str, empty: str = "''") -> str:
    """What a page's cell reads as: empty without a value, nothing at all for a page without a row."""
    return f"CASE WHEN there THEN coalesce({x}, {empty}) END"


@query(
    f"""WITH r AS (SELECT *, coalesce({text.sql_collapsed("title")}, '') <> '' OR coalesce({text.sql_collapsed("journal")}, '') <> '' OR coalesce({text.sql_collapsed("document_type")}, '') <> '' AS there FROM raw_rows)
    SELECT raw_id, {_sql_read(text.sql_collapsed("title"))} AS title, {_sql_read(_list(f"list_filter(list_transform(regexp_split_to_array(authors, '[;；,，]'), lambda a: {text.sql_collapsed('a')}), lambda a: a <> '')"))} AS authors,
    {_sql_read(text.sql_collapsed("publication_date"))} AS publication_date, CASE WHEN there THEN {_sql_year(text.sql_collapsed("publication_date"))} END AS publication_year, {_sql_read(text.sql_collapsed("journal"))} AS journal_raw, CASE WHEN there THEN {_sql_count("citations")} END AS citations,
    CASE WHEN there THEN {_sql_count("downloads")} END AS downloads, {_sql_read(_sql_count("result_rank"), "0")} AS result_rank, CASE WHEN there THEN is_online_first END AS is_online_first FROM r"""
)
def html_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Rows written as pages, with nested tables and unclosed cells, and read again."""
    rows = table(spark, sf, "raw_rows")

    def safe(c):
        return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    def cell(name: str, value, close: bool = True):
        return F.concat(F.lit(f'<td class="{name}">'), safe(value), F.lit("</td>" if close else ""))

    linked = lambda c: F.concat(F.lit("<a>"), safe(F.col(c)), F.lit("</a>"))
    people = F.array_join(F.transform(clean.split_names(F.coalesce("authors", F.lit(""))), lambda x: F.concat(F.lit("<a>"), safe(x), F.lit("</a> "))), "")
    early = F.when(F.col("is_online_first"), "<b>网络首发</b>").otherwise("")
    page = F.concat(
        F.lit('<div><table class="result-table-list x"><tr>'),
        cell("seq", F.col("result_rank")),
        F.lit('<td class="name">'), linked("title"), early, F.lit("<table><tr><td class='name'><a>nested</a></td></tr></table></td>"),
        F.lit('<td class="author">'), people, F.lit("</td>"),
        F.lit('<td class="source">'), linked("journal"), F.lit(" note</td>"),
        cell("date", F.col("publication_date"), close=False),
        cell("data", F.col("document_type")),
        cell("quote", F.col("citations")),
        cell("download", F.col("downloads")),
        F.lit("</tr></table></div>"),
    )
    read = pages.parse_pages(rows.select("raw_id", page.alias("html")), "raw_id", "html")
    return read.select("raw_id", "title", _strings("authors").alias("authors"), "publication_date", "publication_year", "journal_raw", "citations", "downloads", "result_rank", "is_online_first")


@query(
    """WITH l AS (SELECT n_nationkey AS n, n_regionkey AS r, n_name, row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS i, n_regionkey IS DISTINCT FROM lag(n_regionkey) OVER (ORDER BY n_regionkey, n_nationkey) AS h FROM nation)
    SELECT n_name AS title, r_name AS category FROM l JOIN region ON r = r_regionkey"""
)
def heading_fill(spark: SparkSession, sf: str) -> DataFrame:
    """A numbered list under headings, written as a text and read again."""
    from pyspark.sql import Window as W

    nations = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    w = W.partitionBy("n_regionkey").orderBy("n_nationkey")
    line = F.concat(F.when(F.row_number().over(w) == 1, F.concat(F.lit("### "), F.col("r_name"), F.lit("\n"))).otherwise(""), F.row_number().over(w).cast("string"), F.lit(". "), F.col("n_name"))
    parts = nations.select(F.struct("n_regionkey", "n_nationkey", line.alias("x")).alias("s"))
    whole = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]), "\n").alias("text")).select(F.lit("nations").alias("path"), "text")
    return lines.numbered(lines.lines(whole)).select("title", "category")


_SQL_CANONICAL = """concat('{"aliases":', CASE WHEN aliases IS NULL THEN 'null' ELSE concat('[', array_to_string(list_transform(aliases, lambda x: to_json(x)), ','), ']') END, ',"by_index":{"a":[{"n":1,"z":', to_json(formal_title), '}],"b":[]},"formal_title":', to_json(formal_title), ',"journal_id":', to_json(journal_id),
 ',"ncs_internal_rank":', coalesce(CAST(ncs_internal_rank AS VARCHAR), 'null'), ',"nested":{"inner":{"a":1,"b":null},"level":', CAST(priority_level AS VARCHAR), '}', ',"priority_level":', CAST(priority_level AS VARCHAR), '}')"""


@query(f"SELECT journal_id, sha256({_SQL_CANONICAL}) AS hash FROM journals")
def canonical_hash(spark: SparkSession, sf: str) -> DataFrame:
    """With planted structs and maps whose fields and keys are not in order."""
    nested = F.struct(F.col("priority_level").alias("level"), F.struct(F.lit(None).cast("string").alias("b"), F.lit(1).alias("a")).alias("inner"))
    item = F.struct(F.col("formal_title").alias("z"), F.lit(1).alias("n"))
    by_index = F.create_map(F.lit("b"), F.slice(F.array(item), 1, 0), F.lit("a"), F.array(item))
    rows = table(spark, sf, "journals").select("journal_id", "formal_title", "aliases", "priority_level", "ncs_internal_rank", nested.alias("nested"), by_index.alias("by_index"))
    return rows.select("journal_id", checks.row_hash(rows, rows.columns).alias("hash"))


@query()
def table_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """One hash of the papers table, all columns; tests hold it against shuffled and changed tables."""
    return checks.table_hash(table(spark, sf, "papers"), "paper_id")


@query(
    """WITH c AS (SELECT count(*) - count(DISTINCT journal_id) AS repeated_ids, count(formal_title) - count(DISTINCT formal_title) AS repeated_titles, count_if(trim(coalesce(formal_title, '')) = '') AS blank_titles, count_if(NOT coalesce(priority_level IN (1,2,3,4,5,6,7,8,9,10,11,12), FALSE)) AS unknown_levels,
    count_if(priority_group IS DISTINCT FROM printf('level_%02d', priority_level)) AS wrong_groups, count_if(coalesce(len(index_memberships), 0) = 0) AS no_memberships,
    (SELECT sum(abs(coalesce(n, 0) - 125)) FROM generate_series(1, 12) l(level) LEFT JOIN (SELECT priority_level AS level, count(*) AS n FROM journals GROUP BY 1) USING (level)) AS wrong_level_counts, abs(count(*) - 1500) AS wrong_rows FROM journals)
    SELECT unnest(['repeated_ids', 'repeated_titles', 'blank_titles', 'unknown_levels', 'wrong_groups', 'no_memberships', 'wrong_level_counts', 'wrong_rows']) AS check,
    unnest([repeated_ids, repeated_titles, blank_titles, unknown_levels, wrong_groups, no_memberships, wrong_level_counts, wrong_rows])::BIGINT AS failures FROM c"""
)
def catalog_checks(spark: SparkSession, sf: str) -> DataFrame:
    return checks.catalog_checks(table(spark, sf, "journals"), list(range(1, 13)), level_counts=[125] * 12)


@query(
    """SELECT DISTINCT j || '-x' AS value FROM (SELECT journal_id AS j, doc_id FROM documents WHERE journal_id IS NOT NULL) WHERE doc_id % 10 = 0
    UNION SELECT DISTINCT journal_id FROM documents d WHERE journal_id IS NOT NULL AND doc_id % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM journals j WHERE j.journal_id = d.journal_id)"""
)
def reference_check(spark: SparkSession, sf: str) -> DataFrame:
    """References of documents, of which one in ten is planted as unknown."""
    docs = table(spark, sf, "documents").withColumn("journal_id", F.when(F.col("doc_id") % 10 == 0, F.concat("journal_id", F.lit("-x"))).otherwise(F.col("journal_id")))
    return checks.missing_references(docs, "journal_id", table(spark, sf, "journals"), "journal_id")


@query("SELECT page_id, raw_id FROM raw_rows WHERE page_id IN (SELECT page_id FROM raw_rows GROUP BY 1 HAVING bool_and(coalesce(title <> '', FALSE)))")
def whole_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of pages of which every row has a title."""
    return control.keep_whole_batches(table(spark, sf, "raw_rows").select("page_id", "raw_id", "title"), ["page_id"], F.col("title") != "").select("page_id", "raw_id")
