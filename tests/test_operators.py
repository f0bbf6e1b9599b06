import ast
import os
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

import bibliolake
from bibliolake import common
from bibliolake.operators import catalog, checks, control, dedup, matching, ranking
from bibliolake.plans import expressions, search

ENTRY = "ordinal int, title string, level int, group string, source string, subject string, internal_rank int"


def index(spark, *entries):
    return catalog.build_index(spark.createDataFrame(list(entries), ENTRY))


def test_nothing_imports_llm():
    root = os.path.dirname(bibliolake.__file__)
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for name in files:
            if name.endswith(".py"):
                for node in ast.walk(ast.parse(open(os.path.join(folder, name), encoding="utf8").read())):
                    names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                    assert not any("llm" in n for n in names), name


def test_index_keeps_smallest_level_and_first_seen(spark):
    i = index(
        spark,
        (1, "The Arts & Media", 9, "nine", "S1", "art", None),
        (2, "Arts and Media", 3, "three", "S2", "media", 2),
        (3, "Arts and media", 3, "other", "S1", "art", 1),
        (4, "A", 1, "one", "S1", None, None),
    )
    (r,) = i.collect()
    assert (r.matched_title, r.priority_level, r.priority_group, r.ncs_internal_rank) == ("Arts and Media", 3, "three", 1)
    assert (r.source_catalogs, r.subject_categories) == (["S1", "S2"], ["art", "media"])


def test_lookup_ambiguity(spark):
    i = index(spark, (1, "A.B", 1, "g", "S", None, None), (2, "AB", 2, "g", "S", None, None), (3, "Nature", 1, "g", "S", None, None))
    asked = spark.createDataFrame([(1, "A.B"), (2, "AB"), (3, "Nature（网络首发）"), (4, "none"), (5, None), (6, "")], "q int, j string")
    got = {r.q: (r.status, r.match_method, r.matched_title) for r in catalog.lookup_general(asked, "q", "j", i).collect()}
    assert got[1][0] == got[2][0] == "ambiguous"
    assert got[3] == ("matched", "controlled_display_suffix", "Nature")
    assert got[4][0] == got[5][0] == got[6][0] == "unmatched"


def test_unknown_group_fails(spark):
    with pytest.raises(ValueError):
        catalog.journals_by_group(index(spark, (1, "Nature", 1, "g", "S", None, None)), "x")


CATALOG = "journal_id string, formal_title string, aliases array<string>, issn array<string>, eissn array<string>, index_memberships array<string>, priority_level int"
SOURCE = "source_record_id string, index_name string, formal_title string, issn array<string>, eissn array<string>, source_line int"


@pytest.fixture()
def pair(spark):
    journals = spark.createDataFrame(
        [
            ("J1", "Alpha Review", ["Alpha Rev"], ["1111-1111"], None, ["X"], 1),
            ("J2", "Beta", None, ["2222-2222"], ["3333-3333"], None, 9),
            ("J3", "beta", [], ["2222-2222"], [], [], 9),
            ("J4", "Gamma & Delta", [None], None, None, ["Y"], 8),
        ],
        CATALOG,
    )
    sources = spark.createDataFrame(
        [
            ("a", "X", "whatever", ["9", "1111-1111"], None, 1),
            ("b", "X", "Beta", ["2222-2222"], None, 2),
            ("c", "Y", "ALPHA REV", None, None, 3),
            ("d", "Y", "The Gamma and Delta", None, None, 4),
            ("e", "Y", "BETA", [], [], 5),
            ("f", "Z", "nothing", None, None, 6),
            ("g", "Z", "Alpha Review", ["3333-3333", "x"], None, 7),
            ("h", "Z", "no title", ["x", "y"], None, 8),
            ("i", "Z", "no title", None, ["y"], 9),
            ("j", "Z", "no title", ["1111-1111", "y"], None, 10),
            ("k", "A", "no title", ["y"], None, 99),
        ],
        SOURCE,
    )
    return journals, sources


def test_cascade(pair):
    journals, sources = pair
    got = {r.source_record_id: (r.method, r.journal_id) for r in matching.match_sources(sources, journals).collect()}
    assert got == {
        "a": ("identifier", "J1"),
        "b": ("identifier_conflict", None),
        "c": ("controlled_alias", "J1"),
        "d": ("conservative_normalized", "J4"),
        "e": ("ambiguous", None),
        "f": ("out_of_scope", None),
        "g": ("identifier", "J2"),
        # identifiers that earlier rows brought, in a chain; one of another entry; none before its time
        "h": ("identifier", "J2"),
        "i": ("identifier", "J2"),
        "j": ("identifier_conflict", None),
        "k": ("out_of_scope", None),
    }
    assert {r.source_record_id: (r.candidates, r.reasons) for r in matching.identifier_conflicts(matching.match_sources(sources, journals)).collect()} == {
        "b": (["J2", "J3"], ["identifier_conflict"]),
        "j": (["J1"], ["y"]),
    }
    later = matching.match_sources(sources, journals, index_order=["X", "Y", "Z"], order=["source_line"]).collect()
    assert {r.source_record_id: r.journal_id for r in later}["k"] == "J2"
    assert matching.match_sources(sources.limit(0), journals).count() == 0


def sequential(rows_, owners, titles):
    """The cascade, row by row."""
    owners = {k: list(v) for k, v in owners.items()}
    out = {}
    for rid, title, ids in rows_:
        known = [i for i in dict.fromkeys(ids) if i in owners]
        j = titles.get(title)
        if known:
            j = owners[known[0]][0] if len(owners[known[0]]) == 1 else None
        if j is not None and any(j not in owners[i] for i in known):
            j = None
        if j is not None:
            for i in ids:
                owners.setdefault(i, []) if i not in owners else None
                if j not in owners[i]:
                    owners[i].append(j)
        out[rid] = j
    return out


def test_matching_in_order_against_a_plain_walk(spark):
    rng = random.Random(1)
    journals = [(f"J{i}", f"T{i}", None, [f"o{i}", f"o{i % 3}"], None, None, 1) for i in range(6)]
    data = [(f"r{i:03d}", "X", f"T{rng.randint(0, 12)}", [f"n{rng.randint(0, 40)}" if rng.random() < 0.8 else f"o{rng.randint(0, 6)}" for _ in range(rng.randint(0, 3))], None, i) for i in range(70)]
    owners = {}
    for j in journals:
        for i in dict.fromkeys(j[3]):
            owners.setdefault(i, []).append(j[0])
    got = {r.source_record_id: r.journal_id for r in matching.match_sources(spark.createDataFrame(data, SOURCE), spark.createDataFrame(journals, CATALOG)).collect()}
    assert got == sequential([(d[0], d[2], d[3]) for d in data], owners, {f"T{i}": f"J{i}" for i in range(6)})


def test_aliases_of_sources(spark):
    journals = spark.createDataFrame([("J1", "Alpha", None, None, None, None, 1), ("J2", "Beta", None, None, None, None, 1)], CATALOG)
    fixed = spark.createDataFrame([("Old A", "J1"), ("Old B", "J2")], "alias string, journal_id string")
    src = spark.createDataFrame([("P", 1, "a", "ALPHA", ["old b", "Older"]), ("P", 2, "b", "beta", ["Older"]), ("Q", 3, "c", "none", ["zz"])], "index_name string, source_line int, source_record_id string, formal_title string, aliases array<string>")
    got = matching.aliases_of_sources(fixed, journals, src, "P", wanted=3)
    assert rows(got.select("key", "journal_id", "origin")) == [("old a", "J1", "fixed"), ("old b", "J1", "source"), ("older", "J2", "source")]
    with pytest.raises(ValueError):
        matching.aliases_of_sources(fixed, journals, src, "P", wanted=26)
    with pytest.raises(Exception, match="aliases of no entry"):
        matching.aliases_of_sources(fixed, journals, src, "Q").collect()


def test_audit_products(spark, pair):
    journals, sources = pair
    journals = journals.withColumn("source_catalogs", F.array(F.lit("X")))
    sources = sources.select("*", F.lit("v").alias("index_version"), F.lit("f").alias("source_file"), F.col("formal_title").alias("source_title"), F.array(F.lit("s"), "index_name").alias("subject_categories"))
    audit = matching.match_sources(sources, journals)
    assert {r.index_name: (r.total, r.matched, r.ambiguous) for r in matching.match_counts(audit).collect()} == {"X": (2, 1, 1), "Y": (3, 2, 1), "Z": (5, 3, 1), "A": (1, 0, 0)}
    assert rows(matching.pairwise_intersections(audit)) == [("A", "X", 0), ("A", "Y", 0), ("A", "Z", 0), ("X", "Y", 1), ("X", "Z", 0), ("Y", "Z", 0)]
    expected = spark.createDataFrame([(8, "Y"), (8, "X"), (9, "Z"), (1, "X")], "priority_level int, index_name string")
    gaps = matching.expected_gaps(journals, audit, expected)
    assert rows(gaps) == [("J3", "Z"), ("J4", "X")]
    assert rows(matching.full_audit(audit, gaps).filter("status = 'expected_but_unmatched'").select("source_record_id")) == [("EXPECTED:X:J4",), ("EXPECTED:Z:J3",)]
    bound = {r.journal_id: (r.records, r.indexes, r.new_indexes, r.categories) for r in matching.bind_memberships(audit, sources, journals).collect()}
    assert bound["J1"] == (2, ["X", "Y"], ["Y"], {"X": ["s", "X"], "Y": ["s", "Y"]}) and bound["J2"] == (3, ["Z"], ["Z"], {"Z": ["s", "Z"]})
    new = {r.source_record_id: r.new_index for r in matching.memberships(audit, sources.union(sources), journals).collect()}
    assert new == {"a": False, "c": True, "d": False, "g": True, "h": False, "i": False}


PAPER = """paper_id long, title string, journal_raw string, publication_year int, authors array<string>, publication_date string, citations int, downloads int,
topic_match_field string, matched_topic_fields array<string>, matched_search_groups array<string>"""


def paper(i, title, authors, cites=None, topic=None, fields=None, groups=None, year=2020):
    return (i, title, "J", year, authors, "2020", cites, None, topic, fields, groups)


def merged(spark, *papers):
    df = spark.createDataFrame(list(papers), PAPER)
    return {r.paper_id: (r.records, r.topic_match_field, r.matched_topic_fields, r.matched_search_groups) for r in dedup.merge_records(df, as_of_year=2026).collect()}


def test_merge_by_shared_authors(spark):
    got = merged(
        spark,
        paper(1, "A  title", ["Li"], topic=None, fields=["KY", ""], groups=["b"]),
        paper(2, "a Title", ["Wang", "ＬＩ"], cites=3, topic="KY", fields=["TI", "zz"], groups=["a", "b"]),
        paper(3, "a title", ["Zhao"]),
        paper(4, "a title", ["Li"], year=2021),
    )
    assert got == {2: (2, "KY", ["TI", "KY", "zz"], ["b", "a"]), 3: (1, None, [], []), 4: (1, None, [], [])}


def test_records_without_authors(spark):
    assert set(merged(spark, paper(1, "t", ["A"]), paper(2, "t", []), paper(3, "t", ["B"]))) == {1, 2, 3}
    one = merged(spark, paper(1, "t", None, cites=1), paper(2, "t", ["A"]), paper(3, "t", ["A"]))
    assert {k: v[0] for k, v in one.items()} == {2: 3}
    assert set(merged(spark, paper(1, "t", None), paper(2, "t", []))) == {1}


@pytest.mark.parametrize("most", [100_000, 10, 0])
def test_components_of_long_chains_and_any_order(spark, monkeypatch, most):
    monkeypatch.setattr(dedup, "MOST_LOCAL", most)
    chain = [(1, i, [f"a{i}", f"a{i + 1}"]) for i in range(40)] + [(1, 100, ["z"]), (2, 200, ["a1"]), (1, 300, []), (1, 301, None)]
    random.Random(1).shuffle(chain)
    got = {r.r: r.component for r in dedup.author_components(spark.createDataFrame(chain, "g int, r int, p array<string>"), "g", "r", "p").collect()}
    assert {got[i] for i in range(40)} == {0}
    assert (got[100], got[200], got[300], got[301]) == (100, 200, None, None)


def test_rank_order(spark):
    data = [(1, None, None, "TI", 1), (2, 3, None, None, 0), (3, 3, 2, "KY", 9), (4, 3, 2, "TI", 9), (5, 0, 1, "TI", 1), (6, 3, 0, "SU", None)]
    df = spark.createDataFrame(data, "paper_id int, priority_level int, ncs_internal_rank int, topic_match_field string, result_rank int")
    assert [r.paper_id for r in df.orderBy(*ranking.rank_order()).collect()] == [4, 3, 6, 2, 5, 1]


def test_scope_eligibility_is_never_null(spark):
    df = spark.createDataFrame([("J1", 4, ["X"]), (None, 4, ["X"]), ("J1", None, ["X"]), ("J1", 4, None), ("J9", 4, ["X"])], "journal_id string, priority_level int, index_memberships array<string>")
    got = ranking.split_by_scope(df, spark.createDataFrame([("J1",)], "journal_id string"), [4], "X")
    assert sorted(r.eligible for r in got.collect()) == [False] * 4 + [True]


def test_batches(spark):
    df = spark.createDataFrame([("g", f"j{i:02d}", f"Title {i:02d} " + "x" * 40) for i in range(30)], "g string, id string, t string")
    got = expressions.batches(df, ["g"], "t", ["id"], "wet", most_chars=400).orderBy("index").collect()
    assert [t for r in got for t in r.journals] == [f"Title {i:02d} " + "x" * 40 for i in range(30)]
    assert all(len(r.expression) <= 400 and r.total == len(got) for r in got)
    # no batch could have taken one more
    assert all(len(a.expression) + len(f" OR LY='{b.journals[0]}'") > 400 for a, b in zip(got, got[1:]))
    with pytest.raises(Exception, match="too long on its own"):
        expressions.batches(df, ["g"], "t", ["id"], "wet", most_chars=40).collect()


def test_expressions(spark):
    df = spark.createDataFrame([("TI %= 'a' AND LY='b'",), ("YE=2000 AND TI='x'",), ("plain words",), (None,)], "e string")
    assert [r[0] for r in df.select(expressions.is_expression(F.col("e"))).collect()] == [True, False, False, False]
    with pytest.raises(Exception, match="not a search value"):
        spark.createDataFrame([("o'clock",)], "e string").select(expressions.quoted(F.col("e"))).collect()
    with pytest.raises(ValueError):
        expressions.year_range(2020, None)
    with pytest.raises(ValueError):
        expressions.year_range(2021, 2020)
    assert expressions.year_range(2020, 2021) == (2020, 2021)


def test_plan_token_changes_with_any_part(spark):
    df = spark.createDataFrame([("g", 1, "e1"), ("g", 2, "e2")], "g string, index int, expression string").select("*", *expressions.identity("TI", "s", "v1", ("P", "p")))
    one = expressions.plan_token(df, ["g"]).first().token
    assert one == expressions.plan_token(df.repartition(3), ["g"]).first().token
    for part, other in (("page_size", F.lit(20)), ("scope_id", F.lit("t")), ("catalog_version", F.lit("v2")), ("topic_field", F.lit("SU")), ("source_category", F.lit(None).cast(df.schema["source_category"].dataType)), ("expression", F.lit("x"))):
        assert one != expressions.plan_token(df.withColumn(part, other), ["g"]).first().token, part
    mine = expressions.user_plan(spark, "SU %= 'a' AND LY='b'").first()
    assert (mine["index"], mine.total, mine.journals, mine.expression) == (1, 1, [], "SU %= 'a' AND LY='b'")
    for bad in ("YE=2000 AND TI='x'", "plain"):
        with pytest.raises(ValueError):
            expressions.user_plan(spark, bad)


def test_scheduler(spark):
    log = [(1, 1, 1, "challenge"), (1, 1, 2, "success"), (1, 2, 1, "network_error"), (1, 2, 2, "network_error"), (1, 2, 3, "success"), (1, 3, 1, "success"), (2, 1, 1, "no_results"), (3, 1, 1, "forbidden"), (3, 1, 2, "success")]
    got = {r.run: (r.completed, r.stopped_at, r.terminal_status) for r in control.run_outcomes(spark.createDataFrame(log, "run int, batch int, attempt int, status string"), ["run"]).collect()}
    assert got == {1: (1, 2, "network_error"), 2: (1, None, None), 3: (0, 1, "forbidden")}


def test_limit_counts_an_item_once(spark):
    items = [(1, b, x, q) for b, xs in enumerate([["a", "b"], ["a", "c"], ["d"], ["e"]], 1) for x in xs for q in (True,)]
    got = control.batches_until_limit(spark.createDataFrame(items, "run int, batch int, item string, q boolean"), ["run"], "batch", "item", "q", 3)
    assert rows(got) == [(1, 1, 2, 2), (1, 2, 1, 3)]


def test_gate_and_cache(spark):
    times = [(i, "k", "2024-01-01 00:00:%02d" % s) for i, s in enumerate([0, 1, 2, 30])]
    df = spark.createDataFrame(times, "i int, k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = [r.delay // 1_000_000 for r in control.gate_starts(df, ["k"], "t", ["i"]).orderBy("i").collect()]
    assert got == [0, 6, 6, 0] or got == [0, 5, 6, 0]
    days = spark.createDataFrame([(1, "k", 0), (2, "k", 80_000), (3, "k", 90_000), (4, "k", 176_399), (5, "k", 176_400), (6, "x", 1)], "i int, k string, s long")
    hits = control.cache_hits(days.withColumn("t", F.timestamp_seconds("s")), ["k"], "i", "t")
    assert {r.ident: r.hit for r in hits.collect()} == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False}


def test_storable_text(spark):
    kept = {"plain text": "plain", "a\u200bb": "ab", "": "", "see www.a.org": "see w", "file:x": "file:", "q:r": "q:r", "a < b": "a < b", "abcd  e": "abcd"}
    gone = ["see https://x.org", r"C:\temp\x", "c:/x", "<b>bold</b>", "a < b > c", "ly=abc", "su %= wetland", "Ye Between 1 and 2", "my cookie is", "~/x", "$HOME/x", "${home}/x", "%USERPROFILE%", "file:/etc/x", "F ile : c:/x", "/etc", "\\\\host", None]
    values = [*kept, *gone]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", control.storable_text(F.col("v"), 5).alias("o")).orderBy("i")
    assert [r.o for r in df.collect()] == [*kept.values(), *[None] * len(gone)]


def test_batches_of_a_checkpoint(spark):
    one = dict(title="T", journal_raw="J", publication_date="2020", document_type="期刊", source_database="CNKI", authors=["A"], publication_year=2020, citations=1, downloads=None, result_rank=0, is_online_first=False, formal=True)
    wrong = [dict(title="~/x"), dict(authors=["/x"]), dict(authors=None), dict(authors=["a", None]), dict(citations=-1), dict(result_rank=None), dict(document_type="图书"), dict(formal=False), dict(publication_year=1800), dict(is_online_first=None), dict(publication_date=None)]
    fine = [{}, dict(publication_year=None, formal=False), dict(title="", formal=False)]
    schema = "batch int, title string, journal_raw string, publication_date string, document_type string, source_database string, authors array<string>, publication_year int, citations int, downloads int, result_rank int, is_online_first boolean, formal boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    records = spark.createDataFrame([tuple((dict(batch=i) | one | x)[n] for n in names) for i, x in enumerate(wrong + fine)] + [tuple((dict(batch=0) | one)[n] for n in names)], schema)
    n = len(wrong + fine)
    results = [(i, "success", 5, 0) for i in range(n)] + [(90, "no_results", 0, 0), (91, "no_results", 1, 0), (92, "success", 1, 2), (93, "forbidden", 0, 0), (94, "success", None, 0)]
    got = control.valid_batches(spark.createDataFrame(results, "batch int, status string, total_rows int, excluded int"), records, ["batch"], as_of_year=2026)
    assert sorted(r.batch for r in got.collect()) == [*range(len(wrong), n), 90]


def test_checks(spark):
    df = spark.createDataFrame([(2, "b", None), (1, "a\"é", [1])], "id int, s string, l array<int>")
    assert [r[0] for r in df.select(checks.canonical_json(df.schema, df.columns)).collect()] == ['{"id":2,"l":null,"s":"b"}', '{"id":1,"l":[1],"s":"a\\"é"}']
    deep = spark.sql("select named_struct('b', array(named_struct('z', 1, 'a', map('y', 2, 'x', null))), 'a', cast(null as struct<q:int,p:int>)) as v")
    assert deep.select(checks.canonical_json(deep.schema, ["v"])).first()[0] == '{"v":{"a":null,"b":[{"a":{"x":null,"y":2},"z":1}]}}'
    one = checks.table_hash(df, "id").first()
    assert one == checks.table_hash(df.orderBy("id").repartition(3), "id").first()
    assert one.hash != checks.table_hash(df.withColumn("s", F.lit("c")), "id").first().hash
    with pytest.raises(ValueError):
        checks.reject_floats(spark.createDataFrame([(1.0,)], "x double"))
    assert checks.same_rows(df, df.repartition(2)) and not checks.same_rows(df, df.union(df))
    journals = spark.createDataFrame([("a", ["e1"], ["e3"]), ("b", None, ["e2"])], "journal_id string, evidence_ids array<string>, formal_title_evidence_ids array<string>")
    evidence, files = spark.createDataFrame([("e1",), ("e1",), ("e2",)], "evidence_id string"), spark.createDataFrame([("f",), ("g",)], "filename string")
    assert {r.check: r.failures for r in checks.bundle_checks(journals, evidence, files).collect()} == {"wrong_artifacts": 5, "repeated_artifacts": 0, "repeated_evidence": 1, "unknown_evidence": 1}


def test_scope_sizes(spark):
    found = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "scope_id string, journal_id string")
    assert rows(catalog.wrong_scope_sizes(found, {"a": 2, "b": 2, "c": 1})) == [("b", 1, 2), ("c", 0, 1)]


def test_cache_parts_and_results_that_are_not_stored(spark):
    rng = random.Random(6)
    data = [(i, rng.choice("ab"), rng.choice([0, 5_000]) + rng.randint(0, 300) * rng.choice([1, 7]), rng.random() < 0.7) for i in range(600)]
    df = spark.createDataFrame(data, "i int, k string, s long, ok boolean").withColumn("t", F.timestamp_seconds("s"))
    got = {r.ident: r.hit for r in control.cache_hits(df, ["k"], "i", "t", seconds=60, storable="ok").collect()}
    stored, wanted = {}, {}
    for i, k, s, ok in sorted(data, key=lambda d: (d[2], d[0])):
        wanted[i] = k in stored and s < stored[k] + 60
        if not wanted[i]:
            stored.pop(k, None)
            if ok:
                stored[k] = s
    assert got == wanted


def test_resumed_runs_and_limits(spark):
    log = [(1, 2, 1, "success"), (1, 3, 1, "challenge"), (1, 3, 2, "success"), (1, 4, 1, "success"), (2, 1, 1, "no_results"), (2, 2, 1, "forbidden"), (2, 3, 1, "success")]
    df = spark.createDataFrame(log, "run int, batch int, attempt int, status string")
    kept, stops = spark.createDataFrame([(1, 1)], "run int, batch int"), spark.createDataFrame([(1, 3), (1, 4), (2, 1), (2, 3)], "run int, batch int")
    got = {r.run: tuple(r)[1:] for r in control.run_outcomes(df, ["run"], kept, stops).collect()}
    assert got == {1: (3, 4, None, None, True, True), 2: (1, 3, 2, "forbidden", False, False)}


def test_hot_keys_join_without_shuffling_them(spark):
    data = spark.range(60_000).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")))
    by_key = common.materialize(data.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    got = common.join_by_counted_key(data, by_key, ["k"], "n")
    assert got.count() == 60_000 and got.filter("k = 0 and n = 20000").count() == 20_000
    assert common.join_by_counted_key(data.limit(0), by_key.limit(0), ["k"], "n").count() == 0


def test_group_search(spark):
    i = index(spark, (1, "Alpha", 1, "top", "S", None, 2), (2, "Beta", 2, "low", "S", None, None))
    papers = spark.createDataFrame(
        [paper(1, "x", ["A"], topic="KY"), paper(2, "X", ["a"], topic="TI", cites=2), paper(3, "y", ["B"], topic="TI")], PAPER
    ).withColumn("journal_raw", F.when(F.col("paper_id") == 3, "Beta").otherwise("The Alpha")).withColumn("result_rank", F.lit(1))
    got = search.group_search(papers, i, search.Policy("top"), limit=5, as_of_year=2026).collect()
    assert [(r.paper_id, r.journal_matched_title, r.topic_match_field) for r in got] == [(2, "Alpha", "KY")]
    with pytest.raises(ValueError):
        search.check_limit(True)


def test_throttle_waits_longer_after_a_challenge(spark):
    data = [(1, 0, True), (2, 1, False), (3, 2, False), (4, 1000, False)]
    df = spark.createDataFrame(data, "i int, s long, bad boolean").withColumn("t", F.timestamp_seconds("s")).withColumn("k", F.lit(1))
    got = {r.i: (r.start // 10**6, r.delay // 10**6) for r in control.throttled_starts(df, ["k"], "t", ["i"], "bad").collect()}
    assert got == {1: (0, 0), 2: (210, 209), 3: (240, 238), 4: (1000, 0)}


@pytest.mark.parametrize("span", [1, 7, 10_000])
def test_gates_do_not_depend_on_spans(spark, monkeypatch, span):
    monkeypatch.setattr(control, "SPAN_SECONDS", span)
    rng = random.Random(2)
    data = [(i, rng.choice(["a", "b", None]), rng.randint(0, 40) * rng.choice([1, 5]), rng.random() < 0.2) for i in range(60)]
    df = spark.createDataFrame(data, "i int, k string, s long, bad boolean").withColumn("t", F.timestamp_seconds("s"))
    gate = {r.i: (r.start // 10**6, r.delay // 10**6) for r in control.gate_starts(df, ["k"], "t", ["i"], 6).collect()}
    slow = {r.i: (r.start // 10**6, r.delay // 10**6) for r in control.throttled_starts(df, ["k"], "t", ["i"], "bad", 3, 9).collect()}
    for k in ("a", "b", None):
        free, ready = None, None
        for i, _, s, bad in sorted((d for d in data if d[1] == k), key=lambda d: (d[2], d[0])):
            start = s if free is None else max(s, free)
            assert gate[i] == (start, start - max(s, start if free is None else free - 6)), i
            free = start + 6
            start = s if ready is None else max(s, ready)
            assert slow[i] == (start, start - s)
            ready = start + 3 + (9 if bad else 0)


def test_top_papers_are_the_first_of_all(spark):
    i = index(spark, (1, "Alpha", 2, "g", "S", None, 2), (2, "Beta", 2, "g", "S", None, 1), (3, "Gamma", 1, "g", "S", None, None))
    rng = random.Random(4)
    data = [(n, rng.choice(["Alpha", "beta", "GAMMA", "The Beta", "other", None]), rng.choice(["TI", "KY", None]), rng.choice([None, 0, 1, 2])) for n in range(60)]
    df = spark.createDataFrame(data, "paper_id int, journal_raw string, topic_match_field string, result_rank int").withColumn("priority_level", F.lit("clash"))
    whole = [r.paper_id for r in ranking.top_ranked(ranking.annotate(df, i), 60).collect()]
    for k in (1, 15, 35, 60, 90):
        assert [r.paper_id for r in ranking.top_papers(df, i, k).collect()] == whole[:k]
    assert ranking.top_papers(df.limit(0), i, 3).count() == 0


def test_bounded_cache_against_a_plain_one(spark):
    rng = random.Random(5)
    data = [(i, rng.choice("abcdefgh"), i * rng.choice([1, 1, 3])) for i in range(400)]
    df = spark.createDataFrame(data, "i int, k string, s long").withColumn("t", F.timestamp_seconds("s"))
    got = {r.ident: r.hit for r in control.bounded_cache_hits(df, ["k"], "i", "t", seconds=20, entries=3).collect()}
    stored, used, wanted = {}, {}, {}
    for n, (i, k, s) in enumerate(sorted(data, key=lambda d: (d[2], d[0]))):
        for x in [x for x, at in stored.items() if s >= at + 20]:
            del stored[x]
        wanted[i] = k in stored
        stored.setdefault(k, s)
        used[k] = n
        while len(stored) > 3:
            del stored[min(stored, key=used.get)]
    assert got == wanted


class _Session:
    """A session as far as the scratch folder asks."""

    def __init__(self, named, master="local[2]"):
        self.conf = {"spark.checkpoint.dir": named} if named else {}
        self.sparkContext = self
        self.master = master

    def getCheckpointDir(self):
        return None


def test_scratch_goes_where_the_session_says(spark):
    assert common.scratch_dir(_Session("hdfs://x/y")) == "hdfs://x/y"
    assert os.path.isdir(common.scratch_dir(_Session(None)))
    with pytest.raises(ValueError):
        common.scratch_dir(_Session(None, "spark://host:7077"))
    written = common.materialize(spark.range(5))
    assert written.count() == 5 and os.path.isdir(written._scratch_path)
    common.release(written)
    assert not os.path.exists(written._scratch_path)
