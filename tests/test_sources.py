import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from bibliolake import __main__ as cli
from bibliolake.operators import catalog
from bibliolake.plans import search
from bibliolake.sources import files, lines, pages, render
from bibliolake.streaming import live


def texts(spark, *values):
    return spark.createDataFrame([(f"f{i}", v) for i, v in enumerate(values)], "path string, text string")


def test_blocks(spark):
    t = texts(spark, "x\n<!-- SOURCE_BEGIN: A.md -->\n one\n<!-- SOURCE_END: A.md -->\nmid<!-- SOURCE_BEGIN: B.md -->two<!-- SOURCE_END: B.md -->")
    assert rows(lines.source_blocks(t)) == [("f0", "A.md", "one"), ("f0", "B.md", "two")]
    for bad in ("<!-- SOURCE_BEGIN: A -->x", "<!-- SOURCE_BEGIN: A -->x<!-- SOURCE_END: A --><!-- SOURCE_BEGIN: A -->y<!-- SOURCE_END: A -->"):
        with pytest.raises(Exception, match="bad block marks"):
            lines.source_blocks(texts(spark, bad)).collect()


def test_bullets_and_numbers(spark):
    t = lines.lines(texts(spark, "* Early One\n## Big Six\n* **First** - 说明\n* Second (S2)\n## Other\n* Third"))
    got = lines.bullets(t, [("Big Six", 6, "six"), ("Other", 7, "seven")], (9, "none")).orderBy("line_no").collect()
    assert [(r.title, r.level, r.group) for r in got] == [("Early One", 9, "none"), ("First", 6, "six"), ("Second", 6, "six"), ("Third", 7, "seven")]
    n = lines.numbered(lines.lines(texts(spark, "### Cat A\n1. One\n2. Two.\n### Cat B\n1. One")))
    assert rows(n.select("title", "category")) == [("One", "Cat A"), ("One", "Cat B"), ("Two", "Cat A")]


def test_bold_spans(spark):
    t = lines.lines(texts(spark, "# PINNED\n* **A** and **系列 B**\n\n  * No bold (NB)\n**Not a bullet**\n*neither*\n# REST\n* **C (CC)**\n# PINNED\n* **D**"))
    got = lines.bold_spans(t, "PINNED", "REST", ["系列"])
    assert rows(got.select("title", "internal_rank")) == [("A", 1), ("C", 2), ("D", 2), ("No bold", 1)]
    for bad in ("# REST\n* **A**\n# PINNED", "# PINNED\n* **A**", "nothing"):
        with pytest.raises(Exception, match="no pinned region"):
            lines.bold_spans(lines.lines(texts(spark, bad)), "PINNED", "REST", []).collect()


def test_tables(spark):
    good = "text\n| no | title |\n|---|:---|\n| 1 | A \\| B |\n| 2 | C |\n\n| other |\n| --- |\n| x |\n\n| title | no |\n| --- | --- |\n| D | 3 |"
    t = lines.lines(texts(spark, good))
    got = lines.named_tables(t, ["no", "title"]).orderBy("line_no").collect()
    assert [(r.line_no, r.values["no"], r.values["title"]) for r in got] == [(4, "1", "A | B"), (5, "2", "C"), (13, "3", "D")]
    assert len({r.table_no for r in got}) == 2
    with pytest.raises(Exception, match="bad table row"):
        lines.named_tables(lines.lines(texts(spark, "| a | b |\n|---|---|\n| 1 |")), ["a"]).collect()
    with pytest.raises(ValueError):
        none = lines.lines(texts(spark, "no table"))
        lines.assert_tables(none, lines.named_tables(none, ["a"]))
    pos = lines.positional_table(lines.lines(texts(spark, "| 1 | A | art |\n| x | B | y |")))
    assert rows(pos.select("title", "subject")) == [("A", "art")]


def test_codes_reset_at_headings(spark):
    t = lines.lines(texts(spark, "### H1\n分类代码：`X1`。\n| a | b |\n|---|---|\n| 1 | 2 |\n### H2\n| a | b |\n|---|---|\n| 3 | 4 |"))
    got = {r["values"]["a"]: (r.heading, r.code) for r in lines.coded_tables(t, ["a"]).collect()}
    assert got == {"1": ("H1", "X1"), "3": ("H2", None)}


def test_display_titles_conflict(spark):
    good = spark.createDataFrame([("A b",), ("A b",)], "title string")
    assert rows(lines.display_titles(good, F.lower("title"))) == [("a b", "A b")]
    with pytest.raises(Exception, match="two titles"):
        lines.display_titles(spark.createDataFrame([("A b",), ("a B",)], "title string"), F.lower("title")).collect()


def test_read_texts_and_locate(spark, tmp_path):
    p = tmp_path / "x.md"
    p.write_bytes("\ufeffone\r\ntwo".encode())
    assert [r.line for r in lines.lines(lines.read_texts(spark, str(p))).orderBy("line_no").collect()] == ["one", "two"]
    assert lines.locate(None, "/nowhere", str(p)) == str(p)
    with pytest.raises(FileNotFoundError):
        lines.locate("/nowhere")


def test_index_csv(spark, tmp_path):
    p = tmp_path / "i.csv"
    head = ",".join(reversed(files.INDEX_COLUMNS))
    p.write_text("\ufeff" + head + '\nX | Y,EN,"line\none",P,,1111-1111,"A, one"\nZ,EN,Q,P,2222-2222,, b \n,,,,,,Wiley Interdisciplinary Reviews-Water\n')
    titles = spark.createDataFrame([("b", "Bee")], "key string, title string")
    got = files.read_index_csv(spark, str(p), "SSCI", "v", titles).orderBy("source_record_id").collect()
    assert [(r.source_record_id, r.source_line, r.source_title, r.formal_title, r.issn, r.eissn, r.subject_categories) for r in got] == [
        ("SSCI:00001", 3, "A, one", "A, one", ["1111-1111"], [], ["X", "Y"]),
        ("SSCI:00002", 4, "b", "Bee", [], ["2222-2222"], ["Z"]),
        ("SSCI:00003", 5, "Wiley Interdisciplinary Reviews-Water", "WIREs Water", [], [], []),
    ]
    for bad in ("a,b\n1,2\n", head + ",more\n", head + "\n,,,,,,  \n"):
        p.write_text(bad)
        with pytest.raises(Exception, match="other columns|no title"):
            files.read_index_csv(spark, str(p), "SSCI").collect()


def test_lists_with_classes(spark):
    t = texts(spark, "| 序号 | 期刊名称 | 学科名称 |\n|---|---|---|\n| 7 | 甲刊 | 法学 |")
    assert rows(lines.read_list(t).select("source_record_id", "source_line", "formal_title", "subject_categories")) == [("CSSCI:0007", 3, "甲刊", ["法学"])]
    with pytest.raises(ValueError):
        lines.read_list(texts(spark, "nothing"))
    table = "| 顺序 | 原目录序号 | 期刊名称 | 备注 |\n|---|---|---|---|\n"
    t = texts(spark, f"### H1\n分类代码：`X1`。\n{table}| 1 | 12 | 甲刊 | 原刊名：乙，丙 |\n### H2\n{table}| 2 | 13 | 丁刊 | 说明 |")
    got = lines.read_classed_list(t, "natural").select("source_record_id", "source_line", "aliases", "subject_categories")
    assert rows(got) == [("PKU_CORE:natural:0012", 5, ["乙，丙"], ["H1", "X1"]), ("PKU_CORE:natural:0013", 9, [], ["H2"])]
    with pytest.raises(Exception, match="no heading"):
        lines.read_classed_list(texts(spark, f"{table}| 1 | 2 | 甲 | |"), "n").collect()


def test_baseline(spark):
    one = "### L1\n| 序号 | 期刊名称 | 环境细分领域 | 正式证据 |\n|---|---|---|---|\n| 1 | Nature<br>内部顺序：2 | 水<br>— | 甲<br>乙 |\n| 2 | Science | — | |\n"
    two = "### L2\n| 序号 | 期刊ID | 基线题名 | 正式题名 |\n|---|---|---|---|\n| 1 | ENVJ-000009 | Cell | Cell!\u0020|\n"
    whole = f"# x\n| 序号 | 期刊名称 |\n|---|---|\n| 1 | no |\n## 四、十二级主目录\n{one}{two}## 附录一：x\n### L1\n"
    got = lines.read_baseline(texts(spark, whole), ["L1", "L2"], {"乙": "E2"}).orderBy("ordinal")
    assert [tuple(r)[1:] for r in got.collect()] == [
        (1, "ENVJ-000001", "Nature", 1, 2, ["水"], ["甲", "乙"], ["E2"]),
        (2, "ENVJ-000002", "Science", 1, None, [], [], []),
        (3, "ENVJ-000009", "Cell", 2, None, [], [], []),
    ]
    for bad, why in ((whole.replace("L2", "L9"), "unknown level"), (whole.replace(two, ""), "one for each level"), (whole.replace("## 附录一：x", ""), "no main directory"), (whole.replace("Science", "Nature"), "repeated"), (whole.replace("| 基线题名", "| 期刊名称"), "no baseline titles")):
        with pytest.raises(Exception, match=why):
            lines.read_baseline(texts(spark, bad), ["L1", "L2"]).collect()


@pytest.fixture()
def json_catalog(tmp_path):
    lists = "formal_title_evidence_ids issn eissn environment_subfields subject_categories formal_evidence evidence_ids source_memberships source_catalogs review_reasons".split()
    one = {x: [] for x in lists} | {x: {} for x in ("priority_decision", "index_subject_categories", "cnki_routing")} | {x: "1" for x in ("catalog_version", "catalog_date", "revision_date")}
    one |= {"journal_id": "J1", "formal_title": "Alpha", "aliases": ["Al"], "priority_level": 1, "priority_group": "level_01", "index_memberships": ["X"], "manual_review_required": False}
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"journals": [one, one | {"journal_id": "J2", "formal_title": "Beta|x"}]}, indent=1))
    return p


def test_json_catalog_and_outputs(spark, json_catalog, tmp_path):
    c = files.read_catalog_json(spark, str(json_catalog))
    assert c.count() == 2
    out = render.catalog_text(c, "v1")
    assert "| 2 | Beta\\|x | J2 |" in out and out == render.catalog_text(c.repartition(3), "v1")
    files.write_jsonl(c, str(tmp_path / "out"), "journal_id")
    assert [json.loads(r.value)["journal_id"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["J1", "J2"]
    snap = files.snapshot(spark, [str(json_catalog)])
    assert files.different_files(snap, snap).count() == 0
    good = json_catalog.read_text()
    for old, new in (('"priority_level": 1', '"priority_level": "x"'), ('"review_reasons": []', '"review_reasons": null'), ('"cnki_routing"', '"other"')):
        json_catalog.write_text(good.replace(old, new))
        with pytest.raises(Exception):
            files.read_catalog_json(spark, str(json_catalog)).collect()


def test_command_line(spark, json_catalog, capsys):
    assert cli.main(["lookup", str(json_catalog), "alpha", "AL", "none"]) == 0
    got = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [(x["status"], x["match_method"]) for x in got] == [("matched", "formal_title_exact"), ("ambiguous", None), ("unmatched", None)]
    assert cli.main(["validate", str(json_catalog)]) == 0
    assert cli.main(["validate", "/nowhere.json"]) == 1


def test_whole_writes(tmp_path):
    paths = [str(tmp_path / "a" / "x"), str(tmp_path / "b" / "x")]
    files.write_mirrors(paths, b"one")
    files.write_mirrors(paths, b"one", check=True)
    with pytest.raises(ValueError):
        files.write_mirrors(paths, b"two", check=True)
    assert open(paths[0], "rb").read() == b"one"
    text = files.self_hashed('{"h":"' + "0" * 64 + '","v":1}')
    assert files.holds_self_hash(text, json.loads(text)["h"]) and not files.holds_self_hash(text + " ", json.loads(text)["h"])


PAGE = """<table class="result-table-list"><tr><td class="seq">1</td><td class="name"><a>Supply <em>Chain</em> Finance</a><b>网络首发</b></td><td class="author"><a>A</a><a>B</a></td>
<td class="source"><a>J 1</a></td><td class="date">2026-07-20</td><td class="data">期刊</td><td class="quote">1,024</td><td class="download"></td></tr>
<tr><td class="name"><a>Open</a><td class="source"><a>J2</a><table><tr><td class="name">inner</td></tr></table><td class="data">期刊
<tr><td class="name"><a>Book</a></td><td class="data">图书</td></tr><tr><td></td></tr></table>"""


def test_pages(spark):
    assert pages.read_page("<p>nothing</p>") == ("empty", [])
    assert pages.read_page(None) == ("empty", [])
    layout = "<table><tr><td><table class='x result-table-list'><tr><td class='name'><a>In</a> out <a>side</a><td class='name'></td><td class='data'>期刊</table></td></tr></table>"
    assert pages.read_page(layout)[0] == "table_without_rows"  # a last row that nothing ends
    again = layout + "<table class='result-table-list'><tr><td class='source'><a>J</a></td></tr></table>"
    assert [(r["title"], r["journal"], r["document_type"]) for r in pages.read_page(again)[1]] == [("", "", "期刊"), ("", "J", "")]
    assert pages.read_page("题名 来源")[0] == "heading_without_table"
    assert pages.read_page('<table class="result-table-list"></table>')[0] == "table_without_rows"
    df = spark.createDataFrame([(1, PAGE), (2, None)], "page_id int, html string")
    got = pages.parse_pages(df, "page_id", "html").orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.pos, r.title, r.authors, r.journal_raw, r.publication_year, r.citations, r.downloads, r.result_rank, r.is_online_first) for r in got] == [
        (1, 1, "Supply Chain Finance", ["A", "B"], "J 1", 2026, 1024, None, 1, True),
        (1, 2, "Open", [], "J2", None, None, None, 0, False),
        (1, 3, "Book", [], "", None, None, None, 0, False),
        (2, None, None, None, None, None, None, None, None, None),
    ]


def test_public_search_and_stream(spark, tmp_path):
    entry = spark.createDataFrame([(1, "J 1", 1, "g", "S", None, None)], "ordinal int, title string, level int, group string, source string, subject string, internal_rank int")
    index = catalog.build_index(entry)
    df = spark.createDataFrame([(1, PAGE)], "page_id int, html string")
    got = search.public_search(df, index, limit=20, as_of_year=2026).collect()
    assert [(r.title, r.bucket, r.journal_match_status) for r in got] == [("Supply Chain Finance", "complete", "matched"), ("Open", "incomplete", "unmatched")]
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "j 1"), (2, "x")], "q int, j string").write.parquet(source)
    for _ in range(2):  # the second run finds nothing new and changes nothing
        stream = spark.readStream.schema("q int, j string").parquet(source)
        live.lookups(stream, "q", "j", index, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert rows(out.select("q", "status")) == [(1, "matched"), (2, "unmatched")]


def test_served_requests(spark):
    """Second attempts, pages of another format, results that are stored or not, and answers of the cache."""
    day = "2026-01-0%d 00:00:00"
    empty = "<table class='result-table-list'></table>"
    asked = [(1, "A  b", 20, day % 1, [("network_error", None), ("success", PAGE)]), (2, "a B", 20, day % 1, []), (3, "a b", 5, day % 1, [("forbidden", None)]), (4, "c", 20, day % 1, [("network_error", None)] * 2),
             (5, "c", 20, day % 1, [("no_results", None)]), (6, "c", 20, day % 1, []), (7, "d", 20, day % 1, [("success", empty)]), (8, "d", 99, day % 1, [("success", PAGE)]), (9, "a b", 20, day % 3, [("success", "<p>"), ("success", PAGE)])]
    requests = spark.createDataFrame([a[:4] for a in asked], "request_id int, query string, row_limit int, requested_at string").withColumn("requested_at", F.col("requested_at").cast("timestamp"))
    attempts = spark.createDataFrame([(a[0], n, *x) for a in asked for n, x in enumerate(a[4], 1)], "request_id int, attempt int, state string, html string")
    got = {r.request_id: tuple(r)[1:] for r in search.served_requests(requests, attempts, as_of_year=2026).collect()}
    assert got == {
        1: ("partial", False, 1, 1, 1), 2: ("partial", True, 1, 1, 1), 3: ("forbidden", False, 0, 0, 0), 4: ("network_error", False, 0, 0, 0), 5: ("no_results", False, 0, 0, 0),
        6: ("no_results", True, 0, 0, 0), 7: ("page_contract_changed", False, 0, 0, 0), 8: ("configuration_error", False, 0, 0, 0), 9: ("no_results", False, 0, 0, 0),
    }
    found = spark.createDataFrame([("complete",), ("incomplete",)], "bucket string")
    outcome = search.expression_outcome
    assert [outcome(found), outcome(found.filter("bucket = 'complete'")), outcome(found.limit(0)), outcome(found, stopped="forbidden"), outcome(found.limit(0), stopped="forbidden")] == ["partial", "success", "no_results", "partial", "forbidden"]


def test_checkpoint(spark, tmp_path):
    done = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "batch int, title string")
    search.save_checkpoint(done, str(tmp_path / "c"), "t1")
    got = search.load_checkpoint(spark, str(tmp_path / "c"), "t1", F.col("title").isNotNull())
    assert rows(got.select("batch", "title")) == [(2, "b")]
    assert search.load_checkpoint(spark, str(tmp_path / "c"), "t2", F.lit(True)).count() == 0
    plans = spark.createDataFrame([(1,), (2,), (3,)], "index int")
    assert rows(search.remaining(plans, got)) == [(1,), (3,)]


def test_structure(spark):
    head = 'catalog_version: "v1"\n  - level: 1\n    group: "a"\n  - level: 2\n    group: "b"\n<!-- SOURCE_BEGIN: A -->x<!-- SOURCE_END: A -->'
    wanted = dict(levels=[1, 2], groups=["a", "b"], version="v1", blocks=["A"])
    assert lines.check_structure(texts(spark, head), **wanted).count() == 0
    wrong = lines.check_structure(texts(spark, head.replace("level: 2", "level: 3"), "nothing"), **wanted)
    assert rows(wrong) == [("f0", "levels"), ("f1", "blocks"), ("f1", "groups"), ("f1", "levels"), ("f1", "version")]
