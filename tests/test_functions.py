"""Column expressions against plain readings of their rules."""

import datetime
import random
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bibliolake.functions import clean, keys, text


def column(spark, values, expr):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


WORDS = ["The Theory", "A.B & C", "ＡＢ　ｃ", "Straße: Ümlaut", "经济学（季刊）", "ﬁne-ﬂow", "  the x ", "", None, "Á b", "K-factor", "中文, 标题/副题", "e\u0301tude"]


def fold(v):
    return unicodedata.normalize("NFKC", v).casefold()


@pytest.mark.parametrize(
    "expr,plain",
    [
        (text.nfkc, lambda v: unicodedata.normalize("NFKC", v)),
        (keys.title_key, lambda v: re.sub("[^0-9a-z一-鿿]+", "", fold(v).replace("&", " and "))),
        (keys.exact_key, lambda v: unicodedata.normalize("NFKC", v).strip().casefold()),
        (keys.work_key, lambda v: " ".join(v.split()).casefold()),
        (keys.person_key, lambda v: "".join(c for c in fold(v) if unicodedata.category(c)[0] in "LN")),
        (clean.query_text, lambda v: " ".join(unicodedata.normalize("NFKC", v).split())),
    ],
)
def test_keys(spark, expr, plain):
    assert column(spark, WORDS, expr) == [None if v is None else plain(v) for v in WORDS]


def test_the_is_cut_even_inside_a_word(spark):
    assert column(spark, ["Theory", "the", "The A"], lambda c: keys.signatures(c)[0]) == ["ory", "the", "a"]


def test_dotted_key_tells_titles_apart(spark):
    assert column(spark, ["A.B", "AB"], keys.title_key) == ["ab", "ab"]
    assert column(spark, ["A.B", "AB"], keys.dotted_key) == ["a.b", "ab"]


def test_spelling_key(spark):
    assert column(spark, ["The Arts & Media: A-Z", "Arts and Media (A/Z)"], keys.spelling_key) == ["arts and media a z"] * 2


def test_lookup_keys_need_two_characters(spark):
    assert column(spark, ["A", "A.B"], keys.lookup_keys) == [[], ["ab", "a.b"]]


def plain_year(v):
    """The first year with no letter or digit before and no digit or 年 behind it; then word by word."""
    signs = "-/:年"

    def written(c):
        return c in signs or (c.isascii() and c.isalnum())

    def begins_time(w):
        return w[:1] in ("-", "/", ":") or w[1:2] == ":" and w[:1].isdigit() or w[2:3] == ":" and w[:2].isdigit()

    for i in range(len(v) - 3):
        year, before, behind = v[i : i + 4], v[i - 1 : i], v[i + 4 : i + 5]
        if year.isdigit() and year[:2] in ("19", "20") and not (before.isascii() and before.isalnum()) and not behind.isdigit() and behind != "年":
            break
    else:
        return None
    words, at = [], i
    while at < len(v) and written(v[at]):
        end = next((k for k in range(at, len(v)) if not written(v[k])), len(v))
        words.append(v[at:end])
        at = next((k for k in range(end, len(v)) if not v[k].isspace()), len(v)) if v[end : end + 1].isspace() else len(v)
    date, time, more = [*words, "", "", ""][:3]
    separators = {c for c in date if not c.isdigit()}
    parts = re.split("[-/]", date)
    if len(separators) > 1 or separators - {"-", "/"} or len(parts) > 3 or any(not 1 <= len(p) <= 2 for p in parts[1:]):
        return None
    try:
        datetime.date(*[int(p) for p in [*parts, "1", "1"][:3]])
    except ValueError:
        return None
    if begins_time(time):
        clock = time.split(":")
        if len(clock) not in (2, 3) or not all(x.isdigit() for x in clock) or not 1 <= len(clock[0]) <= 2 or any(len(x) != 2 or int(x) > 59 for x in clock[1:]) or int(clock[0]) > 23 or begins_time(more):
            return None
    return int(year)


YEARS = {
    "2026": 2026, "2026-07": 2026, "2026-07-20 10:20": 2026, "Published: 2026/07/20 10:20:30": 2026, "2026-13-40": None, "2026-07-20 24:00": None,
    "2026年07月": None, "1899": None, "2100": None, "bad 2026--01": None, "abc2026def": None, "": None, "2026-02-30": None, "2026/07-01": None, "20260": None,
}


def test_years(spark):
    assert column(spark, list(YEARS), clean.publication_year) == list(YEARS.values())


def test_years_against_another_reading(spark):
    rng = random.Random(3)
    parts = ["2014", "1999", "20", "-", "/", "07", "31", "2", " ", "10:20", ":30", "年", "x", "24:00", ",", "13"]
    values = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    assert column(spark, values, clean.publication_year) == [plain_year(v) for v in values]


def test_counts(spark):
    assert column(spark, ["1,024", "3，204", "1 234", "", "-1", "x", None], clean.count_of) == [1024, 3204, 1234, None, None, None, None]


def test_list_titles(spark):
    given_ = ["1. **Nature** - 自然杂志（周刊）", "* **A (B)**；", "Science (AAAS) - 科学", "2. Plain, title."]
    assert column(spark, given_, clean.list_title) == ["Nature", "A (B)", "Science", "Plain, title"]
    assert column(spark, ["* Journal of X (JX)", "* 经济学（季刊）"], clean.catalog_title) == ["Journal of X", "经济学（季刊）"]


def test_display(spark):
    assert column(spark, ["中国科学（网络首发）", "A [网络首发]", "网络首发刊", None], clean.display_title) == ["中国科学", "A", "网络首发刊", None]


def test_variants(spark):
    assert column(spark, ["经济学(季刊)", "A"], clean.name_variants) == [["经济学(季刊)", "经济学（季刊）"], ["A"]]


def test_cells(spark):
    assert column(spark, ["a|b\nc", "", None], clean.table_cell) == ["a\\|b<br>c", "—", "—"]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aＡﬁ①é\u0301 ½中⼦ßİ\x00\u200b", max_size=8), min_size=1, max_size=20))
def test_nfkc_is_exact(spark, values):
    assert column(spark, values, text.nfkc) == [unicodedata.normalize("NFKC", v) for v in values]


def test_title_cells(spark):
    cells = ["Nature<br>内部顺序：3<br>x", "A <br> —", "B<br>内部顺序：x"]
    assert column(spark, cells, clean.main_title) == ["Nature", "A", "B"]
    assert column(spark, cells, clean.internal_rank) == [3, None, None]
    assert column(spark, ["原刊名： 甲，乙", "甲", None], clean.original_titles) == [["甲，乙"], [], []]
    assert column(spark, ["Zeitschrift fur Geomorphologie", "X", None], clean.rewritten_title) == ["Zeitschrift für Geomorphologie", "X", None]
    with pytest.raises(Exception, match="a title is empty"):
        column(spark, ["—"], clean.main_title)


def test_ordered_strings(spark):
    df = spark.createDataFrame([(["（B", "(C", "（B", None],), (["b", "a"],), ([],), (None,)], "v array<string>")
    assert [r[0] for r in df.select(clean.ordered_strings(F.col("v"))).collect()] == [["（B", "(C"], ["a", "b"], [], None]
