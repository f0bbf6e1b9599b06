"""Fusion, reference lists, linkage, copies, top N."""

import os
import random
from collections import Counter, defaultdict

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bibliolake import common
from bibliolake.llm import copies, fusion, linkage, mixing, queries, reflist, topn

SF = "/root/testdata/sf0.001"

# fusion

RECORD = "paper_id long, a int, l array<string>, at timestamp, doubt boolean, src string, value string"


def fused(spark, groups, records):
    g = spark.createDataFrame(groups, "g long, paper_id long")
    r = spark.createDataFrame(records, RECORD.replace("at timestamp", "at string")).withColumn("at", F.col("at").cast("timestamp"))
    claims = fusion.claims_of(g, r, group="g", key="paper_id", counts=["a"], lists=["l"], seen="at", doubtful="doubt", source=F.col("src"))
    return {(x.g, x.field): (x.record, x.value, x.is_full, x.full_records) for x in fusion.fuse(claims).collect()}


def plain_full(groups, records):
    """The statement of the problem, read plainly."""
    by = {r[0]: r for r in records}
    out = defaultdict(set)
    members = defaultdict(set)
    for g, p in groups:
        if g is not None and p in by:
            members[g].add(p)
    for g, ps in members.items():
        for field in ("a", "l"):
            own = {}
            for p in ps:
                r = by[p]
                v = r[1] if field == "a" else frozenset(x.strip() for x in r[2] or [] if x and x.strip())
                if (field == "a" and v is not None and v >= 0) or (field == "l" and v):
                    own[p] = (v, r[3] or "", r[4] is False)
            if own:
                late, sure = max(x[1] for x in own.values()), any(x[2] for x in own.values())
                union = frozenset().union(*[x[0] for x in own.values()]) if field == "l" else None
                out[g, field] = {p for p, x in own.items() if x[1] == late and (x[2] or not sure) and (field == "a" or x[0] == union)}
    return out


def test_full_records_against_plain_reading(spark):
    rng = random.Random(4)
    records = [
        (i, rng.choice([None, -1, 0, 3, 7]), rng.choice([None, [], [" "], ["x"], ["x ", "y"], ["y", "x", "x"], ["z", None]]), rng.choice([None, "2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-03 00:00:00"]),
         rng.choice([True, False, None]), rng.choice(["s1", "s2", None]), "clash")
        for i in range(400)
    ]
    groups = [(rng.randint(1, 120), i) for i in range(400)]
    groups += groups[:50] + [(None, 3), (5, None), (5, 99_999)]
    got = fused(spark, groups, records)
    wanted = plain_full(groups, records)
    assert set(got) == set(wanted)
    for k, full in wanted.items():
        assert got[k][3] == len(full), k
        if len(full) == 1:
            assert got[k][0] in full and got[k][2]


def test_votes_decide_between_equals(spark):
    at = "2024-01-01 00:00:00"
    records = [(1, 5, None, at, False, "s1", "x"), (2, 7, None, at, False, "s2", "x"), (3, 7, None, at, False, "s3", "x")]
    assert fused(spark, [(1, 1), (1, 2), (1, 3)], records)[1, "a"][:2] == (2, "7")


def test_copied_false_votes_lose(spark, monkeypatch):
    """Three sources of which two copy the third, errors included, against two independent ones."""
    at = "2024-01-01 00:00:00"
    groups, records = [], []

    def put(g, source, value):
        records.append((len(records), value, None, at, False, source, "x"))
        groups.append((g, len(records) - 1))

    for g in range(120):
        wrong = g % 5 < 1
        for s in ("s1", "s2", "s3", "s4") if g < 100 else ("s1", "s2"):
            put(g, s, 1000 + g)
        for c in ("c1", "c2", "c3"):
            put(g, c, 2000 + g if wrong or g >= 100 else 1000 + g)
    got = {k[0]: v[1] for k, v in fused(spark, groups, records).items()}
    assert got == {g: str(1000 + g) for g in range(120)}
    monkeypatch.setattr(fusion, "COPY_RATE", 1e-9)
    monkeypatch.setattr(fusion, "COPY_PRIOR", 1e-9)
    alone = {k[0]: v[1] for k, v in fused(spark, groups, records).items()}
    assert sum(alone[g] == str(2000 + g) for g in range(100, 120)) > 10


def test_votes_overrule_a_criterion_and_learned_odds_follow_the_data(spark):
    """Four independent sources outweigh one that is later; how much later says is learned."""
    early, late = "2024-01-01 00:00:00", "2024-06-01 00:00:00"
    records, groups = [], []
    for g in range(40):
        for i, (s, v, t) in enumerate([("a", 7, early), ("b", 7, early), ("c", 7, early), ("d", 7, early), ("e", 8, late)] if g % 2 else [("a", 7, late), ("b", 9, early), ("c", 7, late)]):
            records.append((g * 10 + i, v, None, t, False, s, "x"))
            groups.append((g, g * 10 + i))
    got = fused(spark, groups, records)
    assert {got[g, "a"][1] for g in range(40)} == {"7"} and not got[1, "a"][2] and got[0, "a"][2]


def test_dependence_and_votes(spark):
    """Sources that share unlikely values come out as dependent, and count less together."""
    stats = spark.createDataFrame([(["a", "d"], 54.0, 60), (["b", "c"], 6.0, 60)], "codes array<string>, true double, n long")
    met = spark.createDataFrame([(["a", "b", "c", "d"], 60)], "codes array<string>, n long")
    accuracy = fusion.accuracies(stats)
    known = {r.source: r.accuracy for r in accuracy.collect()}
    assert known["a"] == known["d"] > 0.8 > 0.3 > known["b"]
    copied = fusion.copying(stats, met, accuracy)
    known = {(r.a, r.b): r.copies for r in copied.collect()}
    assert known["b", "c"] > 0.9 > 0.1 > known["a", "b"]
    same = spark.createDataFrame([("a", 0.8), ("b", 0.8), ("c", 0.8)], "source string, accuracy double")
    sets = spark.createDataFrame([(["a", "b"],), (["a", "c"],), (["a"],)], "codes array<string>")
    tied = spark.createDataFrame([("a", "b", 1.0)], "a string, b string, copies double")
    got = {tuple(r.codes): r.votes for r in fusion.votes(sets, same, tied).collect()}
    assert got[("a",)] < got[("a", "b")] < got[("a", "c")] and abs(got[("a", "c")] - 2 * got[("a",)]) < 1e-9 and abs(got[("a", "b")] - 1.2 * got[("a",)]) < 1e-9


def test_fusion_edges(spark):
    assert fused(spark, [(1, 1)], [(1, None, None, None, None, None, "x")]) == {}
    assert fused(spark, [(1, 1)], [(1, 4, None, None, None, None, "x")]) == {(1, "a"): (1, "4", True, 1)}
    empty = spark.createDataFrame([], "g long, field string, value string, entries array<string>, record long, at timestamp, trusted boolean, source string")
    assert fusion.fuse(empty).count() == 0


def test_one_hot_group(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_PARTS", 2)
    records = [(i, i % 7, ["x"], f"2024-01-01 00:{i // 60 % 60:02d}:{i % 60:02d}", False, f"s{i % 60}", "c") for i in range(1500)]
    groups = [(0 if i % 3 == 0 else i, i) for i in range(1500)]
    got = fused(spark, groups, records)
    wanted = plain_full(groups, records)
    assert all(got[k][3] == len(v) and (len(v) != 1 or got[k][0] in v) for k, v in wanted.items())


# reference lists

LIST = [
    ("J1", "Annals of Dralbura Pollen Sociology", ["Ann Dral Poll Soci", "德拉布学报"]),
    ("J2", "The Mondravia Report on Tundra & Safety", None),
    ("J3", "岚丘积雪气候杂志", ["《岚丘文摘12》", None, ""]),
    ("J4", "Studies in Rimkith Karst Zoology", []),
    ("J5", "Studies in Rimkith Karst Ecology", []),
]
MEANT = {
    "Annals of Dralbura Pollen Sociology": "J1", "ANNALS DRALBURA POLLEN SOCIOLOGY, 2019, 39(6)": "J1", "In: Annals of Dralbura Polen Socilogy": "J1",
    "Dralbura Pollen Sociology, Annals of": "J1", "ann. dral. poll. soci.": "J1", "Ann. Dralb. Pollen Sociol.": "J1", "德拉布学报 Annals of Dralbura Pollen Sociology": "J1",
    "Thhe Mondravia Report on Tundra and Safety": "J2", "mondravia-report-on-tundra-and-safety [2009]": "J2", "The Mоndravia Report on Tundra & Safety. ISSN 1234-567X": "J2",
    "刊名：岚丘积雪气候杂志（网络版）": "J3", "岚 丘 积 雪 气 候 杂 志": "J3", "岚丘积积雪气候杂志": "J3", "岚丘雪积气候杂志": "J3", "岚丘文摘12": "J3", "岚丘积雪气候杂志杂志社": "J3",
    "Studies in Rimkith Karst Zoologgy": "J4", "岚丘文摘13": "none", "岚山积雪气候杂志": "none", "Annals of Dralbura Pollen Optics": "none", "Studies in Rimkith Tundra Zoology": "none",
    "": "none", "  ": "none", "unknown": "none", "期刊": "none", "-": "none",
}


def test_typed_values(spark):
    ref = spark.createDataFrame([*[(*x, 1) for x in LIST], (None, "x", None, 1), ("J9", None, None, 1)], "jid string, title string, aliases array<string>, entry int")
    asked = spark.createDataFrame([*enumerate(MEANT), (1000, None), (0, list(MEANT)[0])], "id long, v string").withColumn("level", F.lit("clash"))
    got = reflist.map_to_list(asked, "id", "v", ref, "jid", "title", "aliases").collect()
    assert len(got) == len(MEANT) + 2
    for r in got:
        assert r.entry == ("none" if r.v is None else MEANT[r.v]), r.v
    assert reflist.map_to_list(asked.limit(0), "id", "v", ref, "jid", "title", "aliases").count() == 0
    assert {r.entry for r in reflist.map_to_list(asked, "id", "v", ref.limit(0), "jid", "title", "aliases").collect()} == {"none"}


def test_ties_are_reported_and_all_near_entries_come_out(spark, monkeypatch):
    ref = spark.createDataFrame([*LIST, ("J6", "Studies in Rimkith Karst Zoologe", None), ("J7", "Vela Notes", ["Same Name"]), ("J8", "Same name", None)], "jid string, title string, aliases array<string>")
    asked = spark.createDataFrame([(1, "Same Name"), (2, "Studies in Rimkith Karst Zoologyy"), (3, None), (4, "nothing near"), (1, "Same Name")], "id long, v string")
    for most in (100, 3):
        monkeypatch.setattr(reflist, "BLOCK_ENTRIES", most)
        got = {(r.id, r.entry, tuple(r.candidates or ())) for r in reflist.map_to_list(asked, "id", "v", ref, "jid", "title", "aliases").collect()}
        assert got == {(1, "none", ("J7", "J8")), (2, "J4", ("J4",)), (3, "none", ()), (4, "none", ())}
        near = rows(reflist.near_entries(asked, "v", ref, "jid", "title", "aliases"))
        assert near == [("Same Name", "J7", 0), ("Same Name", "J8", 0), ("Studies in Rimkith Karst Zoologyy", "J4", 1), ("Studies in Rimkith Karst Zoologyy", "J6", 2)]


def test_a_pass_builds_one_trie(spark, monkeypatch):
    """A list in blocks: each block's trie is used in a pass of its own."""
    ref = spark.createDataFrame(LIST, "jid string, title string, aliases array<string>")
    monkeypatch.setattr(reflist, "BLOCK_ENTRIES", 2)
    asked = spark.createDataFrame([(i, v) for i, v in enumerate(list(MEANT) * 3)], "id long, v string")
    plan = reflist.map_to_list(asked, "id", "v", ref, "jid", "title", "aliases")._jdf.queryExecution().toString()
    assert "match(" not in plan  # the finds of all passes are read from scratch


def test_known_words_and_forms_are_those_of_the_whole_list(spark, monkeypatch):
    # every two entries apart in some split: one near "... Karst Zoology" and ones that know "Geology"; a form of a value that is an entry itself
    ref = [("J1", "Studies in Rimkith Karst Zoology", None), ("J7", "Letters on Geology", []), *LIST[:3], ("J8", "Vela Notes", None), ("J9", "Vela Notes (Online)", None)]
    ref = spark.createDataFrame(ref, "jid string, title string, aliases array<string>")
    values = ["Studies in Rimkith Karst Geology", "Studies in Rimkith Karst Zoologgy", "Vela Notes (Online)", "Vela Notes", *MEANT]
    asked = spark.createDataFrame(list(enumerate(values)), "id long, v string")
    whole = rows(reflist.map_to_list(asked, "id", "v", ref, "jid", "title", "aliases"))
    assert [r[2] for r in sorted(whole)[:4]] == ["none", "J1", "J9", "J8"]
    for most in (2,):
        monkeypatch.setattr(reflist, "BLOCK_ENTRIES", most)
        assert rows(reflist.map_to_list(asked, "id", "v", ref, "jid", "title", "aliases")) == whole


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=8), st.text("abcd", min_size=1, max_size=6), st.integers(0, 2), st.booleans())
def test_automaton_against_distances(names, asked, most, replace):
    e = reflist.Entries([])
    for n in names:
        e._path(n, n, ())
    got = {p: k for k, p, _ in e.within(asked, most, replace)}
    wanted = {n: d for n in names if (d := linkage._edits(asked, n, most, replace)) <= most}
    assert got == wanted


# linkage


def test_identifiers():
    assert linkage.clean_identifier("eISSN 0317-847１") == "03178471" and linkage.clean_identifier("n/a") == linkage.clean_identifier(None) == ""
    assert linkage.valid_identifier("03178471") and not linkage.valid_identifier("03178472")
    assert "03178471" in linkage.corrections("03178472") and "03178471" in linkage.corrections("0317847") and "03178471" in linkage.corrections("03718471")


def _number(n):
    s = f"{n:07d}"
    c = -sum((8 - i) * int(d) for i, d in enumerate(s)) % 11
    return f"{s[:4]}-{s[4:]}{'X' if c == 10 else c}"


RECORDS = "rid string, idx string, t string, f string, al array<string>, p array<string>, e array<string>, pub string, left string"
LINK = dict(key="rid", source="idx", title="t", formal_title="f", aliases="al", issn="p", eissn="e", publisher="pub")


def _journals(n, seed):
    rng = random.Random(seed)
    topics, fields, kinds = ["Karst", "Tundra", "Canopy", "Dune", "Lagoon", "Peat"], ["Law", "Botany", "Health", "Optics", "Zoology"], ["Annals of", "Studies in", "Journal of", "Letters on"]
    data, truth = [], {}
    for j in range(n):
        place = "".join(rng.choice("bdgklmnprstv") + rng.choice("aeiou") for _ in range(4)).capitalize()
        t = f"{rng.choice(kinds)} {place} {rng.choice(topics)} {rng.choice(fields)}"
        house = f"House {rng.randint(1, 40)}"
        for x in ("A", "B", "C"):
            if rng.random() < 0.8:
                own = t.upper() if rng.random() < 0.2 else t.replace("a", "aa", 1) if rng.random() < 0.1 else t
                rid = f"{x}:{j}"
                data.append((rid, x, own, own, None, [_number(j * 13 + 5)] if rng.random() < 0.8 else None, [], house if rng.random() < 0.8 else None, "clash"))
                truth[rid] = j
    return data, truth


def test_linkage_accuracy(spark):
    data, truth = _journals(300, 6)
    data += [(r[0], *r[1:]) for r in data[:20]]  # rows delivered twice under the same key
    got = linkage.link_records(spark.createDataFrame(data, RECORDS), **LINK).collect()
    found = {(r.left, r.right) for r in got}
    assert len(found) == len(got) and all(a < b and 0.5 < r.confidence <= 1 for r in got for a, b in [(r.left, r.right)])
    wanted = {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b] and a[0] != b[0]}
    assert len(found & wanted) / len(wanted) > 0.97 and len(found & wanted) / len(found) > 0.99


def test_one_name_from_two_publishers_is_two_journals(spark):
    data, _ = _journals(200, 7)
    data += [("A:x", "A", "Annals of Xxx Law", None, None, [_number(99)], None, "One", ""), ("B:x", "B", "Annals of Xxx Law", None, None, [_number(777)], None, "Other", "")]
    found = {(r.left, r.right) for r in linkage.link_records(spark.createDataFrame(data, RECORDS), **LINK).collect()}
    assert ("A:x", "B:x") not in found


def test_a_skewed_key_loses_no_pair(spark):
    """Four sources of 110 classes of one title and publisher: all 72,600 pairs of different sources."""
    data = [(f"{x}:{i:03d}", x, "Same Name Here", None, [f"Alias {x} {i}"], None, None, "House", "") for i in range(110) for x in "ABCD"]
    got = linkage.link_records(spark.createDataFrame(data, RECORDS), **LINK)
    assert got.count() == 6 * 110 * 110 and got.select("left", "right").distinct().count() == 6 * 110 * 110


def test_every_pair_of_a_common_key_is_compared(spark, monkeypatch):
    monkeypatch.setattr(linkage, "MOST_IN_BLOCK", 5)
    keys = [["k"], ["k", "l"], ["k", "l", "m"], ["k"], ["k", "r"]]
    data = [(f"{x}:{i}", x, [*keys[i % 5], f"own {x} {i // 2}"]) for i in range(23) for x in "ABC"]
    keyed = linkage._keyed(spark.createDataFrame(data, "rep string, source string, keys array<string>"))
    got = rows(linkage.candidate_pairs(None, keyed).unionByName(linkage.common_pairs(keyed)).distinct())
    assert got == sorted((a[0], b[0]) for a in data for b in data if a[0] < b[0] and a[1] != b[1] and {*a[2]} & {*b[2]})
    # sets of keys that differ (B has another common name), and more of one set than a block holds
    data = [(f"{x}:{i}", x, "Same Name Here", None, [f"Own {x} W{i}", *(["Another Common Name"] if x == "B" else [])], None, None, None, "") for i in range(12) for x in "ABC"]
    found = {(r.left, r.right) for r in linkage.link_records(spark.createDataFrame(data, RECORDS), **LINK).collect()}
    assert found == {(a[0], b[0]) for a in data for b in data if a[0] < b[0] and a[1] != b[1]}


def test_a_record_with_many_sure_links_links_others(spark, monkeypatch):
    """B and C share no key and meet through A only, which has more links than a block holds."""
    han, name = "岚丘积雪气候杂志", "Annals of Dralbura Pollen Sociology"
    data = [("A:0", "A", name, None, [han], [_number(6)], [_number(7)], "One", "")]
    data += [(f"B:{i}", "B", han, None, ["甲乙丙丁戊己庚辛壬癸"[i] * 9], [_number(6)], None, None, "") for i in range(8)]
    data += [(f"C:{i}", "C", name, None, [f"Letters on W{'abcdefgh'[i] * 4} Optics"], [_number(7)], None, None, "") for i in range(8)]
    df = spark.createDataFrame(data + [(f"other {r[0]}", *r[1:]) for r in _journals(60, 8)[0]], RECORDS)
    found = {(r.left, r.right, round(r.confidence, 9)) for r in linkage.link_records(df, **LINK).collect()}
    for most in (5, 3):
        monkeypatch.setattr(linkage, "MOST_IN_BLOCK", most)
        assert found == {(r.left, r.right, round(r.confidence, 9)) for r in linkage.link_records(df, **LINK).collect()}
    assert {x[:2] for x in found} >= {(f"B:{i}", f"C:{j}") for i in range(8) for j in range(8)}


def test_linkage_edges(spark):
    data = [(None, "A", "x", None, None, None, None, None, ""), ("a", None, "x", None, None, None, None, None, ""), ("b", "A", None, None, None, None, None, None, ""), ("c", "B", "", " ", [None], [None], [""], "", "")]
    assert linkage.link_records(spark.createDataFrame(data, RECORDS), **LINK).count() == 0
    assert linkage.link_records(spark.createDataFrame([], RECORDS), **LINK).count() == 0


# copies


def plain_key(r):
    import re

    from bibliolake.llm.unify import canonical

    def t(v):
        return re.sub(r"[\W_]+", "", canonical(v or "").lower().replace("ß", "ss"))

    def n(v):
        v = canonical(v).lower()
        return "".join(sorted(re.sub(r"[\W_]+", "", v))) if re.search("[一-鿿]", v) else "".join(sorted(x for x in re.split(r"[\W_]+", v) if x))

    return t(r[1]), t(r[3]), t(r[4]), " ".join(sorted(x for a in r[2] or [] if a and (x := n(a))))


PAPERS = "pid long, title string, authors array<string>, journal string, date string, first string"


def _papers(seed, n=300):
    rng = random.Random(seed)
    base = [(f"Effects of {w} on lakes", ["Li Wei", "Bo Chen"], f"J {w}", "2020-01") for w in "abcdefghij"] + [("同名文章" * 3, ["蔺筠璟"], "学报", "2021"), (None, None, None, None), ("", [], " ", "-")]
    out = []
    for i in range(n):
        t, a, j, d = rng.choice(base) if rng.random() < 0.6 else (base[0][0], base[0][1], base[0][2], base[0][3])
        if t and rng.random() < 0.5:
            t, a = rng.choice([t.upper(), f"  {t}. ", t.replace("e", "е"), t + "​"]), [x if rng.random() < 0.5 else ", ".join(reversed(x.split())) for x in reversed(a)]
        out.append((i, t, a, j, d, "clash"))
    return out + [(None, "x", None, None, None, ""), out[5], out[6]]


@pytest.mark.parametrize("least", [10**6, 20, 5])
def test_copies_against_plain_grouping(spark, monkeypatch, least):
    """Whatever the bucket size: from one bucket to buckets of one row, hot keys included."""
    monkeypatch.setattr(copies, "LEAST_ROWS", least)
    data = _papers(9)
    df = spark.createDataFrame(data, PAPERS)
    groups = defaultdict(set)
    for r in data:
        if r[0] is not None:
            groups[plain_key(r)].add(r[0])
    wanted = sorted((min(g), x) for g in groups.values() for x in g if x != min(g))
    assert rows(copies.group_copies(df, "pid", ["title", "journal", "date"], ["authors"])) == sorted(wanted, key=str)
    counts = rows(copies.count_copies(df, "pid", ["title", "journal", "date"], ["authors"]))
    assert counts == sorted(((min(g), len(g)) for g in groups.values()), key=str)


def test_copies_edges(spark):
    df = spark.createDataFrame([], PAPERS)
    assert copies.group_copies(df, "pid", ["title"], ["authors"]).count() == 0
    long = spark.createDataFrame([("b", "x" * 300_000, None, None, None, ""), ("a", "X" * 300_000, None, None, None, "")], PAPERS.replace("pid long", "pid string"))
    assert rows(copies.group_copies(long, "pid", ["title"], ["authors"])) == [("a", "b")]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=20), max_size=40))
def test_trie_counts_keys(keys):
    trie = copies.Trie()
    for i, k in enumerate(keys):
        trie.add(k, i)
    got = {t[0]: 1 if t[2] is None else len(t[2]) for t in trie.terminals()}
    assert got == dict(Counter(keys))


# top N


def test_top_n_against_sorting(spark, monkeypatch):
    monkeypatch.setattr(topn, "HOT_PARTS", 3)
    rng = random.Random(8)
    data = [(rng.choice(["hot"] * 5 + [f"g{i}" for i in range(40)] + [None]), rng.choice([None, 0, 1, 2, 3]), rng.choice([None, *range(4)]), rng.randint(0, 500), "x") for _ in range(3000)]
    df = spark.createDataFrame(data, "g string, score long, tie int, id int, rank string")
    got = topn.top_n(df, "g", F.col("score"), ["tie", "id"], 7, ["id", "tie"])
    wanted = []
    big = 10**9
    for g in {d[0] for d in data} - {None}:
        own = sorted((big if d[1] is None else d[1], big if d[2] is None else d[2], d[3]) for d in data if d[0] == g)[:7]
        wanted += [(g, i, None if t == big else t, n) for n, (_, t, i) in enumerate(own, 1)]
    assert rows(got) == sorted(wanted, key=str)
    coarse = topn.top_n(df, "g", F.col("score"), ["tie", "id"], 7, ["id", "tie"], bucket=F.expr("score div 2"))
    below = spark.range(500).select(F.lit("g").alias("g"), ((F.col("id") - 250) * 1_000_003).alias("s"), "id")
    assert [r.id for r in topn.top_n(below, "g", F.col("s"), ["id"], 4, ["id"]).orderBy("rank").collect()] == [0, 1, 2, 3]
    assert rows(coarse) == sorted(wanted, key=str)
    assert topn.top_n(df.limit(0), "g", F.col("score"), ["id"], 7, ["id"]).count() == 0


def test_hot_group_with_ties(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), F.lit(1).alias("s"), "id")
    got = topn.top_n(df, "g", F.col("s"), ["id"], 3, ["id"]).filter("g = 'hot'")
    assert rows(got.select("id", "rank")) == [(0, 1), (3, 2), (6, 3)]


def test_no_bucket_passes_over_a_better_paper(spark, tmp_path):
    """Ranks below zero and levels of all sizes, one group for each pair of adjacent kinds."""
    levels, ranks = [-(2**31), -3, 0, None, 4, 5, 62, 63, 70, 2**30 + 1, 2**31 - 1], [-(2**31), -5, None, 0, 1, 1023, 5000, 2**31 - 1]
    kinds = [(a, b) for a in levels for b in ranks]
    data = [(f"{x} {y}", a, b, f"{i}{n:02d}") for x in range(0, len(kinds), 7) for y in range(0, len(kinds), 3) for i, (a, b) in enumerate((kinds[x], kinds[y])) for n in range(10)]
    data += [("five", 5, -5, f"a{n}") for n in range(10)] + [("five", 4, None, "z")]
    spark.createDataFrame(data, "search_query string, priority_level int, result_rank int, paper_id string").write.parquet(f"{tmp_path}/papers.parquet")
    missing = lambda v: v or 2**30
    wanted = []
    for q in {d[0] for d in data}:
        own = sorted((missing(d[1]), missing(d[2]), d[3]) for d in data if d[0] == q)
        wanted += [(q, x[2]) for x in own[:10]]
    assert rows(queries.p7_found(spark, str(tmp_path))) == sorted(wanted, key=str)


# mixing


def test_tails_of_poisson_numbers():
    import math

    for mean in (1e-9, 0.3, 1.0, 5.5, 300.0):
        got = mixing.tails(mean, 12)
        assert abs(got[0] / -math.expm1(-mean) - 1) < 1e-12 and all(a >= b >= 0 for a, b in zip(got, got[1:]))
        assert abs(sum(mixing.tails(mean, int(mean * 3) + 60)) / mean - 1) < 1e-9  # the mean is the sum of the tails
    assert mixing.tails(0.0, 2) == [0.0, 0.0]


def _even(supply):
    sizes = mixing.Sizes(supply * mixing.STEPS)
    sizes.refine(0.0, 1.0, dict.fromkeys(range(mixing.STEPS), supply))
    return sizes


def test_means_beyond_200_meet_their_targets():
    sizes = _even(3)
    supply = 3 * mixing.STEPS
    for cap, repeats in ((500, 350), (2000, 1500), (2000, 2000), (5, 5), (5, 2), (5, 1e-5)):
        mean = mixing.calibrated_mean(sizes, cap, supply * repeats)
        assert abs(sizes.guess(mean, cap) / supply / repeats - 1) < 0.01


@pytest.mark.parametrize("share", [1e-4, 1.7])
def test_small_targets_are_met(spark, share):
    """Targets far below a step of the first histogram come out to the size of a document."""
    docs = spark.range(300_000).select("id", F.lit("a").alias("s"), (F.col("id") % 7 + 1).alias("n"))
    targets = spark.createDataFrame([("a", 1.0, 3)], "s string, w double, c int")
    total = 1_200_000 * share
    mixture, report = mixing.mix(docs, targets, key="id", source="s", size="n", weight="w", cap="c", total=total)
    r = report.first()
    assert abs(r.used / total - 1) < 0.01 + 8 / total
    assert mixture.join(docs, "id").agg(F.sum("n")).first()[0] == r.used


# all queries


def test_forms_come_out_of_all_fields(spark, tmp_path):
    tables = {"papers": "'p' paper_id, 'a\u200bb' title, 'c\u200bd' journal_raw", "journals": "'j' journal_id, 'e\u200bf' formal_title", "search_requests": "'r' request_id, 'g\u200bh' query"}
    for name, columns in tables.items():
        spark.sql(f"SELECT {columns}").write.parquet(f"{tmp_path}/{name}.parquet")
    df = queries.p2_unified(spark, str(tmp_path))
    got = {(r.field, r.row_key): r.unified for r in df.collect()}
    assert got == {("papers.title", "p"): "ab", ("papers.journal_raw", "p"): "cd", ("journals.formal_title", "j"): "ef", ("search_requests.query", "r"): "gh"}
    assert {tuple(r) for r in queries.p2_found(spark, str(tmp_path)).collect()} == set(got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    df = queries.QUERIES[name](spark, SF)
    own = sorted(tuple(map(str, r)) for r in df.collect())
    if name in queries.ORACLE:
        import duckdb

        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        for f in os.listdir(SF):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
        got = con.execute(queries.ORACLE[name])
        assert [d[0] for d in got.description] == df.columns
        assert own == sorted(tuple(map(str, r)) for r in got.fetchall())
    if name.endswith("_found"):
        assert len(own) == len(set(own))
