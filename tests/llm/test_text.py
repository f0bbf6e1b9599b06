"""Consistent text, token ids, mixtures, abuse scores."""

import os
import random
import unicodedata

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bibliolake.llm import abuse, encode, mixing, unify

SF = "/root/testdata"

SAME = [
    "Plain text, with-hyphens.", "岚丘（中文）：标题——《刊》", "Évolution à Nörre", "Запасы углерода в почвах", "β-diversity and μm, δ-scaled",
    "基于μ子成像", "А. С. Иванов и др.", "Κριτική θεωρία", "tab\tand\nline", "", "x² and H₂O",
]
CHANGED = {
    "ｆｕｌｌ　ｗｉｄｔｈ１２": "full width12", "étude": "étude", "zero​width": "zerowidth", "no break": "no break", "Rethtüviа": "Rethtüvia",
    "А 1994 study": "A 1994 study", "水⽂": "水文", "eﬀect": "effect", "µm": "μm", "Ångstrom": "Ångstrom", "K-factor K": "K-factor K",
    "long‑term": "long-term", "Запаcы углерода": "Запасы углерода", "иỏ": "иỏ", "soft­hyphen": "softhyphen", "1９６0": "1960", "й": "й",
}


@pytest.mark.parametrize("value", SAME)
def test_ordinary_text_stays(value):
    assert unify.canonical(value) == value


@pytest.mark.parametrize("value,wanted", [(k, v) for k, v in CHANGED.items() if k != "иỏ"])
def test_unusual_text_changes(value, wanted):
    assert unify.canonical(value) == unicodedata.normalize("NFC", wanted)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(), st.sampled_from("aа́​ＡοПй ﬁ⽂文e-‑"))))
def test_form_is_stable_and_ordinary(value):
    if any("\ud800" <= c <= "\udfff" for c in value):
        return
    once = unify.canonical(value)
    assert unify.canonical(once) == once
    assert not any(c in once for c in "​­﻿⁠ 　")


def test_quick_checks_agree(spark):
    """What the JVM lets pass is in form already."""
    values = [*SAME, *CHANGED, *[chr(o) for o in range(0x20, 0x3100) if not unicodedata.category(chr(o)).startswith("C")]]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", unify.is_unusual("v").alias("u"))
    for r in df.collect():
        assert r.u or unify.canonical(r.v) == r.v, r.v


def test_unify_columns(spark):
    data = [(1, "ａ", "x"), (1, "ａ", "x"), (2, None, "x"), (3, "", None), (4, "е" * 50_000 + "x", "x")]
    df = spark.createDataFrame(data, "id int, t string, value string")
    out = unify.unify_text(df, {"t": "t2", "value": "value"})
    assert [r.t2 for r in out.orderBy("id").collect()] == ["a", "a", None, "", "e" * 50_000 + "x"]
    got = unify.changed_values(df, "id", {"t": "T", "value": "V"})
    assert rows(got.select("field", "row_key")) == [("T", "1"), ("T", "1"), ("T", "4")]
    assert unify.changed_values(df.limit(0), "id", {"t": "T"}).count() == 0


# token ids


@pytest.fixture(scope="module")
def pair():
    if not os.path.isdir(encode.TOKENIZERS):
        pytest.skip("no vocabularies")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(os.path.join(encode.TOKENIZERS, "byte_bpe_50k.json"))
    library.encode_special_tokens = True
    with open(os.path.join(encode.TOKENIZERS, "byte_bpe_50k.tiktoken"), "rb") as f:
        return encode.BytePairs.read(f.read()), library


TEXTS = ["", "a", "Hello, world! It's 2024.", "<|endoftext|> x", "  two  spaces \n\n", "中文没有空格" * 300, "x" * 3000, " " * 500 + "y", "\U0001f600é​", "The<|endoftext|>", "don't WE'LL"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_the_library(pair, text):
    own, library = pair
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert own.decode(own.encode(text)) == text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_the_library(pair, text):
    own, library = pair
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert own.decode(own.encode(text)) == text


def test_encode_documents(spark, pair):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a b", 0), (3, "a b", 0), (None, "x", 0)], "doc_id long, text string, ids int")
    got = encode.encode_documents(df, "doc_id", "text")
    assert rows(got) == sorted([(1, []), (2, []), (3, [64, 275]), (3, [64, 275]), (None, [87])], key=str)
    back = got.select(encode.decoder(spark)("ids").alias("t")).collect()
    assert sorted(r.t for r in back) == ["", "", "a b", "a b", "x"]
    assert encode.encode_documents(df.limit(0), "doc_id", "text").count() == 0


# mixtures

DOCS, TARGETS = "id long, src string, n int, size string", "src string, w double, c int"


def mixed(spark, docs, targets, **more):
    return mixing.mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS), key="id", source="src", size="n", weight="w", cap="c", **more)


def test_shares_meet_their_targets(spark):
    rng = random.Random(1)
    docs = [(i, s, rng.randint(1, 200), "x") for i, s in enumerate("a" * 3000 + "b" * 1200 + "c" * 300)]
    targets = [("a", 0.3, 1), ("b", 0.4, 2), ("c", 0.2, 4), ("none", 0.1, 5)]
    mixture, report = mixed(spark, docs, targets)
    got = {r.source: r for r in report.collect()}
    assert abs(got["a"].share - 0.3 / 0.9) < 0.01 and abs(got["b"].share - 0.4 / 0.9) < 0.01 and abs(got["c"].share - 0.2 / 0.9) < 0.01
    assert got["none"].used == got["none"].docs == 0
    per = mixture.groupBy("source", "id").agg(F.count("*").alias("k")).groupBy("source").agg(F.max("k").alias("k"))
    assert all(r.k <= {"a": 1, "b": 2, "c": 4}[r.source] for r in per.collect())
    size = {d[0]: d[2] for d in docs}
    assert sum(size[r.id] for r in mixture.collect()) == sum(r.used for r in got.values())
    places = [r.place for r in mixture.collect()]
    assert places == sorted(places)
    sources = [r.source for r in mixture.limit(200).collect()]
    assert len(set(sources)) == 3


def test_copies_follow_the_distribution():
    limits = mixing.tails(1.5, 6)
    counts = np.bincount([sum((i + 0.5) / 4096 < t for t in limits) for i in range(4096)], minlength=7) / 4096
    wanted = [np.exp(-1.5) * 1.5**k / np.prod(range(1, k + 1)) for k in range(6)]
    assert np.abs(counts[:6] - wanted).max() < 1e-3


def test_mixture_edges(spark):
    docs = [(1, None, 5, "x"), (2, "a", None, "x"), (3, "a", 0, "x"), (None, "a", 5, "x"), (4, "a", 5, "x"), (4, "a", 5, "x"), (5, "z", 5, "x")]
    mixture, report = mixed(spark, docs, [("a", 1.0, 2), ("a", 1.0, 9), (None, 0.5, 1)], keep=["size"])
    assert {r.id for r in mixture.collect()} == {4} and mixture.count() == 4 and mixture.columns[-1] == "size"
    assert rows(report.select("source", "used", "share")) == [("a", 20, 1.0)]
    empty, report = mixed(spark, [(1, "a", 1, "x")], [("b", 1.0, 1)])
    assert empty.count() == 0 and rows(report.select("source", "share")) == [("b", 0.0)]
    fixed, report = mixed(spark, [(i, "a", 1, "x") for i in range(1000)], [("a", 1.0, 3)], total=500.0)
    assert abs(report.first().used - 500) <= 3


# abuse


def test_disguises_are_undone():
    plain = abuse.sentences("You are a stupid clown!")
    for disguised in ("You are a st­upid clown!", "YOU ARE A STUPID CLOWN!", "You are a s-t-u-p-i-d clownnnn!", "Yоu are a stup1d c l o w n!"):
        assert abuse.sentences(disguised) == plain, disguised
    assert abuse.sentences("这个蠢*货。滚！") == abuse.sentences("这个蠢 货。滚！") == [list("这个蠢货"), list("滚")]
    assert abuse.sentences("") == abuse.sentences(" \n") == []


def test_features_stay_in_their_sentence():
    r = abuse.Reader()
    one, at = abuse.features_of(*r.read("a b. c d."))
    assert set(at.tolist()) == {0, 1}
    assert set(one.tolist()) == set(abuse.features_of(*r.read("a b."))[0].tolist()) | set(abuse.features_of(*r.read("c d."))[0].tolist())
    assert r.read(None) == r.read("  ") == r.read("") == (b"", b"") and len(abuse.features_of(b"", b"")[0]) == 0


def test_chunks_give_what_single_documents_give(monkeypatch):
    texts = ["a b c. d e f g a b.", None, "", "x y", "a b c", "b c d. e f. g"] * 3
    r = abuse.Reader()
    words = [r.read(t) for t in texts]
    rng = np.random.default_rng(3)
    scorer = abuse.Scorer(np.arange(2**abuse.BITS), rng.normal(size=2**abuse.BITS), -1.0)
    alone = np.concatenate([scorer.scores(abuse.Chunk([c], [n])) for c, n in words])
    for most in (1, 7, 10**6):
        monkeypatch.setattr(abuse, "CHUNK_WORDS", most)
        got = np.concatenate([scorer.scores(c) for c in abuse.chunks([w[0] for w in words], [w[1] for w in words])])
        assert np.allclose(got, alone) and got[1] == got[2] == 0.0
    for (c, n), score in zip(words, alone):
        f, s = abuse.features_of(c, n)
        if len(f):
            sums = [scorer.dense[np.unique(f[s == i])].sum() for i in range(s.max() + 1)]
            assert abs(score - 1 / (1 + np.exp(1.0 - max(sums)))) < 1e-5


def _made(n, seed):
    rng = random.Random(seed)
    fine = ["The samples were dried and weighed.", "Please add a control site.", "Parasites of the eel spread quickly.", "The map shows the dam.", "Visitors called the rangers names."]
    bad = ["You are a worthless {} and should leave.", "Get out of here you {}.", "All of them are {} and must vanish."]
    names = ["parasite", "fool", "clod", "knave"]
    docs = []
    for i in range(n):
        parts = [rng.choice(fine) for _ in range(rng.randint(1, 6))]
        y = rng.random() < 0.3
        if y:
            parts.insert(rng.randint(0, len(parts)), rng.choice(bad).format(rng.choice(names)))
        docs.append((i, " ".join(parts), int(y)))
    return docs


def test_held_out_accuracy(spark):
    docs = _made(600, 5)
    rng = random.Random(2)
    labels = [(i, y if rng.random() > 0.04 else 1 - y) for i, _, y in docs[:300]] + [(0, None), (1, None), (10_000, 1)]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in docs] + [(9000, None, "x"), (9001, "", "x"), (9002, " ", "x")], "doc_id long, text string, score string")
    scored = abuse.score_documents(df, spark.createDataFrame(labels, "doc_id long, abusive int"), key="doc_id", text="text", label="abusive")
    got = {r.doc_id: r.score for r in scored.collect()}
    right = [(got[i] >= abuse.THRESHOLD) == bool(y) for i, _, y in docs[300:]]
    assert sum(right) / len(right) > 0.95
    assert got[9000] == got[9001] == got[9002] == 0


def test_abuse_edges(spark):
    docs = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s")], "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, abusive int")
    scored = abuse.score_documents(docs, none, key="doc_id", text="text", label="abusive", keep=["source"])
    assert scored.count() == 2 and all(r.score < 0.1 for r in scored.collect())
    tie = spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, abusive int")
    assert all(r.score < 0.1 for r in abuse.score_documents(docs, tie, key="doc_id", text="text", label="abusive").collect())
    assert abuse.score_documents(docs.limit(0), tie, key="doc_id", text="text", label="abusive").count() == 0


@pytest.mark.skipif(not os.path.isdir(f"{SF}/sf0.1"), reason="no test data")
def test_held_out_reviews(spark):
    """Half of the reviewed documents train, the other half tests; judgements may be wrong."""
    docs = spark.read.parquet(f"{SF}/sf0.1/documents.parquet")
    labels = spark.read.parquet(f"{SF}/sf0.1/review_labels.parquet").filter("abusive is not null")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    scored = abuse.score_documents(docs, labels.filter(half == 0), key="doc_id", text="text", label="abusive")
    test = labels.filter(half == 1).groupBy("doc_id").agg(F.avg("abusive").alias("y")).filter("y <> 0.5").join(scored, "doc_id").collect()
    right = sum((r.score >= abuse.THRESHOLD) == (r.y > 0.5) for r in test)
    assert right / len(test) > 0.8
