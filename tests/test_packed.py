import pytest
from conftest import rows

from bibliolake.operators.packed import explode_packed, split_packed

CASES = [
    (None, []),
    ("", []),
    (" \t ", []),
    ("A B", ["A B"]),
    ('"Rosa ""Lo"" Gov";Bo Sen', ['Rosa "Lo" Gov', "Bo Sen"]),
    ("Bass, E., Bror, N. G., Fersch, E.", ["Bass, E.", "Bror, N. G.", "Fersch, E."]),
    ('"Wal, Lan, Jr.";"Pel, Sus"', ["Wal, Lan, Jr.", "Pel, Sus"]),
    ("Wal, Lan, Jr.; Pel, Sus", ["Wal, Lan, Jr.", "Pel, Sus"]),
    ("Ee Hel, and De Fae", ["Ee Hel", "De Fae"]),
    ("仉璟樾;弭峤泠, 谌昉沅", ["仉璟樾", "弭峤泠", "谌昉沅"]),
    ("逄玠、弭岚 与 麴泠", ["逄玠", "弭岚", "麴泠"]),
    (" ; A B;;C D；", ["A B", "C D"]),
    ("Kae, Tum B.; Liv, Dol", ["Kae, Tum B.", "Liv, Dol"]),
    ('"Inst | Unit 8", Tan K. Ger', ["Inst | Unit 8", "Tan K. Ger"]),
    ("“站；站联合组”，粟漪", ["站；站联合组", "粟漪"]),
    ("A (x; y) B; C", ["A (x; y) B", "C"]),
    ("A (x [y; z] w; v) B; C", ["A (x [y; z] w; v) B", "C"]),
    ('a"b;c', ['a"b', "c"]),
    ('"a;b', ['"a', "b"]),
    ("a (b;c", ["a (b", "c"]),
    ("x\\;y;z", ["x;y", "z"]),
    ('"a \\" b";c', ['a " b', "c"]),
    ("A B\tC D\nE F", ["A B", "C D", "E F"]),
    ("A B　C D", ["A B", "C D"]),
]


@pytest.mark.parametrize("text,wanted", CASES)
def test_split(text, wanted):
    assert split_packed(text) == wanted


def test_very_long_text_is_linear_and_whole():
    assert len(split_packed(";".join(f"A{i} B" for i in range(100_000)))) == 100_000
    assert len(split_packed('"' * 99_999 + "(" * 50_000 + ";x")) >= 1


def test_plain_values_keep_commas_apart():
    assert split_packed("a, b; c", names=False) == ["a", "b", "c"]


def test_explode(spark):
    data = [(1, "x;y", "t"), (1, "x;y", "t"), (2, None, "t"), (3, "", "t"), (None, "z", "t"), (4, "  one  ", "t")]
    df = spark.createDataFrame(data, "id long, v string, pos string")
    assert rows(explode_packed(df, "id", "v")) == sorted([(1, 1, "x"), (1, 2, "y"), (1, 1, "x"), (1, 2, "y"), (None, 1, "z"), (4, 1, "one")], key=str)
    assert explode_packed(df.limit(0), "id", "v").count() == 0
    assert explode_packed(df, "id", "v", value_name="author").columns == ["id", "pos", "author"]


def test_both_ways_agree(spark):
    df = spark.createDataFrame(list(enumerate(t for t, _ in CASES)), "id long, v string")
    got = {}
    for i, _, v in sorted(tuple(r) for r in explode_packed(df, "id", "v").collect()):
        got.setdefault(i, []).append(v)
    assert got == {i: w for i, (_, w) in enumerate(CASES) if w}
