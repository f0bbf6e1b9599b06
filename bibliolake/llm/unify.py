"""Visually identical text with different characters, brought to one consistent form.

Ordinary text is recognised by a quick check (one compiled character class, the same in the JVM and
in Python) and passes through untouched. Only segments around characters that fail the check are
normalized, together with the letters beside them (the boundary context that composition and the
choice of a script need), and the results are spliced into the unchanged text.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Chinese punctuation that stays as it is, Latin letters without a decomposition
# that are ordinary, letters of other scripts by the Latin letter that they look like, hyphens.
CHINESE_PUNCTUATION = "·—…‘’“”、。〃〈〉《》「」『』【】〔〕〖〗！（），：；？～￥"
LATIN_LETTERS = "ÆÐØÞßæðøþĐđĦħıŁłŊŋŒœŦŧ"
CYRILLIC_LIKE_LATIN = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ї": "Ï", "Ј": "J", "Ү": "Y", "Ԁ": "D", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ї": "ï",
    "ј": "j", "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w",
}
GREEK_LIKE_LATIN = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ν": "v", "ο": "o", "υ": "u", "ι": "i", "κ": "k", "ϲ": "c", "ϳ": "j",
}
OTHER_LIKE_LATIN = {"ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "L", "ⅼ": "l", "ſ": "s", "Ꭺ": "A", "ꓐ": "B", "օ": "o", "ո": "n"}
HYPHENS = "‐‑‒–−⁃﹘﹣－‧"

_TO_LATIN = CYRILLIC_LIKE_LATIN | GREEK_LIKE_LATIN
_LATIN_TO_CYRILLIC = {v: k for k, v in CYRILLIC_LIKE_LATIN.items() if v.isascii()}


def _plain(c: str) -> bool:
    """Whether c is ordinary wherever it stands (unless a combining mark follows)."""
    if c.isascii():
        return " " <= c <= "~" or c in "\t\n\r"
    if c in CHINESE_PUNCTUATION or c in LATIN_LETTERS:
        return True
    kind = unicodedata.category(c)
    if kind[0] == "L":
        if "㐀" <= c <= "鿿" or "\U00020000" <= c <= "\U0003ffff":
            return unicodedata.is_normalized("NFKC", c)
        if "Ͱ" <= c <= "ԯ" or "ἀ" <= c <= "῿" or c in OTHER_LIKE_LATIN:
            return False
        if "\xc0" <= c <= "ɏ" or "Ḁ" <= c <= "ỿ":
            return unicodedata.is_normalized("NFC", c) and unicodedata.normalize("NFD", c)[0].isascii() and unicodedata.is_normalized("NFKC", c)
        return unicodedata.is_normalized("NFKC", c)
    if kind[0] in "CZM" or c in HYPHENS:
        return False
    return kind == "No" and "²" <= c <= "₿" or unicodedata.is_normalized("NFKC", c)


@lru_cache(None)
def plain_ranges() -> list[tuple[int, int]]:
    """The quick-check class as code point ranges of the two lowest planes and the Han planes, by rule."""
    out: list[tuple[int, int]] = []
    for o in [*range(0xD800), *range(0xE000, 0x20000)]:
        if _plain(chr(o)):
            if out and out[-1][1] == o - 1:
                out[-1] = (out[-1][0], o)
            else:
                out.append((o, o))
    return [*out, (0x20000, 0x2F7FF), (0x30000, 0x323AF)]


@lru_cache(None)
def _unusual() -> re.Pattern[str]:
    return re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in plain_ranges()) + "]")


@lru_cache(None)
def plain_java() -> str:
    """The same class for the JVM, as a pattern of wholly ordinary values (Han characters, Latin and
    Chinese punctuation; values with others ask Python). A class costs the JVM as many steps a
    character as it has ranges, so the two commonest ranges are a class of their own."""
    often = "[\\x{20}-\\x{7e}\\x{4e00}-\\x{9fff}]"
    rest = [(a, b) for a, b in plain_ranges() if a < 0x20 or 0x7F < a < 0x250 or 0x3000 <= a <= 0x30FF or 0xFF00 <= a <= 0xFF1F or a in (0x2014, 0x2018, 0x201C, 0x2026)]
    # small letters with accents first
    rest.sort(key=lambda r: (not r[0] <= 0xE9 <= r[1], r[0]))
    others = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in rest) + "]"
    return f"\\A(?:{often}++|{others})*+\\z"


@lru_cache(65536)
def _single(c: str) -> str:
    """What one unusual character becomes, before composition and the choice of a script."""
    if c in HYPHENS:
        return "-"
    if c in OTHER_LIKE_LATIN:
        return OTHER_LIKE_LATIN[c]
    kind = unicodedata.category(c)
    if kind in ("Cf", "Cc", "Cn", "Co") or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef" or c in "͏ᅟᅠㅤﾠ":
        return ""
    if kind[0] == "Z":
        return "\n" if kind in ("Zl", "Zp") else " "
    if kind[0] == "M":
        return c
    out = unicodedata.normalize("NFKC", c)
    return "".join(x if x == c or _plain(x) else _single(x) for x in out)


_WORD = re.compile(r"[^\W\d_⺀-﫿]+")
_GREEK_RUN = re.compile(r"(?<![A-Za-z])[\u0370-\u03ff]{2,}(?![A-Za-z])")
_CYR = re.compile(r"[Ѐ-ԯ]")
_SCRIPT = re.compile(r"[Ͱ-ϿЀ-ԯἀ-῿]")


def _own_cyrillic(text: str) -> bool:
    """Whether text has a Cyrillic letter that no Latin letter looks like."""
    return any(c not in CYRILLIC_LIKE_LATIN for c in _CYR.findall(text))


def _own_greek_word(text: str) -> bool:
    """Whether text has a word of several Greek letters, one of which no Latin letter looks like."""
    return any(c not in GREEK_LIKE_LATIN for w in _GREEK_RUN.findall(text) for c in w)


def _one_script(word: str, cyrillic_text: bool, greek_text: bool) -> str:
    latin = cyr = greek = own_cyr = 0
    for c in word:
        if "Ѐ" <= c <= "ԯ":
            cyr += 1
            own_cyr += c not in CYRILLIC_LIKE_LATIN
        elif "Ͱ" <= c <= "Ͽ":
            greek += 1
        else:
            latin += 1
    if cyr and own_cyr >= 1 and (own_cyr >= latin or not latin):
        return "".join(_LATIN_TO_CYRILLIC.get(c, c) for c in word) if latin or greek else word
    if cyr and not latin and not greek and cyrillic_text:
        return word
    if greek and not latin and not cyr and (greek_text or all(c not in GREEK_LIKE_LATIN for c in word)):
        return word
    return "".join(_TO_LATIN.get(c, c) for c in word)


def canonical(text: str | None) -> str | None:
    """The consistent form of text; null stays null and ordinary text is returned as it is.

    Invisible characters vanish, any space becomes a plain one, any hyphen ASCII's; compatibility
    forms (full-width letters, ligatures, Han radicals, unit signs) become what they show; letters
    and combining accents compose; letters of another script that only look right take the script
    of their word. Words wholly in Greek or Cyrillic, Greek symbols and Chinese punctuation stay.
    Applying it twice changes nothing. Linear in the length of the text.
    """
    if not text:
        return text
    unusual = _unusual()
    first = unusual.search(text)
    if not first:
        return text
    out: list[str] = []
    done = 0
    cyrillic = greek = None
    m = first
    while m:
        start, end = m.start(), m.end()
        # boundary context: the letters to both sides, and whatever unusual stands among them
        while start > done and (text[start - 1].isalpha() and not "⺀" <= text[start - 1] <= "﫿"):
            start -= 1
        n = len(text)
        while end < n and ((text[end].isalpha() and not "⺀" <= text[end] <= "﫿") or unusual.match(text, end)):
            end += 1
        if start == m.start() and start > done and unicodedata.combining(text[start]):
            start -= 1
        segment = "".join(c if _plain_cached(c) else _single(c) for c in text[start:end])
        if not unicodedata.is_normalized("NFC", segment):
            segment = unicodedata.normalize("NFC", segment)
        if _SCRIPT.search(segment):
            if cyrillic is None:
                cyrillic, greek = _own_cyrillic(text), _own_greek_word(text)
            segment = _WORD.sub(lambda w: _one_script(w.group(), cyrillic, greek) if _SCRIPT.search(w.group()) else w.group(), segment)
        out.append(text[done:start])
        out.append(segment)
        done = end
        m = unusual.search(text, end)
    out.append(text[done:])
    return "".join(out)


@lru_cache(65536)
def _plain_cached(c: str) -> bool:
    return not _unusual().match(c)


@F.pandas_udf(T.StringType())
def _canonical_udf(values: pd.Series) -> pd.Series:
    return values.map(canonical, na_action="ignore")


def is_unusual(column: str | Column) -> Column:
    """The quick check in the JVM: true for values that may need work, false for null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(~c.rlike(plain_java()), F.lit(False))


def unified(column: str | Column) -> Column:
    """The consistent form of a column; only values that fail the quick check are sent to Python."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(_canonical_udf(F.when(is_unusual(c), c)), c)


def unify_text(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with a new column for each entry (source column: new name) that holds its consistent form.

    Row-wise without a shuffle. Null stays null, empty stays empty, very long texts are handled
    whole in linear time, repeated rows are kept, an empty table stays empty. A new name that is
    already a column replaces that column, as withColumn does.
    """
    return df.withColumns({new: unified(old) for old, new in columns.items()})


def changed_values(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """Rows (field, row_key, value, unified) of all values whose consistent form differs.

    fields maps columns to the names that come out. The table is read once for all its fields, and
    values that pass the quick check are dropped in the JVM.
    """
    cells = F.array(*[F.struct(F.lit(name).alias("field"), F.col(c).cast("string").alias("value")) for c, name in fields.items()])
    rows = df.select(F.col(key).cast("string").alias("row_key"), F.explode(F.filter(cells, lambda x: is_unusual(x["value"]))).alias("_cell"))
    rows = rows.select(F.col("_cell.field").alias("field"), "row_key", F.col("_cell.value").alias("value"))
    return rows.withColumn("unified", _canonical_udf("value")).filter(F.col("unified") != F.col("value"))
