"""Several values packed in one field: a quote-aware tokenizer that keeps positions.

The tokenizer is a finite-state machine over lexical tokens (not over single characters: runs of
ordinary text are one token, found by a compiled pattern). Its states are outside, inside quotes
and inside brackets of some depth; only delimiters read in the outside state end a value.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Delimiters that always separate, commas that may also join "Family, Given",
# words that join the last two values, quotes with their closing sign, brackets.
HARD = ";；|｜/／、\n\r\t  　"
COMMA = ",，"
JOINING_WORDS = ("and", "und", "et", "y", "&", "与", "和", "及")
QUOTES = {'"': '"', "“": "”", "«": "»", "「": "」", "『": "』"}
BRACKETS = {"(": ")", "（": "）", "[": "]", "【": "】"}
SUFFIXES = {"jr", "jr.", "sr", "sr.", "ii", "iii", "iv"}

_QUOTE_SIGNS = "".join(QUOTES) + "".join(q for q in QUOTES.values() if q not in QUOTES)
_SIGNS = re.escape(HARD + COMMA + _QUOTE_SIGNS + "".join(BRACKETS) + "".join(BRACKETS.values()))
_TOKEN = re.compile(
    rf"(?P<escape>\\[\\{_SIGNS}])"
    rf"|(?P<hard>[{re.escape(HARD)}])"
    rf"|(?P<comma>[{COMMA}])"
    rf"|(?P<quote>[{_QUOTE_SIGNS}])"
    rf"|(?P<open>[{re.escape(''.join(BRACKETS))}])|(?P<close>[{re.escape(''.join(BRACKETS.values()))}])"
    rf"|(?P<word>(?<=\s)(?:{'|'.join(map(re.escape, JOINING_WORDS))})(?=\s))"
    rf"|(?P<space>[^\S{re.escape(HARD)}]+)"
    rf"|(?P<text>[^\s\\{_SIGNS}]+|\\)",
)
_LETTER = re.compile(r"[^\W\d_]")
_INITIALS = re.compile(r"(?:[^\W\d_]\.[\s-]*)+|[^\W\d_]")
_WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]")
_TRIM = " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"


def _tokens(text: str) -> Iterator[tuple[str, str, int]]:
    for m in _TOKEN.finditer(text):
        yield m.lastgroup, m.group(), m.end()


def _closes(text: str, sign: str, start: int, failed: dict[str, int]) -> bool:
    """Whether a closing sign follows. A failed search is remembered, so the scan stays linear."""
    if failed.get(sign, len(text) + 1) <= start:
        return False
    if text.find(sign, start) < 0:
        failed[sign] = start
        return False
    return True


def _pieces(text: str) -> list[tuple[str, bool, str]]:
    """The values between delimiters as (value, was quoted, delimiter before it)."""
    out: list[tuple[str, bool, str]] = []
    buf: list[str] = []
    quoted, quote_end, depth, before, skip_to = False, "", [], "", 0
    failed: dict[str, int] = {}

    def flush(delimiter: str) -> None:
        nonlocal quoted, before
        value = "".join(buf).strip(_TRIM)
        if value:
            out.append((value, quoted, before))
            before = delimiter
        elif before in ("", ",") or delimiter != ",":
            before = delimiter or before
        buf.clear()
        quoted = False

    for kind, tok, end in _tokens(text):
        if end <= skip_to:
            continue
        if quote_end:
            if kind == "escape":
                buf.append(tok[1:])
            elif tok == quote_end:
                if quote_end == '"' and text.startswith('"', end):
                    buf.append('"')
                    skip_to = end + 1
                else:
                    quote_end = ""
            else:
                buf.append(tok)
            continue
        if kind == "escape":
            buf.append(tok[1:])
        elif depth:
            if kind == "open":
                depth.append(BRACKETS[tok])
            elif tok == depth[-1]:
                depth.pop()
            buf.append(tok)
        elif kind == "hard":
            flush(";")
        elif kind == "comma":
            flush(",")
        elif kind == "word":
            flush("and")
        elif kind == "quote":
            if not "".join(buf).strip(_TRIM) and tok in QUOTES and _closes(text, QUOTES[tok], end, failed):
                buf.clear()
                quoted, quote_end = True, QUOTES[tok]
            else:
                buf.append(tok)
        elif kind == "open":
            if _closes(text, BRACKETS[tok], end, failed):
                depth.append(BRACKETS[tok])
            buf.append(tok)
        else:
            buf.append(tok)
    flush("")
    return out


def _family_like(value: str) -> bool:
    return " " not in value and "." not in value and not _WIDE.search(value) and bool(_LETTER.search(value))


def _given_like(value: str) -> bool:
    """Initials, or one given name that initials may follow."""
    if _WIDE.search(value):
        return False
    if _INITIALS.fullmatch(value):
        return True
    head, _, rest = value.partition(" ")
    return bool(_LETTER.search(head)) and (not rest or bool(_INITIALS.fullmatch(rest.strip())))


def split_packed(text: str | None, names: bool = True) -> list[str]:
    """The values of a packed field in order; empty for null, empty and blank fields.

    With names, a comma joins what it divides where that reads "Family, Given" or "Family, G. H.",
    and a suffix such as "Jr." stays with its name. Quotes that enclose a value are removed and
    doubled quotes and backslash escapes in it are resolved; a quote that never closes is an
    ordinary character, as is one inside a value.
    """
    if not text:
        return []
    out: list[str] = []
    open_family = False  # the last value is one word that a given name may follow
    unpaired = False  # the last value is unquoted and has had nothing joined to it
    for value, quoted, before in _pieces(text):
        if names and not quoted and before == "," and out:
            if value.lower() in SUFFIXES:
                out[-1] += f", {value}"
                open_family = unpaired = False
                continue
            if (open_family and _given_like(value)) or (unpaired and _INITIALS.fullmatch(value) and "." in value):
                out[-1] += f", {value}"
                open_family = unpaired = False
                continue
        out.append(value)
        open_family = not quoted and _family_like(value)
        unpaired = not quoted and not _WIDE.search(value)
    return out


_java = lambda signs: "".join(f"\\x{{{ord(c):x}}}" for c in signs)
_SPECIAL = rf"[\\{_java(HARD + COMMA + _QUOTE_SIGNS + ''.join(BRACKETS))}]|\s(?:{'|'.join(JOINING_WORDS)})\s"
_ENDS = f"^[{_java(_TRIM)}]+|[{_java(_TRIM)}]+$"
_RESULT = T.ArrayType(T.StringType())


@F.pandas_udf(_RESULT)
def _split_names(values: pd.Series) -> pd.Series:
    return values.map(split_packed)


@F.pandas_udf(_RESULT)
def _split_values(values: pd.Series) -> pd.Series:
    return values.map(lambda v: split_packed(v, names=False))


def explode_packed(df: DataFrame, key: str, column: str, *, names: bool = True, value_name: str = "value") -> DataFrame:
    """One row (key, pos, value) for each value packed in column; pos counts from 1.

    Null, empty and blank fields give no row; empty pieces are dropped and not counted; repeated
    rows come out as often as they are there; other columns, whatever their names, are ignored;
    an empty table gives an empty result. Purely row-wise: no shuffle, so no key can be hot.
    """
    src = df.select(F.col(key).alias("_k"), F.col(column).alias("_v")).filter(F.col("_v").isNotNull())
    # a field without any sign that divides, quotes or nests is one value: it never leaves the JVM
    special = F.col("_v").rlike(_SPECIAL)
    plain = F.array(F.regexp_replace("_v", _ENDS, ""))
    split = (_split_names if names else _split_values)(F.when(special, F.col("_v")))
    values = F.filter(F.when(special, split).otherwise(plain), lambda x: F.length(x) > 0)
    return src.select(F.col("_k"), F.posexplode(values).alias("_p", "_a")).select(
        F.col("_k").alias(key), (F.col("_p") + 1).cast("int").alias("pos"), F.col("_a").alias(value_name)
    )
