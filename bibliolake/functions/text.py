"""Unicode forms as column expressions: compatibility form, case folding, trims.

The JVM has no NFKC function, so values that may change (a quick check in the JVM) go to an Arrow
UDF; all others, nearly all, never leave generated code.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Fixed value: Latin ligatures, in whose place case folding puts their letters.
LIGATURES = "ﬀﬁﬂﬃﬄﬅﬆ"


@lru_cache(None)
def _stable() -> str:
    """A pattern of values of the commonest characters that NFKC never changes, by rule. A class costs
    the JVM as many steps a character as it has ranges, so the two commonest are a class of their own."""
    ranges: list[list[int]] = []
    for o in [*range(0x20), *range(0x7F, 0x300), *range(0x370, 0x530), *range(0x2010, 0x2070), *range(0x3001, 0x3041)]:
        if unicodedata.is_normalized("NFKC", chr(o)):
            if ranges and ranges[-1][1] == o - 1:
                ranges[-1][1] = o
            else:
                ranges.append([o, o])
    ranges.sort(key=lambda r: (not r[0] <= 0xE9 <= r[1], r[0]))
    others = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)
    return f"\\A(?:[\\x{{20}}-\\x{{7e}}\\x{{4e00}}-\\x{{9fff}}]++|[{others}])*+\\z"


@F.pandas_udf(T.StringType())
def _nfkc_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def nfkc(c: Column) -> Column:
    """The compatibility form, exactly."""
    return F.coalesce(_nfkc_udf(F.when(~c.rlike(_stable()), c)), c)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_order_udf(lists: pd.Series) -> pd.Series:
    return lists.map(lambda v: sorted(v, key=lambda x: (unicodedata.normalize("NFKC", x), x)), na_action="ignore")


def nfkc_order(c: Column) -> Column:
    """A list of strings without nulls in the order of their compatibility form, then of themselves."""
    changing = F.exists(c, lambda x: ~x.rlike(_stable()))
    return F.coalesce(_nfkc_order_udf(F.when(changing, c)), F.array_sort(c))


def casefold(c: Column) -> Column:
    """Case folding: lower case, ss for sharp s, and the letters of Latin ligatures."""
    c = F.lower(c)
    for letter in "ß" + LIGATURES:
        c = F.replace(c, F.lit(letter), F.lit(letter.casefold()))
    return c


def folded(c: Column) -> Column:
    return casefold(nfkc(c))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def and_for_ampersand(c: Column) -> Column:
    return F.replace(c, F.lit("&"), F.lit(" and "))


def in_order(values: Column) -> Column:
    """The distinct non-empty entries in the order in which they come."""
    return F.filter(F.array_distinct(values), lambda x: x.isNotNull() & (x != ""))


# the same forms in SQL


@lru_cache(None)
def _sql_single() -> tuple[str, str]:
    """Characters whose NFKC is another single one, and what they become, by rule."""
    blocks = [*range(0xA0, 0x250), *range(0x2000, 0x2070), *range(0x2100, 0x2190), *range(0x2E80, 0x3001), *range(0xF900, 0xFB00), *range(0xFF00, 0xFFF0)]
    pairs = [(chr(o), n) for o in blocks if len(n := unicodedata.normalize("NFKC", chr(o))) == 1 and n != chr(o)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def sql_nfkc(x: str) -> str:
    """SQL for the compatibility form: single characters, Latin ligatures and composition."""
    a, b = (s.replace("'", "''") for s in _sql_single())
    for ligature in LIGATURES:
        x = f"replace({x}, '{ligature}', '{unicodedata.normalize('NFKC', ligature)}')"
    return f"nfc_normalize(translate({x}, '{a}', '{b}'))"


def sql_folded(x: str) -> str:
    return f"replace(lower({sql_nfkc(x)}), 'ß', 'ss')"


def sql_casefold(x: str) -> str:
    for ligature in LIGATURES:
        x = f"replace({x}, '{ligature}', '{ligature.casefold()}')"
    return f"replace(lower({x}), 'ß', 'ss')"


SQL_SPACE = "[\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"


def sql_collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SQL_SPACE}+', ' ', 'g'))"
