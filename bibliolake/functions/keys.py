"""Match keys of titles and names, one expression for each rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bibliolake.functions.text import (
    SQL_SPACE,
    and_for_ampersand,
    casefold,
    collapsed,
    folded,
    nfkc,
    sql_collapsed,
    sql_folded,
    sql_nfkc,
    sql_strip,
    strip,
)

# What each key keeps, drops or turns into spaces.
KEPT, KEPT_WITH_DOT = "[^0-9a-z一-鿿]+", "[^0-9a-z一-鿿.]+"
# the same for the JVM: its negated classes of several ranges take ten times as long as plain ones
_NOT_KEPT = r"[\x{0}-\x{2f}\x{3a}-\x{60}\x{7b}-\x{4dff}\x{a000}-\x{10ffff}]+"
_NOT_KEPT_WITH_DOT = _NOT_KEPT.replace(r"\x{2f}", r"\x{2d}\x{2f}", 1)
SEPARATORS = r"[:：,，\-–—/()（）\[\]]+"
DROPPED = r"""[.,:;·()\[\]{}'"/\\-]+"""
DROPPED_OR_SPACE = r"""(?U)[\s.,:;·()\[\]{}'"/\\-]+"""


def title_key(c: Column) -> Column:
    """Letters of the Latin alphabet, digits and Han characters only; `&` reads "and"."""
    return F.regexp_replace(and_for_ampersand(folded(c)), _NOT_KEPT, "")


def dotted_key(c: Column) -> Column:
    """As title_key, full stops kept: it tells "A.B" from "AB"."""
    return F.regexp_replace(and_for_ampersand(folded(c)), _NOT_KEPT_WITH_DOT, "")


def _without_the(key: Column) -> Column:
    return F.regexp_replace(key, r"(?s)^the(?=.)", "")


def signatures(c: Column) -> tuple[Column, Column]:
    """title_key and dotted_key without a leading "the" (even as the beginning of a word)."""
    return _without_the(title_key(c)), _without_the(dotted_key(c))


def lookup_keys(c: Column) -> Column:
    """The distinct signatures of two characters or more."""
    return F.filter(F.array_distinct(F.array(*signatures(c))), lambda x: F.length(x) >= 2)


def spelling_key(c: Column) -> Column:
    """Separators as spaces, one space at a time, without a leading "the "."""
    key = collapsed(F.regexp_replace(and_for_ampersand(folded(c)), SEPARATORS, " "))
    return F.regexp_replace(key, "^the ", "")


def exact_key(c: Column) -> Column:
    """The compatibility form, trimmed, case folded."""
    return casefold(strip(nfkc(c)))


def normalized_key(c: Column) -> Column:
    """exact_key without spaces and listed punctuation, then without a leading "the"."""
    key = F.regexp_replace(F.regexp_replace(and_for_ampersand(exact_key(c)), r"(?U)\s+", ""), DROPPED, "")
    return _without_the(key)


def conservative_key(c: Column) -> Column:
    """exact_key without a leading "the ", then without spaces and listed punctuation."""
    key = exact_key(c)
    key = F.regexp_replace(key, "^the ", "")
    return F.regexp_replace(and_for_ampersand(key), DROPPED_OR_SPACE, "")


def person_key(c: Column) -> Column:
    """Letters and numbers of a name only."""
    return F.regexp_replace(folded(c), r"[^\p{L}\p{N}]+", "")


def people_keys(authors: Column) -> Column:
    """The distinct person keys of a list of names, in order; the list goes through one string."""
    joined = F.array_join(F.transform(F.filter(authors, lambda x: x.isNotNull()), lambda x: F.translate(x, "\n", " ")), "\n")
    keys = F.transform(F.split(folded(joined), "\n"), lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}]+", ""))
    return F.coalesce(F.array_distinct(F.filter(keys, lambda x: x != "")), F.array().cast("array<string>"))


def work_key(c: Column) -> Column:
    """A title with single spaces and case folded; no compatibility form."""
    return casefold(collapsed(c))


# the same keys in SQL


def sql_title_key(x: str, kept: str = KEPT) -> str:
    return f"regexp_replace(replace({sql_folded(x)}, '&', ' and '), '{kept}', '', 'g')"


def sql_dotted_key(x: str) -> str:
    return sql_title_key(x, KEPT_WITH_DOT)


def sql_without_the(x: str) -> str:
    return f"regexp_replace({x}, '^the(.)', '\\1')"


def sql_spelling_key(x: str) -> str:
    spaced = f"regexp_replace(replace({sql_folded(x)}, '&', ' and '), '{SEPARATORS}', ' ', 'g')"
    return f"regexp_replace({sql_collapsed(spaced)}, '^the ', '')"


def sql_exact_key(x: str) -> str:
    return f"replace(lower({sql_strip(sql_nfkc(x))}), 'ß', 'ss')"


def _sql_dropped() -> str:
    return DROPPED.replace("'", "''")


def sql_normalized_key(x: str) -> str:
    spaceless = f"regexp_replace(replace({sql_exact_key(x)}, '&', ' and '), '{SQL_SPACE}+', '', 'g')"
    return sql_without_the(f"regexp_replace({spaceless}, '{_sql_dropped()}', '', 'g')")


def sql_conservative_key(x: str) -> str:
    key = f"replace(regexp_replace({sql_exact_key(x)}, '^the ', ''), '&', ' and ')"
    return f"regexp_replace(regexp_replace({key}, '{SQL_SPACE}+', '', 'g'), '{_sql_dropped()}', '', 'g')"
