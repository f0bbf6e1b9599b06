"""Mapping free-entered values to a canonical list: a trie of entries under a Levenshtein automaton.

Titles, aliases and derived paths (without filling words, as initials of abbreviations) of all
entries lie in one trie. A value is folded and looked up along exact paths first; else the trie is
walked under a bit-parallel automaton that accepts whatever lies within a distance that depends on
the value's length, counting a swap of neighbours as one edit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bibliolake.common import join_by_counted_key, materialize, release
from bibliolake.llm.unify import canonical

# Filling words of titles, marks around a title that are no part of it.
FILLING = frozenset("of the on in for and to a an at de la le les du des der die das und et y e".split())
BODY_WORDS = frozenset(["society"])
LEADING = r"^(?:in|source|journal name|title|刊名|期刊|期刊名称|来源|载)\s*[:：]\s*"
TRAILING = (
    r"[\s,，.;:]*(?:"
    r"\(\s*(?:online|print|electronic|网络版|电子版|在线版|印刷版)\s*\)"
    r"|[ep]?-?issn\s*:?\s*\d{4}-?\d{3}[\dx]"
    r"|(?<=[\s,，.;(\[])(?:vol(?:ume)?|no|issue|第)?\.?\s*\d+\s*[卷期]?\s*\(\s*\d+\s*\)"
    r"|(?<=[\s,，;])\(?\[?(?:19|20)\d\d\]?\)?"
    r"|(?<=\s)[\[(](?:19|20)\d\d[\])]"
    r"|\s编辑部|(?<=[^\W\d_])杂志社|\s杂志社|[/|]\s*$"
    r")\s*[\]\)]?\s*$"
)
FORMS = "journal annals advances studies transactions proceedings archives letters bulletin memoirs report perspectives reviews acta"
_INVERTED = re.compile(rf"^(.+?)[,，]\s*((?:{'|'.join(FORMS.split())})(?:\s+(?:of|on|in|for))?)\s*$")
_LEADING, _TRAILING = re.compile(LEADING), re.compile(TRAILING)
_TOKEN = re.compile(r"[^\W_]+")
_HAN = re.compile("[぀-ヿ㐀-鿿豈-﫿]")
_HAN_RUN = re.compile(r"[㐀-鿿豈-﫿（）()·・:：\s]*[㐀-鿿豈-﫿][㐀-鿿豈-﫿（）()·・:：\d\s]*")

#: The largest part of the reference list that is broadcast at a time; a longer list comes in blocks.
BLOCK_ENTRIES = 100_000
#: Values whose result a Python worker keeps.
CACHE_VALUES = 20_000
NONE = "none"
#: More than a value has forms.
RANKS = 8


def folded(value: str) -> str:
    """A value without case, accents, look-alike characters and ampersands, its words still apart."""
    value = canonical(value).casefold()
    if not value.isascii():
        value = unicodedata.normalize("NFKC", value)
        value = "".join(c for c in unicodedata.normalize("NFD", value) if not unicodedata.combining(c)).replace("ø", "o").replace("ł", "l").replace("æ", "ae")
    return re.sub("[和及]", "与", value.replace("&", " and ").strip())


def bare(value: str) -> str:
    """A folded value without the labels, issue numbers and imprints around its title."""
    value = _LEADING.sub("", value)
    while True:
        shorter = _TRAILING.sub("", value)
        if shorter == value or not shorter:
            return value
        value = shorter


def joined(tokens: Iterable[str]) -> str:
    out = "".join(tokens)
    return out[3:] if out.startswith("the") and len(out) > 6 else out


def _content(tokens: list[str]) -> list[str]:
    return [t for t in tokens if t not in FILLING and t not in BODY_WORDS]


def most_edits(key: str) -> int:
    """The distance that a value of this length may have; a value in Han characters may have one edit."""
    if _HAN.search(key):
        return 1 if len(key) >= 5 else 0
    return 0 if len(key) < 6 else 1 if len(key) < 14 else 2


class Entries:
    """The trie of a reference list (or of a block of it, with the words of the whole list)."""

    def __init__(self, rows: Iterable[tuple[str, str | None, list[str] | None]], words: Iterable[str] = ()) -> None:
        self.root: dict = {}
        self.words: set[str] = {*FILLING, *words}
        for ident, title, aliases in rows:
            for name in [title, *(aliases or [])]:
                if name and name.strip():
                    self._add(ident, name)

    def _add(self, ident: str, name: str) -> None:
        tokens = _TOKEN.findall(folded(name))
        if not tokens:
            return
        content = _content(tokens)
        self.words.update(tokens)
        self._path(joined(tokens), ident, ())
        if tokens[0] == "the":
            self._path("".join(tokens), ident, ())  # for a mistyped article
        self._path("\x01" + joined(t for t in tokens if t not in FILLING), ident, ())
        if 3 <= len(content) <= 8 and not _HAN.search(name):
            self._path("\x02" + "".join(sorted(t[0] for t in content)), ident, tuple(content))

    def _path(self, key: str, ident: str, content: tuple[str, ...]) -> None:
        node = self.root
        for c in key:
            node = node.setdefault(c, {})
        node.setdefault("", set()).add((ident, content))

    def exact(self, key: str) -> set:
        node = self.root
        for c in key:
            node = node.get(c)
            if node is None:
                return set()
        return node.get("", set())

    def within(self, key: str, most: int, replace: bool = True) -> Iterator[tuple[int, str, str]]:
        """All (distance, path, id) within most edits of key, by depth-first walk under the automaton.

        Its state is one bit set for each number of edits: bit i of set k says that i characters of
        key are accounted for with k edits. Without replace, characters may be missing, superfluous
        or swapped, but not other ones.
        """
        size = len(key)
        accept = 1 << size
        masks: dict[str, int] = {}
        for i, c in enumerate(key):
            masks[c] = masks.get(c, 0) | 1 << i
        start = tuple((1 << (k + 1)) - 1 for k in range(most + 1))
        stack = [(self.root, "", start, None, 0)]
        while stack:
            node, path, state, before, last = stack.pop()
            for c, child in node.items():
                if c == "":
                    for k, bits in enumerate(state):
                        if bits & accept:
                            for ident, _ in child:
                                yield k, path, ident
                            break
                    continue
                if c < " ":
                    continue
                mask = masks.get(c, 0)
                new = (state[0] & mask) << 1
                out = [new]
                for k in range(1, most + 1):
                    old = state[k - 1]
                    bits = (state[k] & mask) << 1 | old | new << 1
                    if replace:
                        bits |= old << 1
                    if before is not None:
                        bits |= (((before[k - 1] & mask) << 1) & last) << 1
                    new = bits & (accept | accept - 1)
                    out.append(new)
                if new:
                    stack.append((child, path + c, tuple(out), state, mask))

    def _abbreviated(self, tokens: list[str]) -> set[str]:
        """Entries of which each word is there as its beginning, in any order."""
        short = _content(tokens)
        if not 3 <= len(short) <= 8 or not all(len(t) >= 3 or t == "j" for t in short):
            return set()
        out = set()
        for ident, content in self.exact("\x02" + "".join(sorted(t[0] for t in short))):
            left = sorted(content, key=len)
            for t in sorted(short, key=len, reverse=True):
                hit = next((w for w in left if w.startswith(t)), None)
                if hit is None:
                    break
                left.remove(hit)
            else:
                out.add(ident)
        return out

    def look_up(self, value: str | None) -> list[tuple[int, str]]:
        """All meant entries as (rank, id), the lowest rank being the surest.

        A rank is RANKS times the level and the number of the form of the value that was found, so
        that blocks of a list can be compared. Level 0: the title or an alias, or its main part;
        1: without filling words; 2: an abbreviation; 3 and more: 2 and the number of edits.
        """
        if not value or not value.strip():
            return []
        whole = folded(value)
        core = bare(whole)
        forms = [whole, core]
        inverted = _INVERTED.match(core)
        if inverted:
            forms.append(f"{inverted[2]} {inverted[1]}")
        if _HAN.search(core) and re.search("[a-z]", core):
            han = "".join(_HAN_RUN.findall(core)).strip()
            forms += [han, bare(re.sub(_HAN, " ", core).strip())]
        token_forms = [t for t in dict.fromkeys(tuple(_TOKEN.findall(f)) for f in forms) if t]
        for n, tokens in enumerate(token_forms):
            found = self.exact(joined(tokens))
            if found:
                return [(n, i) for i, _ in found]
        for n, tokens in enumerate(token_forms):
            found = self.exact("\x01" + joined(t for t in tokens if t not in FILLING))
            if found:
                return [(RANKS + n, i) for i, _ in found]
        for n, tokens in enumerate(token_forms):
            ids = self._abbreviated(list(tokens))
            if ids:
                return [(2 * RANKS + n, i) for i in ids]
        best: dict[str, int] = {}
        for tokens in token_forms[1:] or token_forms:
            key = joined(tokens)
            most = most_edits(key)
            han = bool(_HAN.search(key))
            # words that are all known make another name, not a mistyped one
            if not most or (not han and all(t in self.words for t in tokens)):
                continue
            for k, path, ident in self.within(key, most, replace=not han):
                if re.sub(r"\D", "", path) == re.sub(r"\D", "", key) and (han or self._mistyped(tokens, path)):
                    best[ident] = min(k, best.get(ident, k))
        return [((2 + k) * RANKS, i) for i, k in best.items()]

    def near(self, value: str | None) -> list[tuple[str, int]]:
        """All entries with a title or alias within the distance that the value's length allows, with the
        least distance of each, from 0; of the value's forms that without labels and imprints counts."""
        best: dict[str, int] = {}
        if value and value.strip():
            key = joined(_TOKEN.findall(bare(folded(value))))
            for k, _, ident in self.within(key, most_edits(key)) if key else ():
                best[ident] = min(k, best.get(ident, k))
        return sorted(best.items(), key=lambda x: (x[1], x[0]))

    def _mistyped(self, tokens: tuple[str, ...], path: str) -> bool:
        """Whether the words that path lacks are unknown ones: a known other word makes another name."""
        return all(t in path or t not in self.words or t in FILLING or len(t) < 3 for t in tokens)


_RESULT = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("ids", T.ArrayType(T.StringType()))])
_built: dict = {}


def _entries(block) -> tuple[Entries, dict]:
    """The trie of a broadcast block, built once in each Python worker, with its cache of results."""
    if block.id not in _built:
        _built.clear()  # a pass needs one block
        _built[block.id] = (Entries(block.value, block.words), {})
    return _built[block.id]


class _Block:
    """A broadcast with a name that workers can key by."""

    def __init__(self, spark, rows: list, known: Broadcast | None = None) -> None:
        self.broadcast = spark.sparkContext.broadcast(rows)
        self.known = known
        self.last = True
        self.id = (spark.sparkContext.applicationId, id(self.broadcast), len(rows), hash(str(rows[:3])))

    @property
    def value(self) -> list:
        return self.broadcast.value

    @property
    def words(self) -> list[str]:
        return self.known.value if self.known else []


def _matcher(block: _Block):
    @F.pandas_udf(_RESULT)
    def match(values: pd.Series) -> pd.DataFrame:
        entries, cache = _entries(block)
        levels, ids = [], []
        for v in values:
            hit = cache.get(v) if v is not None else (None, [])
            if hit is None:
                found = entries.look_up(v)
                low = min((k for k, _ in found), default=None)
                hit = (low, sorted({i for k, i in found if k == low}))
                if len(cache) >= CACHE_VALUES:
                    cache.clear()
                cache[v] = hit
            levels.append(hit[0])
            ids.append(hit[1])
        return pd.DataFrame({"level": pd.array(levels, dtype="Int32"), "ids": ids})

    return match


_NEAR = T.ArrayType(T.StructType([T.StructField("entry", T.StringType()), T.StructField("edits", T.IntegerType())]))


def _searcher(block: _Block):
    @F.pandas_udf(_NEAR)
    def search(values: pd.Series) -> pd.Series:
        entries, _ = _entries(block)
        return pd.Series([entries.near(v) for v in values])

    return search


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words(titles: pd.Series, aliases: pd.Series) -> pd.Series:
    rows = ([t, *(a if a is not None else [])] for t, a in zip(titles, aliases))
    return pd.Series([sorted({w for name in names if name and name.strip() for w in _TOKEN.findall(folded(name))}) for names in rows])


def _blocks(reference: DataFrame, ref_key: str, ref_title: str, ref_aliases: str) -> Iterator[_Block]:
    """The reference in blocks of about BLOCK_ENTRIES entries, one at a time: a block's broadcast is
    dropped before the next one is made. The distinct words of the whole list stay beside them."""
    spark = reference.sparkSession
    ref = reference.filter(F.col(ref_key).isNotNull()).select(
        F.col(ref_key).cast("string").alias("_i"), F.col(ref_title).alias("_t"), F.col(ref_aliases).alias("_a")
    )
    n = max(1, -(-ref.count() // BLOCK_ENTRIES))
    known = spark.sparkContext.broadcast([r[0] for r in ref.select(F.explode(_words("_t", "_a"))).distinct().toLocalIterator()]) if n > 1 else None
    for i in range(n):
        part = ref if n == 1 else ref.filter(F.pmod(F.xxhash64("_i"), F.lit(n)) == i)
        block = _Block(spark, sorted((r[0], r[1], list(r[2] or [])) for r in part.toLocalIterator()), known)
        block.last = i + 1 == n
        yield block
        if not block.last:
            block.broadcast.unpersist()


def map_to_list(
    df: DataFrame, key: str, value: str, reference: DataFrame, ref_key: str, ref_title: str, ref_aliases: str
) -> DataFrame:
    """Rows (key, value, entry, level, candidates): each row of df with the entry that its value means.

    entry is 'none' if the value is null, empty, blank or names no entry, or if several entries are
    equally near, which candidates then names; level says how the entry was found (see
    Entries.look_up) and is null for 'none'. candidates is null where nothing was found. Repeated
    rows come out as often as they are there. A list of up to BLOCK_ENTRIES entries is broadcast and
    looked up row by row without a shuffle, so no value can be hot. A longer one is read in blocks:
    one pass over the distinct values for each, whose best finds are written and merged, then a join
    of the rows that broadcasts the finds of hot values. However it is split, the result is the
    same. Entries without a key are ignored, as are null and blank titles and aliases; other columns
    are ignored; an empty table or list gives no rows or only 'none'.
    """
    found = df.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    best: DataFrame | None = None
    for block in _blocks(reference, ref_key, ref_title, ref_aliases):
        match = _matcher(block)
        if best is None and block.last:
            mapped = found.withColumn("_m", match("_v")).select("_k", "_v", F.col("_m.level").alias("level"), F.col("_m.ids").alias("ids"))
            break
        if best is None:
            counted = found.filter(F.col("_v").isNotNull()).groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
            best = materialize(counted.select("_v", "_n", F.lit(None).cast("int").alias("level"), F.array().cast("array<string>").alias("ids")))
        low = F.least("level", "_m.level")

        def kept(level: str, ids: str, low: Column = low) -> Column:
            return F.when(F.col(level) == low, F.col(ids)).otherwise(F.array().cast("array<string>"))

        merged = best.withColumn("_m", match("_v")).select("_v", "_n", low.alias("level"), F.array_distinct(F.concat(kept("level", "ids"), kept("_m.level", "_m.ids"))).alias("ids"))
        following = materialize(merged)
        release(best)
        best = following
    else:
        nothing = found.filter(F.col("_v").isNull()).select("_k", "_v", F.lit(None).cast("int").alias("level"), F.array().cast("array<string>").alias("ids"))
        mapped = join_by_counted_key(found.filter(F.col("_v").isNotNull()), best, ["_v"], "_n").select("_k", "_v", "level", "ids").unionByName(nothing)
    one = F.coalesce(F.size("ids") == 1, F.lit(False))
    return mapped.select(
        F.col("_k").alias(key),
        F.col("_v").alias(value),
        F.when(one, F.col("ids")[0]).otherwise(F.lit(NONE)).alias("entry"),
        F.when(one, F.floor(F.col("level") / RANKS).cast("int")).alias("level"),
        F.when(F.size("ids") > 0, F.array_sort("ids")).alias("candidates"),
    )


def near_entries(df: DataFrame, value: str, reference: DataFrame, ref_key: str, ref_title: str, ref_aliases: str) -> DataFrame:
    """Rows (value, entry, edits): all entries within the length-dependent distance of each distinct
    value, by title or alias, whichever entry the value means. Values without one give no row."""
    asked = materialize(df.select(F.col(value).alias(value)).filter(F.col(value).isNotNull()).distinct())
    out: DataFrame | None = None
    for block in _blocks(reference, ref_key, ref_title, ref_aliases):
        hits = asked.select(value, F.explode(_searcher(block)(value)).alias("_h")).select(value, "_h.entry", "_h.edits")
        hits = hits if block.last and out is None else materialize(hits)
        out = hits if out is None else out.unionByName(hits)
    return out
