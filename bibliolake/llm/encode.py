"""Encoding of texts with a public byte-level BPE vocabulary, and decoding.

Each piece of a text is a doubly linked list of symbols; a priority queue holds the ranks of the
pairs that stand beside each other, the least rank (the leftmost of equals) merges first, and
entries whose symbols have changed since are skipped when they come up. Decoding concatenates the
byte strings of the ids.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabulary files lie; a parameter of every function here, this is the default.
TOKENIZERS = os.environ.get("BIBLIOLAKE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: how byte-level BPE of this family cuts a text into pieces.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a Python worker keeps, and the longest piece that is kept.
CACHE_PIECES, CACHE_BYTES = 200_000, 48


class BytePairs:
    """Encoder and decoder of one vocabulary, given as ranks of byte strings."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks = ranks
        self.strings = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.cache: dict[str, list[int]] = {}

    @classmethod
    def read(cls, content: bytes) -> BytePairs:
        """The vocabulary of a file of lines "base64 rank"."""
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)})

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for null and empty texts. Strings of special tokens are ordinary text."""
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for piece in self.pattern.findall(text):
            ids = cache.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "replace")
                ids = self.merge(raw)
                if len(raw) <= CACHE_BYTES:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out

    def merge(self, raw: bytes) -> list[int]:
        """The ids of one piece, in O(n log n)."""
        ranks = self.ranks
        n = len(raw)
        if n == 1:
            return [ranks[raw]]
        ends = list(range(1, n + 1))  # symbol i covers raw[i:ends[i]]; 0 marks a symbol that is gone
        before = list(range(-1, n - 1))
        queue = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, end = heapq.heappop(queue)
            middle = ends[i]
            # stale: the left symbol is gone or has grown, or the right one is not what it was
            if not middle or middle >= end or ends[middle] != end:
                continue
            ends[i] = end
            ends[middle] = 0
            if end < n:
                before[end] = i
                rank = ranks.get(raw[i : ends[end]])
                if rank is not None:
                    heapq.heappush(queue, (rank, i, ends[end]))
            j = before[i]
            if j >= 0:
                rank = ranks.get(raw[j:end])
                if rank is not None:
                    heapq.heappush(queue, (rank, j, end))
        out = []
        i = 0
        while i < n:
            out.append(ranks[raw[i : ends[i]]])
            i = ends[i]
        return out

    def decode(self, ids: list[int] | None) -> str | None:
        """The text of ids; null for null. Bytes that are no UTF-8 become replacement characters."""
        if ids is None:
            return None
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


_loaded: dict = {}


def _coder(broadcast) -> BytePairs:
    """The coder of a broadcast vocabulary, built once in each Python worker."""
    content = broadcast.value
    key = (len(content), content[:64])
    if key not in _loaded:
        _loaded[key] = BytePairs.read(content)
    return _loaded[key]


def _vocabulary(spark: SparkSession, name: str, folder: str | None):
    """The vocabulary file as a broadcast: its size is that of the public file, whatever the corpus."""
    with open(os.path.join(folder or TOKENIZERS, f"{name}.tiktoken"), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoder(spark: SparkSession, name: str = "byte_bpe_50k", folder: str | None = None) -> Callable[[str], Column]:
    """A function from a text column to its ids: a list of integers, empty for null and empty texts."""
    broadcast = _vocabulary(spark, name, folder)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        coder = _coder(broadcast)
        return pd.Series([np.array(coder.encode(t), dtype="int32") for t in texts], dtype=object)

    return encode


def counter(spark: SparkSession, name: str = "byte_bpe_50k", folder: str | None = None) -> Callable[[str], Column]:
    """A function from a text column to its number of ids; 0 for null and empty texts."""
    broadcast = _vocabulary(spark, name, folder)

    @F.pandas_udf(T.IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        coder = _coder(broadcast)
        return pd.Series([len(coder.encode(t)) for t in texts], dtype="int32")

    return count


def decoder(spark: SparkSession, name: str = "byte_bpe_50k", folder: str | None = None) -> Callable[[str], Column]:
    """A function from a column of ids to the text; null for null, empty for no ids."""
    broadcast = _vocabulary(spark, name, folder)

    @F.pandas_udf(T.StringType())
    def decode(ids: pd.Series) -> pd.Series:
        coder = _coder(broadcast)
        return ids.map(coder.decode, na_action="ignore")

    return decode


def encode_documents(df: DataFrame, key: str, text: str, *, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """Rows (key, ids). Row by row without a shuffle; whole texts; repeated rows are kept."""
    return df.select(F.col(key), encoder(df.sparkSession, name, folder)(F.col(text)).alias("ids"))
