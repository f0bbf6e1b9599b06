"""Abusive, hateful or sexual content: logistic regression over hashed word n-grams and skip-grams.

Words are read through their disguises (look-alike and invisible characters, digits and signs for
letters, stretched, masked and spaced-out words); Han characters count as words. The model is
trained by FTRL-proximal with per-coordinate rates and L1, so that most weights are exactly zero
and the rest is small enough to broadcast. Labels are given for documents while a single sentence
may be the reason, so training alternates: the sentence of a positive document that scores highest
stands for it, all sentences of negative ones are negative, and labels that the model firmly
contradicts are set aside. How often a feature occurs in the whole corpus decides what may speak
for abuse: a feature gets a positive weight only if it is much more frequent in positive documents
than in all documents, which keeps the corpus's own phrases out. A document's score is that of its
worst sentence.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bibliolake.common import materialize
from bibliolake.llm.unify import canonical

#: Hashed features: 2 ** BITS coordinates.
BITS = 22
#: At most so many labelled documents are fitted, the first in the order of a hash of their id.
MOST_LABELLED = 20_000
#: FTRL: learning rate, its offset, L1, L2; passes over the data in a round; rounds.
ALPHA, BETA, L1, L2, PASSES, ROUNDS = 0.3, 1.0, 0.6, 0.5, 3, 4
#: A document is abusive from this score on.
THRESHOLD = 0.3
#: A feature may have a positive weight if at least so many positive documents have it and its lift,
#: how many times as frequent it is in positive documents as in the corpus, is at least this power of
#: the greatest lifts (their 99th percentile, about one by the rate of abuse), and at least 1.5; and if
#: by chance so many positive documents would have it with at most this probability (Poisson tail).
LEAST_POSITIVE, LIFT_POWER, LEAST_LIFT, CHANCE = 2, 0.66, 1.5, 3e-3
#: Word distances of a feature: n-grams of one to four words, pairs that skip one or two.
SHAPES = ((0,), (0, 1), (0, 1, 2), (0, 1, 2, 3), (0, 2), (0, 3))

#: Odd multipliers of 32 bits that spread a hash, and one for each shape.
_SPREAD, _SHAPE = np.uint32(0x9E3779B1), np.array([0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD6E8FEB9, 0x2545F491], dtype=np.uint32)

# Signs that stand for letters, in words that have letters too.
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e"})

_SENTENCE = re.compile(r"[。！？；]+|[.?!…]+(?=\s)|[:;]-?[()](?=\s)|[\r\n]+")
_SPACED = re.compile(r"(?<!\w)[^\W\d_](?:([ \-.*])[^\W\d_])(?:\1[^\W\d_])+(?!\w)")
_SEPARATORS = re.compile(r"[ \-.*]")
_MASKED = re.compile(r"(?<=[^\W\d_])(?:[#*%]+|_{2,})(?=[^\W\d_])")
_MASKS = re.compile(r"[#*%]|__")
_STRETCHED = re.compile(r"([^\W\d_])\1\1+")
_HAN_GAP = re.compile(r"(?<=[㐀-鿿])[\s*\-_.·、~|/+#]+(?=[㐀-鿿])")
_WORD = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+(?:['*@$€!]+[^\W_㐀-鿿]+)*|[@$]+[^\W_㐀-鿿]+")
_PLAIN_WORD = re.compile(r"[a-z0-9]+(?:['*@$!]+[a-z0-9]+)*|[@$]+[a-z0-9]+")


def _read(word: str) -> str:
    """A word as it is read: stretched letters once, a number as 0, signs as the letters that they stand for."""
    word = _STRETCHED.sub(r"\1", word)
    if word.isalpha():
        return word
    if word.isdigit():
        return "0"
    return _STRETCHED.sub(r"\1", word.translate(SIGNS))


def _written(text: str) -> list[list[str]]:
    """The words of each sentence of a whole text as they are written, put together where they are taken
    apart. In plain ASCII no Han character can be, which saves two searches."""
    if text.isascii():
        text = text.lower()
    else:
        text = _HAN_GAP.sub("", canonical(text)).casefold()
    text = _SPACED.sub(lambda m: _SEPARATORS.sub("", m.group()), text)
    if _MASKS.search(text):
        text = _MASKED.sub("*", text)
    if text.isascii():
        return [words for sentence in _SENTENCE.split(text) if (words := _PLAIN_WORD.findall(sentence))]
    text = _STRETCHED.sub(r"\1", text)  # Han characters are words of their own
    return [words for sentence in _SENTENCE.split(text) if (words := _WORD.findall(sentence))]


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence of a whole text, disguises undone."""
    return [[_read(w) for w in words] for words in _written(text)]


class Reader:
    """Texts as codes of their words; a word is hashed once for each worker."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}

    def read(self, text: str | None) -> tuple[bytes, bytes]:
        """(codes of all words, numbers of words of each sentence), 32 bits each; empty for null, empty
        and blank texts."""
        parts = _written(text) if text and not text.isspace() else []
        known, out = self.codes, []
        for words in parts:
            for w in words:
                c = known.get(w)
                if c is None:
                    if len(known) > 500_000:
                        known.clear()
                    c = known[w] = zlib.crc32(_read(w).encode("utf-8", "replace"))
                out.append(c)
        return np.array(out, dtype=np.uint32).tobytes(), np.array([len(p) for p in parts], dtype=np.uint32).tobytes()


#: Words that are made into features at a time.
CHUNK_WORDS = 400_000


class Chunk:
    """Some documents at once: the number of the document of each sentence, and features by shape."""

    def __init__(self, codes: list[bytes], counts: list[bytes]) -> None:
        self.docs = len(codes)
        self.flat = np.frombuffer(b"".join(codes), dtype=np.uint32) * _SPREAD
        sizes = np.frombuffer(b"".join(counts), dtype=np.uint32)
        self.doc_of = np.repeat(np.arange(self.docs), [len(c) // 4 for c in counts])
        self.at = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(feature numbers, sentence numbers), a shape at a time; none reaches beyond its sentence."""
        hashes: dict[tuple[int, ...], np.ndarray] = {}
        for k, shape in enumerate(SHAPES):
            span = shape[-1]
            n = len(self.flat) - span
            if n <= 0:
                continue
            # a shape goes on from the hash of all its offsets but the last
            h = self.flat[:n] if span == 0 else hashes[shape[:-1]][:n] * _SPREAD ^ self.flat[span:]
            h = h ^ h >> np.uint32(15)
            hashes[shape] = h
            h = h * _SHAPE[k]
            h ^= h >> np.uint32(13)
            h &= np.uint32(2**BITS - 1)
            if span == 0:
                yield h, self.at
            else:
                inside = self.at[:n] == self.at[span:]
                yield h[inside], self.at[:n][inside]


def chunks(codes: pd.Series, counts: pd.Series) -> Iterator[Chunk]:
    """The documents of a batch in their order, some CHUNK_WORDS words at a time (a longer one alone)."""
    own, other, words = [], [], 0
    for c, n in zip(codes, counts):
        if own and words + len(c) // 4 > CHUNK_WORDS:
            yield Chunk(own, other)
            own, other, words = [], [], 0
        own.append(c)
        other.append(n)
        words += len(c) // 4
    if own:
        yield Chunk(own, other)


def features_of(codes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, sentence numbers) of one document."""
    parts = list(Chunk([codes], [counts]).features())
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *[f.astype(np.int64) for f, _ in parts]]), np.concatenate([none, *[s for _, s in parts]])


class Ftrl:
    """FTRL-proximal logistic regression on binary features."""

    def __init__(self, allowed: np.ndarray | None = None, size: int = 2**BITS) -> None:
        self.z = np.zeros(size)
        self.n = np.zeros(size)
        self.bias = -3.0
        self.allowed = allowed

    def weights(self, features: np.ndarray) -> np.ndarray:
        z = self.z[features]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[features])) / ALPHA + L2)
        w[np.abs(z) <= L1] = 0
        if self.allowed is not None:
            w[(w > 0) & ~self.allowed[features]] = 0
        return w

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights(features).sum(), -35, 35))))

    def learn(self, features: np.ndarray, y: float, importance: float = 1.0) -> None:
        w = self.weights(features)
        p = 1 / (1 + np.exp(-np.clip(self.bias + w.sum(), -35, 35)))
        g = (p - y) * importance
        n = self.n[features]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[features] += g - sigma * w
        self.n[features] += g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        """The coordinates that are not zero and their weights."""
        at = np.flatnonzero(np.abs(self.z) > L1)
        w = self.weights(at)
        return at[w != 0], w[w != 0].astype(np.float32)


Words = tuple[bytes, bytes]


def _documents(texts: list[Words], labels: list[float]) -> list[tuple[list[np.ndarray], float]]:
    """The features of each sentence of each labelled document that has words."""
    docs = []
    for words, y in zip(texts, labels):
        f, s = features_of(*words)
        if len(f):
            cuts = np.flatnonzero(np.diff(np.sort(s))) + 1
            docs.append(([np.unique(part) for part in np.split(f[np.argsort(s, kind="stable")], cuts)], y))
    return docs


def positive_features(texts: list[Words]) -> tuple[np.ndarray, np.ndarray]:
    """The features that at least LEAST_POSITIVE positive documents have, and in how many; documents of
    the same words count once."""
    own = [np.unique(f) for words in dict.fromkeys(texts) if len(f := features_of(*words)[0])]
    if not own:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    at, n = np.unique(np.concatenate(own), return_counts=True)
    return at[n >= LEAST_POSITIVE], n[n >= LEAST_POSITIVE]


def _log_tail(n: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """A bound of the log probability that a Poisson number of this mean reaches n; 0 where it is likely."""
    factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, int(n.max(initial=0)) + 1)))])
    rest = 1 - mean / (n + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = n * np.log(mean) - mean - factorial[n] - np.log(np.maximum(rest, 1e-12))
    return np.where(rest > 0.1, np.minimum(bound, 0), 0.0)


def fit(texts: list[Words], labels: list[float], corpus: tuple[np.ndarray, np.ndarray], corpus_docs: int) -> Ftrl:
    """The model of labelled documents. corpus says of features, in their order, in how many of all
    corpus_docs documents each occurs; it has all positive_features that occur. Documents without words are ignored; without a positive or a
    negative document the model gives every document a low score."""
    docs = _documents(texts, labels)
    if not any(y >= 0.5 for _, y in docs) or not any(y < 0.5 for _, y in docs):
        return Ftrl()
    at, n = positive_features([t for t, y in zip(texts, labels) if y >= 0.5])
    positives = sum(y >= 0.5 for _, y in docs)
    place = np.minimum(np.searchsorted(corpus[0], at), max(len(corpus[0]) - 1, 0))
    everywhere = np.where(corpus[0][place] == at, corpus[1][place], 0).astype(float) if len(corpus[0]) else np.zeros(len(at))
    lift = np.log((n - 0.5) / (positives + 1)) - np.log((np.maximum(everywhere, n) + 1) / (corpus_docs + 1))
    gain = np.zeros(2**BITS, dtype=np.float32)
    gain[at] = np.maximum(lift, 0)
    allowed = np.zeros(2**BITS, dtype=bool)
    often = lift[n >= 3]
    least = max(np.log(LEAST_LIFT), LIFT_POWER * np.quantile(often, 0.99)) if len(often) else np.log(LEAST_LIFT)
    allowed[at[(lift >= least) & (_log_tail(n, positives * np.maximum(everywhere, n) / max(corpus_docs, 1)) <= np.log(CHANCE))]] = True

    def first(part: np.ndarray) -> float:
        """How strongly a sentence's features speak for abuse before any training."""
        return float(np.sort(np.where(allowed[part], gain[part], 0))[-20:].sum())

    rng = np.random.default_rng(11)
    previous: Ftrl | None = None
    for turn in range(ROUNDS):
        examples: list[tuple[np.ndarray, float]] = []
        for parts, y in docs:
            if y < 0.5:
                for part in parts:
                    # a negative label that the model firmly contradicts is set aside
                    if previous is None or previous.score(part) < 0.9:
                        examples.append((part, 0.0))
            else:
                scores = [first(p) if previous is None else previous.score(p) for p in parts]
                best = int(np.argmax(scores))
                if scores[best] > (0 if previous is None else 0.15):
                    examples.append((parts[best], 1.0))
                if previous is not None:
                    # sentences that the model takes for harmless are negatives, beside the stand-in
                    examples += [(p, 0.0) for i, p in enumerate(parts) if i != best and scores[i] < 0.1]
        stand_ins = sum(y for _, y in examples)
        importance = min(max((len(examples) - stand_ins) / max(stand_ins, 1) / 10, 1.0), 5.0)
        model = Ftrl(allowed)
        for _ in range(PASSES):
            for i in rng.permutation(len(examples)):
                part, y = examples[i]
                model.learn(part, y, importance if y else 1.0)
        previous = model
    return model


class Scorer:
    """Scores by a sparse model; its weights are held as one dense array in each worker."""

    def __init__(self, at: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.dense = np.zeros(2**BITS, dtype=np.float32)
        self.dense[at] = weights
        self.bias = bias

    def scores(self, chunk: Chunk) -> np.ndarray:
        """The score of each document: that of its worst sentence; 0 for documents without words."""
        pairs = []
        for f, s in chunk.features():
            some = np.flatnonzero(self.dense[f])
            pairs.append(s[some].astype(np.int64) << BITS | f[some])
        # a feature counts once in a sentence
        pair = pd.unique(np.concatenate(pairs)) if pairs else np.empty(0, dtype=np.int64)
        sums = np.bincount(pair >> BITS, weights=self.dense[pair & (2**BITS - 1)], minlength=len(chunk.doc_of))
        worst = np.full(chunk.docs, -np.inf)
        np.maximum.at(worst, chunk.doc_of, sums)
        return np.where(np.isfinite(worst), 1 / (1 + np.exp(-np.clip(self.bias + worst, -35, 35))), 0.0)


_WORDS = T.StructType([T.StructField("codes", T.BinaryType()), T.StructField("counts", T.BinaryType())])
_reader = Reader()


@F.pandas_udf(_WORDS)
def _read_words(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_reader.read(t) for t in texts], columns=["codes", "counts"])


def train(words: DataFrame, labels: DataFrame, *, key: str, label: str) -> tuple[np.ndarray, np.ndarray, float]:
    """The sparse weights (coordinates, weights, bias) of a model fitted on labelled documents (_k, codes, counts).

    A document's label is the mean of its judgements, null ones ignored; a tie is no label. At most
    MOST_LABELLED documents are fitted, in one task; only weights that are not zero come back.
    """
    judged = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.avg(F.col(label).cast("double")).alias("_y"))
    judged = judged.filter(F.col("_y") != 0.5).orderBy(F.xxhash64("_k"), "_k").limit(MOST_LABELLED)
    rows = materialize(words.join(F.broadcast(judged), "_k").select("_k", "codes", "counts", "_y"))
    n = words.count()

    def gather(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
        own = [b for b in batches if len(b)]
        return pd.concat(own) if own else None

    def told(data: pd.DataFrame) -> tuple[list[Words], list[float]]:
        data = data[data["_y"].notna()].sort_values("_k", kind="stable")
        return list(zip(data["codes"], data["counts"])), data["_y"].tolist()

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = gather(batches)
        if data is not None:
            yield pd.DataFrame({"at": positive_features(told(data)[0])[0]})

    wanted = np.sort(rows.filter("_y > 0.5").repartition(1).mapInPandas(shared, "at long").toPandas()["at"].to_numpy())
    counts = _corpus_counts(words.select("codes", "counts"), wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = gather(batches)
        if data is not None and data["_y"].notna().any():
            corpus = data[data["_at"].notna()].sort_values("_at")
            model = fit(*told(data), (corpus["_at"].to_numpy(dtype=np.int64), corpus["_n"].to_numpy(dtype=np.int64)), n)
            at, weights = model.sparse()
            yield pd.DataFrame({"at": np.append(at, -1), "w": np.append(weights.astype("float64"), model.bias)})

    # the counts meet the labelled documents in the one task that fits, as rows
    both = rows.unionByName(counts.select(F.col("at").alias("_at"), F.col("n").alias("_n")), allowMissingColumns=True)
    found = both.repartition(1).mapInPandas(run, "at long, w double").toPandas()
    bias = found.loc[found["at"] < 0, "w"]
    own = found[found["at"] >= 0]
    return own["at"].to_numpy(), own["w"].to_numpy(dtype=np.float32), float(bias.iloc[0]) if len(bias) else -3.0


def _corpus_counts(words: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(at, n): in how many of all documents each wanted feature occurs. Each task sums its own. wanted
    holds at most 2 ** BITS numbers, those of features that labelled documents share."""
    sent = words.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        place = np.full(2**BITS, -1, dtype=np.int32)
        place[own] = np.arange(len(own), dtype=np.int32)
        sums = np.zeros(len(own), dtype=np.int64)
        for b in batches:
            for chunk in chunks(b["codes"], b["counts"]):
                pairs = []
                for f, s in chunk.features():
                    at = place[f]
                    some = np.flatnonzero(at >= 0)
                    pairs.append(chunk.doc_of[s[some]] * len(own) + at[some])
                if pairs:
                    sums += np.bincount(pd.unique(np.concatenate(pairs)) % max(len(own), 1), minlength=len(own))
        some = np.flatnonzero(sums)
        yield pd.DataFrame({"at": own[some], "n": sums[some]})

    return words.mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))


_scorers: dict = {}


def score_documents(documents: DataFrame, labels: DataFrame, *, key: str, text: str, label: str, keep: list[str] | None = None) -> DataFrame:
    """Rows (key, keep, score): the probability that a document itself has abusive content.

    Texts are read once: the codes of their words, with key and keep, are written to scratch, and
    counts, model and scores come from these. Null, empty and blank texts score 0; whole texts are
    read; repeated rows are kept; without usable labels all scores are low; an empty table gives an
    empty result.
    """
    spark = documents.sparkSession
    kept = {f"_keep{i}": c for i, c in enumerate(keep or [])}
    words = documents.select(F.col(key).alias("_k"), *[F.col(c).alias(new) for new, c in kept.items()], _read_words(F.col(text)).alias("w"))
    words = materialize(words.select("_k", *kept, "w.codes", "w.counts"))
    model = spark.sparkContext.broadcast(train(words, labels, key=key, label=label))
    name = (spark.sparkContext.applicationId, id(model))

    @F.pandas_udf(T.DoubleType())
    def score(codes: pd.Series, counts: pd.Series) -> pd.Series:
        if name not in _scorers:
            _scorers.clear()
            _scorers[name] = Scorer(*model.value)
        parts = [_scorers[name].scores(chunk) for chunk in chunks(codes, counts)]
        return pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return words.select(F.col("_k").alias(key), *[F.col(new).alias(c) for new, c in kept.items()], score("codes", "counts").alias("score"))
