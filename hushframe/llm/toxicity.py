"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Words and stems that mark labelled toxic texts become lexicons.  They and a few patterns
vote on every text that may be learned from; a generative model of the votes gives each
text a posterior label; a linear classifier learns those and scores all texts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import fields, map_rows, pieces
from hushframe.sources.tables import stage

_WORD = re.compile(r"[^\W\d_]+")
#: Three capitals or more in a row.
_SHOUT = re.compile(r"[A-ZÀ-ÖØ-Þ]{3,}")
_CACHE = 400_000
#: Lengths of the word beginnings that may become stems.
STEMS = range(4, 8)
#: A word or stem has to mark this many toxic texts, with this likelihood ratio statistic
#: and at least this many times the share that it has among clean texts.
SUPPORT, EVIDENCE, LIFT = 4, 30.0, 4.0
#: Most words and most stems in all lexicons, and the voters they are dealt to.
ENTRIES, LEXICONS = 200, 4
BITS = 15
SIZE = 1 << BITS
#: The CRC-32 that words and stems continue, and buckets in place of missing stems.
_WHOLE, _STEM = zlib.crc32(b"="), zlib.crc32(b"^")
_NONE = tuple((SIZE,) * (1 + len(STEMS) - i) for i in range(2 + len(STEMS)))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def marks_of(words: Iterable[str]) -> set[str]:
    """What may become an entry: ``=word``, and ``^stem`` of longer words."""
    found = set()
    for w in words:
        found.add("=" + w)
        found.update("^" + w[:k] for k in STEMS if k < len(w))
    return found


def held_out(key: str, parts: int = 3, held: int = 1) -> Column:
    """Whether a row is kept out of all learning, by the CRC-32 of its key as text."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")
    return F.crc32(name) % parts == held


# -- lexicons ---------------------------------------------------------------
def sample_labels(labels: DataFrame, key: str, label: str, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` keys of either label, those of the smallest seeded hashes.

    Null keys and other labels are left out; a key with both labels counts as toxic.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1))
    known = known.groupBy(key).agg(F.max(F.col(label).cast("int")).alias("_label"))
    order = F.xxhash64(F.lit(seed), F.col(key)), F.col(key)
    one, none = (known.where(F.col("_label") == v).orderBy(*order).limit(rows) for v in (1, 0))
    return one.union(none)


def mark_counts(df: DataFrame, text: str, label: str) -> DataFrame:
    """``mark, toxic, clean``: texts of either label that hold each mark; and all, as ``''``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            marks = list(counts[0] | counts[1])
            columns = [[c[m] for m in marks] for c in counts[::-1]]
            for c in counts:
                c.clear()
            arrays = [pa.array(marks, pa.string()), *(pa.array(c, pa.int64()) for c in columns)]
            return pa.RecordBatch.from_arrays(arrays, ["mark", "toxic", "clean"])

        for batch in batches:
            for piece in pieces(batch):
                for value, y in zip(*(c.to_pylist() for c in piece.columns)):
                    counts[y].update(marks_of(set(words_of(value))) | {""})
                    if len(counts[0]) + len(counts[1]) >= _CACHE:
                        yield out()
        yield out()

    found = df.select(F.col(text).cast("string"), label)
    found = found.mapInArrow(run, "mark string, toxic bigint, clean bigint")
    return found.groupBy("mark").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


@dataclass(frozen=True)
class Lexicon:
    """Words and stems that mark toxic texts, the strongest first."""

    words: tuple[str, ...]
    stems: tuple[str, ...]


def _gain(a: Column, b: Column, na: int, nb: int) -> Column:
    """The likelihood ratio statistic of a mark that ``a`` of ``na`` and ``b`` of ``nb`` hold."""

    def part(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

    n, rest = na + nb, na + nb - (a + b)
    cells = ((a, a + b, na), (b, a + b, nb), (na - a, rest, na), (nb - b, rest, nb))
    return 2 * sum(part(x, row * F.lit(of) / F.lit(n)) for x, row, of in cells)


def mine(
    df: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int, seed: int
) -> Lexicon:
    """The lexicon of labelled texts, at most ``rows`` of either label.

    Of marks of which one begins with the other only the stronger is taken.
    """
    chosen = F.broadcast(sample_labels(labels, key, label, rows, seed))
    texts = df.select(F.col(key), F.col(text).alias("_text")).join(chosen, key)
    counts = stage(mark_counts(texts, "_text", "_label"))
    whole = counts.where("mark = ''").first()
    if whole is None or not whole["toxic"] or not whole["clean"]:
        return Lexicon((), ())
    na, nb = whole["toxic"], whole["clean"]
    a, b = F.col("toxic"), F.col("clean")
    lift = ((a + 0.5) / (na + 1)) / ((b + 0.5) / (nb + 1))
    found = counts.where((F.col("mark") != "") & (a >= SUPPORT) & (lift >= LIFT))
    found = found.select("mark", _gain(a, b, na, nb).alias("gain")).where(F.col("gain") >= EVIDENCE)
    # stems of one word tie often: the longest, then the word itself, comes first
    order = F.desc(F.round("gain", 6)), F.desc(F.length("mark")), F.desc("mark")
    taken: list[str] = []
    for r in found.orderBy(*order).limit(20 * ENTRIES).collect():
        mark = r["mark"][1:]
        if not any(mark.startswith(t[1:]) or t[1:].startswith(mark) for t in taken):
            taken.append(r["mark"])
    words = [t[1:] for t in taken if t[0] == "="][:ENTRIES]
    stems = [t[1:] for t in taken if t[0] == "^"][:ENTRIES]
    return Lexicon(tuple(words), tuple(stems))


# -- votes ------------------------------------------------------------------
class Words:
    """What a lexicon and the hashing know of each word: its entry and its buckets.

    Words seen are numbered, and their entries and buckets kept in arrays, so that a text
    costs a look-up per distinct word; the arrays start anew when they are large.
    """

    width = 1 + len(STEMS)

    def __init__(self, lexicon: Lexicon, hashed: bool):
        self.hashed = hashed
        self.words = {w: i for i, w in enumerate(lexicon.words)}
        self.stems = {s: len(self.words) + i for i, s in enumerate(lexicon.stems)}
        self.lengths = sorted({len(s) for s in self.stems})
        self.least = min(self.lengths, default=0)
        self.starts = {s[: self.least] for s in self.stems}
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.entries = np.empty(1 << 12, np.int32)
        self.buckets = np.empty((1 << 12, self.width), np.int32)

    def entry(self, word: str) -> int:
        """The number of the entry that a word holds, -1 if none."""
        at = self.words.get(word, -1)
        if at < 0 and word[: self.least] in self.starts:
            found = (self.stems.get(word[:k], -1) for k in self.lengths if k <= len(word))
            at = next((i for i in found if i >= 0), -1)
        return at

    def _add(self, words: list[str]) -> None:
        n = len(self.numbers)
        end = n + len(words)
        while end > len(self.entries):
            self.entries = np.concatenate((self.entries, self.entries))
            self.buckets = np.concatenate((self.buckets, self.buckets))
        self.entries[n:end] = list(map(self.entry, words))
        if self.hashed:
            self.buckets[n:end] = list(map(hashes, words))
        self.numbers.update(zip(words, range(n, end)))

    def of(self, counts: Counter[str]) -> np.ndarray:
        """The numbers of a text's distinct words."""
        if len(self.numbers) > _CACHE:
            self._clear()
        known = self.numbers
        out = list(map(known.get, counts))
        if None in out:
            self._add([w for w, at in zip(counts, out) if at is None])
            out = list(map(known.get, counts))
        return np.array(out, np.int64)


def hashes(word: str) -> tuple[int, ...]:
    """The buckets of a word and of its stems, ``SIZE`` for stems that it is too short for.

    A stem's CRC continues that of the stem before.
    """
    n, crc, last = len(word), zlib.crc32, SIZE - 1
    out = [crc(word.encode(), _WHOLE) & last]
    if n > STEMS[0]:
        at = crc(word[: STEMS[0]].encode(), _STEM)
        out.append(at & last)
        for letter in word[STEMS[0] : min(n - 1, STEMS[-1])]:
            at = crc(letter.encode(), at)
            out.append(at & last)
    return tuple(out) + _NONE[len(out)]


@dataclass
class Measures:
    """A text's distinct words with their counts, and the uses of lexicon entries."""

    numbers: np.ndarray
    counts: np.ndarray
    n_words: int
    hits: dict[int, int]


class Voters:
    """Votes of a text: 1 toxic, -1 clean, 0 nothing to say.

    Each lexicon voter knows a part of the words, each stem voter a part of the stems;
    the others look at all of them together, at shouting and at repeated marks.
    """

    names = (
        *(f"words_{i}" for i in range(LEXICONS)),
        *(f"stems_{i}" for i in range(LEXICONS)),
        "dense",
        "repeated",
        "several",
        "none",
        "shouting",
        "exclaiming",
    )

    def __init__(self, lexicon: Lexicon, hashed: bool = False):
        self.words = Words(lexicon, hashed)

    def measure(self, text: str | None) -> Measures:
        found = Counter(words_of(text))
        numbers = self.words.of(found)
        counts = np.fromiter(found.values(), np.int64, len(found))
        entries = self.words.entries[numbers]
        hits: dict[int, int] = {}
        for at in np.flatnonzero(entries >= 0).tolist():
            entry = int(entries[at])
            hits[entry] = hits.get(entry, 0) + int(counts[at])
        return Measures(numbers, counts, int(counts.sum()), hits)

    def __call__(self, text: str | None, m: Measures) -> list[int]:
        n, split = m.n_words, len(self.words.words)
        parts = [0] * (2 * LEXICONS)
        for at, c in m.hits.items():
            parts[at % LEXICONS if at < split else LEXICONS + (at - split) % LEXICONS] += c
        total = sum(m.hits.values())
        votes = [int(c >= 1) for c in parts[:LEXICONS]] + [int(c >= 2) for c in parts[LEXICONS:]]
        dense = 1 if total >= 2 and total >= 0.01 * n else -1 if total < 0.002 * n else 0
        text = text or ""
        return votes + [
            dense,
            int(max(m.hits.values(), default=0) >= 2),
            int(len(m.hits) >= 3),
            0 if total else -1,
            int(len(_SHOUT.findall(text)) >= 0.3 * n > 0),
            int(text.count("!!") >= 2),
        ]


def vote(df: DataFrame, lexicon: Lexicon, key: str, text: str) -> DataFrame:
    """``key, votes`` of each row, the votes as a string of ``0`` (clean), ``1`` and ``2``."""

    def make():
        voters = Voters(lexicon)

        def run(keys, texts):
            votes = (voters(t, voters.measure(t)) for t in texts)
            return keys, ["".join(str(v + 1) for v in row) for row in votes]

        return run

    return map_rows(df, [key, F.col(text).cast("string")], f"{fields(df, key)}, votes string", make)


# -- label model ------------------------------------------------------------
@dataclass(frozen=True)
class LabelModel:
    """Vote probabilities of both classes, how far voters correlate, and the prior."""

    prior: float
    votes: np.ndarray  # class, voter, vote
    correlations: np.ndarray  # voter, voter: within classes
    shares: np.ndarray  # the part of a voter's evidence that counts

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The probability of the toxic class of each row of vote numbers 0, 1, 2."""
        at = np.arange(patterns.shape[1])
        odds = np.log(self.votes[1, at, patterns] / self.votes[0, at, patterns]) @ self.shares
        odds += math.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def _correlations(values: np.ndarray, weight: np.ndarray) -> np.ndarray:
    weight = weight / max(weight.sum(), 1e-9)
    centred = values - weight @ values
    cov = centred.T @ (centred * weight[:, None])
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    return np.where(np.diag(cov) > 1e-9, 1, 0)[:, None] * cov / np.outer(scale, scale)


def fit_label_model(
    patterns: np.ndarray, counts: np.ndarray, known: np.ndarray, rounds: int = 50
) -> LabelModel:
    """Expectation maximisation over vote patterns and their numbers of texts.

    ``known`` is 0 or 1 where labels say so, -1 elsewhere.  Each round estimates the vote
    probabilities of both classes (a voter's propensity and accuracy) and the correlations
    of voters within the classes; a voter that repeats others counts for a smaller share.
    """
    n, voters = patterns.shape
    hot = np.eye(3)[patterns]
    lean = (patterns - 1).sum(1)
    start = 1 / (1 + np.exp(-np.clip(lean, -20, 20)))
    toxic = np.where(known >= 0, known, start).astype(float)
    model = None
    for _ in range(rounds):
        weights = np.stack((counts * (1 - toxic), counts * toxic))
        votes = np.einsum("cn,nvk->cvk", weights, hot) + np.array([0.5, 0.5, 0.5])
        votes /= votes.sum(2, keepdims=True)
        prior = float(np.clip(weights[1].sum() / weights.sum(), 1e-3, 0.5))
        # the classes' correlations, by how far the classes are seen
        both = [np.abs(_correlations(patterns - 1.0, w)) for w in weights]
        correlations = (1 - prior) * both[0] + prior * both[1]
        np.fill_diagonal(correlations, 0)
        shares = 1 / (1 + correlations.sum(1))
        model = LabelModel(prior, votes, correlations, shares)
        again = np.where(known >= 0, known, model.posterior(patterns))
        if np.abs(again - toxic).max() < 1e-4:
            break
        toxic = again
    return model


# -- classifier -------------------------------------------------------------
class Features:
    """Hashed words and stems of a whole text, and what the lexicons found in it."""

    def __init__(self, lexicon: Lexicon):
        self.voters = Voters(lexicon, hashed=True)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        m = self.voters.measure(text)
        votes = self.voters(text, m)
        buckets = self.voters.words.buckets[m.numbers].ravel()
        sums = np.bincount(buckets, np.repeat(m.counts, Words.width), SIZE + 1)[:SIZE]
        at = np.flatnonzero(sums)
        x = np.log1p(sums[at])
        x /= max(np.linalg.norm(x), 1.0)
        total = sum(m.hits.values())
        own = [0.5 * v for v in votes]
        own += [0.5 * math.log1p(total), 0.5 * math.log1p(len(m.hits))]
        own.append(min(1.0, 20 * total / max(m.n_words, 1)))
        return np.concatenate((at, SIZE + np.arange(len(own)))), np.concatenate((x, own))


WIDTH = SIZE + len(Voters.names) + 3


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    labels: LabelModel
    weights: np.ndarray
    bias: float


def train(
    rows: list[tuple[np.ndarray, np.ndarray]],
    target: np.ndarray,
    prior: float = 1 / 3,
    steps: int = 200,
    rate: float = 0.05,
    penalty: float = 0.05,
) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels.

    Rows are weighted so that a share of ``prior`` is toxic, whatever the sample's share.
    """
    n = len(rows)
    share = min(max(target.mean(), 1e-6), 1 - 1e-6)
    weight = target * prior / share + (1 - target) * (1 - prior) / (1 - share)
    row = np.repeat(np.arange(n), [len(a) for a, _ in rows])
    at, x = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
    params = np.zeros(WIDTH + 1)
    params[-1] = math.log(prior / (1 - prior))
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        eta = np.bincount(row, params[at] * x, n) + params[-1]
        off = weight * (1 / (1 + np.exp(-np.clip(eta, -30, 30))) - target) / n
        grad = np.append(np.bincount(at, off[row] * x, WIDTH), off.sum())
        grad[:-1] += penalty / n * params[:-1]
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        params -= rate * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return params[:-1].astype(np.float32), float(params[-1])


def fit(
    df: DataFrame,
    labels: DataFrame,
    key: str,
    text: str,
    label: str,
    labelled: int = 4000,
    rows: int = 2000,
    entries: int = 2_000_000,
    seed: int = 13,
) -> Model | None:
    """Learn from the rows of ``df`` and from ``labels`` (``key, label`` 0 or 1).

    Lexicons are mined from at most ``labelled`` texts of either label.  All rows of ``df``
    vote; patterns of votes are counted, so the label model sees every row while the driver
    gets the distinct patterns only (at most 3 to the number of voters, some hundreds in
    fact).  The classifier is trained on at most ``rows`` texts of either leaning of the
    posterior and at most ``entries`` features, by seeded hash.  None without labels of
    both kinds.
    """
    lexicon = mine(df, labels, key, text, label, labelled, seed)
    truth = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1))
    toxic = F.max(F.col(label).cast("int")).alias("_label")
    truth = truth.groupBy(F.col(key).alias("_key")).agg(toxic)
    votes = vote(df.where(F.col(key).isNotNull()), lexicon, key, text)
    votes = stage(votes.join(truth, F.col(key) == F.col("_key"), "left").drop("_key"))
    seen = votes.groupBy("votes", F.coalesce("_label", F.lit(-1)).alias("known")).count()
    seen = sorted(tuple(r) for r in seen.collect())
    if {0, 1} - {known for _, known, _ in seen}:
        return None
    patterns = np.array([[int(c) for c in p] for p, _, _ in seen])
    counts = np.array([c for *_, c in seen], float)
    known = np.array([k for _, k, _ in seen])
    model = fit_label_model(patterns, counts, known)
    table = [
        (p, k, float(q if k < 0 else 0.02 + 0.96 * k))
        for (p, k, _), q in zip(seen, model.posterior(patterns))
    ]
    table = df.sparkSession.createDataFrame(table, "votes string, known int, target double")
    on = ["votes", "known"]
    known_or_not = F.coalesce("_label", F.lit(-1))
    leaning = votes.withColumn("known", known_or_not).join(F.broadcast(table), on)
    order = F.xxhash64(F.lit(seed), F.col(key)), F.col(key)
    high, low = (
        leaning.where(c).orderBy(*order).limit(rows) for c in ("target >= 0.5", "target < 0.5")
    )
    chosen = stage(high.union(low).select(F.col(key), "target"))

    def make():
        features = Features(lexicon)

        def run(keys, texts, targets):
            pairs = [features(t) for t in texts]
            order = [zlib.crc32(str(k).encode()) for k in keys]
            return keys, order, targets, [len(a) for a, _ in pairs], *zip(*pairs)

        return run

    texts = df.select(F.col(key), F.col(text).cast("string").alias("_text"))
    texts = texts.join(F.broadcast(chosen), key)
    schema = f"{fields(df, key)}, turn bigint, target double, n bigint, at array<int>, x array<float>"
    found = stage(map_rows(texts, [key, "_text", "target"], schema, make))
    sizes = found.select("turn", "n").collect()
    total, last = 0, -1
    for turn, n in sorted((r["turn"], r["n"]) for r in sizes):
        total += n
        if total > entries:
            break
        last = turn
    got = [
        (r["turn"], str(r[0]), r["target"], np.array(r["at"], np.int64), np.array(r["x"]))
        for r in found.where(F.col("turn") <= last).toLocalIterator()
    ]
    got.sort(key=lambda r: (r[0], r[1], len(r[3])))
    if not got:
        return None
    weights, bias = train([(r[3], r[4]) for r in got], np.array([r[2] for r in got]))
    return Model(lexicon, model, weights, bias)


def score(
    df: DataFrame, model: Model | None, key: str, text: str, enough: float = 0.7
) -> DataFrame:
    """``key, score, predicted`` of each row's whole text.

    ``score`` is the classifier's probability, ``predicted`` 1 if it is at least ``enough``.
    Null texts count as empty.  Without a model the score is 0.
    """
    if model is None:
        return df.select(key, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = Features(model.lexicon)
        for texts in batches:
            out = []
            for t in texts:
                at, x = features(t)
                eta = float(model.weights[at] @ x) + model.bias
                out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, eta)))))
            yield pd.Series(out, dtype=float)

    scored = df.select(key, run(F.col(text).cast("string")).alias("score"))
    return scored.select(key, "score", (F.col("score") >= enough).cast("int").alias("predicted"))
