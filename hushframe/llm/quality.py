"""Quality classifier: ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import fields, fresh, map_rows, own_columns
from hushframe.sources.tables import stage

BITS = 16
SIZE = 1 << BITS
_CACHE = 200_000
_KINDS = re.compile(r"([A-ZÀ-Þ])|([a-zß-ÿ])|([0-9])|(\W|_)|(.)", re.DOTALL)


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) & (SIZE - 1)


def shape(word: str) -> str:
    """The whole word's outline: kinds of characters, each run as one, signs as they are."""
    out, last = [], ""
    for m in _KINDS.finditer(word):
        kind = ("X", "x", "9", m.group(), "o")[m.lastindex - 1]
        if kind != last:
            out.append(kind)
        last = kind
    return "".join(out)


class Features:
    """Hashed features of a whole text: words, outlines, repetition, proportions."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def word(self, word: str) -> tuple[int, int]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= _CACHE:
                self.known.clear()
            core = word.lower().strip(".,;:!?\"'()")
            got = self.known[word] = (_hash("w " + core), _hash("s " + shape(word)))
        return got

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        if not words:
            return np.array([_hash("empty")]), np.ones(1)
        counts = Counter(words)
        n = len(words)
        by: dict[int, float] = {}
        for w, c in counts.items():
            for at in self.word(w):
                by[at] = by.get(at, 0) + c
        at = np.fromiter(by, np.int64, len(by))
        x = np.log1p(np.fromiter(by.values(), float, len(by)))
        x /= np.linalg.norm(x)
        chars = sum(map(len, words))
        repeats = sum(a == b for a, b in zip(words, words[1:]))
        upper = sum(c for w, c in counts.items() if w.isupper() and len(w) > 1)
        plain = sum(c for w, c in counts.items() if w.strip(".,").isalpha())
        whole = (
            ("distinct", len(counts) / n * min(1, n / 50)),
            ("top", counts.most_common(1)[0][1] / n),
            ("repeats", repeats / n),
            ("upper", upper / n),
            ("plain", plain / n),
            ("length", min(1.0, chars / n / 20)),
            ("size", min(1.0, np.log2(n + 1) / 20)),
        )
        extra = [_hash(f"d {name} {int(value * 12)}") for name, value in whole]
        return np.concatenate((at, extra)), np.concatenate((x, np.full(len(extra), 0.3)))


@dataclass(frozen=True)
class Ordinal:
    """``P(grade >= grades[k + 1]) = sigmoid(weights . x - thresholds[k])``."""

    grades: tuple[float, ...]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The tail probability of every grade but the lowest."""
        eta = float(self.weights[at] @ x)
        return 1 / (1 + np.exp(np.clip(self.thresholds - eta, -500, 500)))


def fit(
    df: DataFrame,
    ratings: DataFrame,
    key: str,
    text: str,
    grade: str,
    rows: int = 4000,
    entries: int = 4_000_000,
    seed: int = 5,
    steps: int = 300,
    rate: float = 0.1,
    penalty: float = 1e-3,
) -> Ordinal | None:
    """Fit weights and thresholds on at most ``rows`` rated keys (by seeded hash).

    ``ratings`` gives grades to keys of ``df``.  Ratings with a null key or grade are not
    used; of a key with several grades the lowest counts.  The sampled ratings are at
    most ``rows`` rows and so are broadcast; features are made where the texts are.  Only
    features reach the driver, those of the first texts by seeded hash that have at most
    ``entries`` together.  Thresholds stay in order by their positive gaps.  None if fewer
    than two grades are rated.
    """
    rated = ratings.where(F.col(key).isNotNull() & F.col(grade).isNotNull())
    rated = rated.groupBy(key).agg(F.min(F.col(grade).cast("double")).alias("_grade"))
    chosen = rated.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(rows)
    texts = df.select(F.col(key), F.col(text).alias("_text")).join(F.broadcast(chosen), key)
    turn = F.xxhash64(F.lit(seed), F.col(key))

    def make():
        features = Features()

        def vectors(keys, texts, grades, turns):
            pairs = [features(t) for t in texts]
            return keys, grades, turns, [len(a) for a, _ in pairs], *zip(*pairs)

        return vectors

    schema = f"{fields(df, key)}, grade double, turn bigint, n bigint, at array<int>, x array<float>"
    found = stage(map_rows(texts, [key, "_text", "_grade", turn], schema, make))
    total, last = 0, None
    for at, n in sorted(tuple(r) for r in found.select("turn", "n").collect()):
        total += n
        if total > entries and last is not None:
            break
        last = at
    got: dict = {}
    for r in found.where(F.col("turn") <= F.lit(last)).toLocalIterator():
        got.setdefault(r[0], (r["grade"], np.array(r["at"], np.int64), np.array(r["x"])))
    data = [got[k] for k in sorted(got)]
    grades = tuple(sorted({g for g, _, _ in data}))
    if len(grades) < 2:
        return None
    y = np.array([grades.index(g) for g, _, _ in data])
    row = np.repeat(np.arange(len(data)), [len(a) for _, a, _ in data])
    at, x = (np.concatenate([d[i] for d in data]) for i in (1, 2))
    k, n = len(grades) - 1, len(data)
    # Parameters: weights, the first threshold, logarithms of the gaps.
    params = np.zeros(SIZE + k)
    over = np.array([np.clip((y > j).mean(), 1e-3, 1 - 1e-3) for j in range(k)])
    start = np.log((1 - over) / over)
    params[SIZE] = start[0]
    params[SIZE + 1 :] = np.log(np.maximum(np.diff(start), 0.1))
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        gaps = np.exp(params[SIZE + 1 :])
        theta = params[SIZE] + np.concatenate(([0.0], np.cumsum(gaps)))
        eta = np.bincount(row, params[at] * x, n)
        tail = 1 / (1 + np.exp(np.clip(theta[None, :] - eta[:, None], -30, 30)))
        full = np.concatenate((np.ones((n, 1)), tail, np.zeros((n, 1))), axis=1)
        slope = full * (1 - full)
        i = np.arange(n)
        p = np.maximum(full[i, y] - full[i, y + 1], 1e-9)
        low, high = slope[i, y] / p, slope[i, y + 1] / p
        d_eta = (high - low) / n
        grad = np.zeros_like(params)
        grad[:SIZE] = np.bincount(at, d_eta[row] * x, SIZE) + penalty / n * params[:SIZE]
        d_theta = np.zeros(k + 2)
        np.add.at(d_theta, y, low / n)
        np.add.at(d_theta, y + 1, -high / n)
        d_theta = d_theta[1:-1]
        grad[SIZE] = d_theta.sum()
        grad[SIZE + 1 :] = gaps * np.cumsum(d_theta[::-1])[::-1][1:]
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        scale = np.sqrt(square / (1 - 0.99**step)) + 1e-8
        params -= rate * (mean / (1 - 0.9**step)) / scale
    theta = params[SIZE] + np.concatenate(([0.0], np.cumsum(np.exp(params[SIZE + 1 :]))))
    return Ordinal(grades, params[:SIZE].astype(np.float32), theta)


def rating(
    model: Ordinal | None, text: Column, least: float | None = None, enough: float = 0.5
) -> Column:
    """The rating of each whole text: ``struct<expected_grade, tail_prob, kept>``.

    ``tail_prob`` is the probability of a grade of ``least`` or more (by default the
    second lowest) and ``kept`` tells whether it reaches ``enough``.  Null texts count
    as empty.  Without a model nothing is known: both are null and all rows are kept.
    """
    if model is None:
        return F.struct(
            F.lit(None).cast("double").alias("expected_grade"),
            F.lit(None).cast("double").alias("tail_prob"),
            F.lit(True).alias("kept"),
        )
    grades = np.array(model.grades)
    cut = 1 if least is None else int(np.searchsorted(grades, least))
    cut = min(max(cut, 1), len(grades) - 1)

    @F.pandas_udf("expected_grade double, tail_prob double, kept boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features = Features()
        for texts in batches:
            tails = np.array([model.tails(*features(t)) for t in texts])
            tails = tails.reshape(len(texts), len(grades) - 1)
            probs = tails[:, cut - 1]
            yield pd.DataFrame(
                {
                    "expected_grade": grades[0] + tails @ np.diff(grades),
                    "tail_prob": probs,
                    "kept": probs >= enough,
                }
            )

    return run(text)


def rate_texts(
    df: DataFrame,
    model: Ordinal | None,
    key: str,
    text: str,
    least: float | None = None,
    enough: float = 0.5,
) -> DataFrame:
    """``key, expected_grade, tail_prob, kept`` of each row, by ``rating``."""
    rated = rating(model, F.col(text).cast("string"), least, enough)
    return df.select(key, rated.alias("_rating")).select(key, "_rating.*")


def keep_good(
    df: DataFrame,
    model: Ordinal | None,
    text: str,
    least: float | None = None,
    enough: float = 0.5,
) -> DataFrame:
    """The rows of ``df`` that are kept, whole; texts are rated where they are."""
    rated = rating(model, F.col(text).cast("string"), least, enough)
    (name,) = fresh(df, "_rating")
    kept = df.select("*", rated.alias(name)).where(f"{name}.kept")
    return kept.select(*own_columns(df))
