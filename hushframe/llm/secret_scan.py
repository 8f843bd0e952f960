"""Secret scan: fixed patterns, and Markov models of random strings and identifiers."""

from __future__ import annotations

import base64
import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import fields, hash_sample, map_rows
from hushframe.llm.spans import Taken, matches, ordered

#: The kinds of spans and their patterns.
KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODES = np.full(128, -1, np.int64)
_CODES[[ord(c) for c in ALPHABET]] = range(len(ALPHABET))
START = len(ALPHABET)
LEAN = 8
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_WORD = re.compile(r"[A-Za-z0-9+/_=-]{6,}")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Assignments with a value of 6 or more characters, access keys, long hex runs."""
    found = [
        ("assign", m.start(), m.end())
        for m in _ASSIGN.finditer(text)
        if m.end(2) - m.start(2) >= 6
    ]
    found += matches("access", _ACCESS, text)
    found += matches("hex", _HEX, text)
    return found


def codes(value: str) -> np.ndarray:
    return _CODES[np.frombuffer(value.encode("ascii"), np.uint8)]


@dataclass(frozen=True)
class Markov:
    """``ratio[a, b]``: log-likelihood ratio of the transition a to b, random to ordinary."""

    ratio: np.ndarray

    def score(self, value: str) -> float:
        c = codes(value)
        before = np.concatenate(([START], c[:-1]))
        return float(self.ratio[before, c].sum())


def fit(samples: DataFrame, value: str, random: str) -> Markov:
    """First-order models of both classes from labelled strings.

    ``random`` is true for random strings and false for ordinary ones.  Tasks count
    transitions in a matrix of fixed size; the sums that reach the driver have at most
    two rows per pair of characters.  Rare transitions lean on the class's share of the
    character, with the weight of ``LEAN`` counts, and shares start at one half.  Null
    values or labels and strings with other characters teach nothing.
    """
    n = START + 1

    def make():
        def count(values, labels):
            sums = np.zeros((2, n, n), np.int64)
            for v, label in zip(values, labels, strict=True):
                if v and label is not None and v.isascii():
                    c = codes(v)
                    if c.min() >= 0:
                        np.add.at(sums[int(label)], (np.concatenate(([START], c[:-1])), c), 1)
            at = np.flatnonzero(sums)
            return at.tolist(), sums.ravel()[at].tolist()

        return count

    counted = map_rows(samples, [value, random], "pair bigint, n bigint", make)
    sums = np.zeros(2 * n * n)
    for row in counted.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        sums[row["pair"]] += row["n"]
    sums = sums.reshape(2, n, n)[:, :, :START]
    share = sums.sum(1, keepdims=True) + 0.5
    share /= share.sum(2, keepdims=True)
    logs = np.log((sums + LEAN * share) / (sums.sum(2, keepdims=True) + LEAN))
    return Markov(logs[1] - logs[0])


def labelled_strings(df: DataFrame, key: str, text: str, rows: int = 2000, seed: int = 11):
    """Labelled samples ``value, random`` from at most ``rows`` rows (by seeded key hash).

    Random: the values of the rows' base spans, and strings drawn for each key from a
    seeded SHA-256 in hexadecimal, base 64 and base 32.  Ordinary: the rows' words outside
    base spans, and identifiers made of neighbouring words in the usual styles.
    """
    chosen = hash_sample(df, key, rows, seed)
    texts = df.select(key, text).join(chosen, key, "left_semi")

    def make():
        def sample(keys, texts):
            values, labels = [], []
            for k, t in zip(keys, texts, strict=True):
                t = t or ""
                raw = hashlib.sha256(f"{seed}:{k}".encode()).digest()
                strings = [
                    raw.hex()[:40],
                    base64.b64encode(raw).decode().rstrip("="),
                    base64.urlsafe_b64encode(raw[::-1]).decode().rstrip("="),
                    base64.b32encode(raw).decode().rstrip("="),
                ]
                base = base_spans(t)
                strings += [m.group(2) for m in _ASSIGN.finditer(t) if len(m.group(2)) >= 6]
                strings += [t[s:e] for kind, s, e in base if kind != "assign"]
                taken = Taken(base)
                words = [m.group() for m in _WORD.finditer(t) if taken.free(m.start(), m.end())]
                made = []
                for i in range(0, len(words) - 2, 3):
                    a, b, c = (w.lower() for w in words[i : i + 3])
                    made += [f"{a}_{b}_{c}", f"{a}{b.title()}{c.title()}", f"{a}-{b}-{c}"]
                    made += [f"{a}_{b}".upper(), f"{a}/{b}/{c}", f"{a}_{i % 100}"]
                values += strings + words + made
                labels += [True] * len(strings) + [False] * (len(words) + len(made))
            return values, labels

        return sample

    return map_rows(texts, [key, text], "value string, random boolean", make)


def scan(
    df: DataFrame,
    model: Markov,
    key: str,
    text: str,
    per_char: float = 1.0,
    total: float = 24.0,
) -> DataFrame:
    """All secrets of each whole text: ``key, spans array<struct<kind,start,end,score>>``.

    Base spans come first and stay, with score 1.  Every further run of 20 or more
    characters of the base-64 alphabets that holds a letter and does not overlap a base
    span is a ``markov`` span if its log-likelihood ratio is at least ``total`` and at
    least ``per_char`` per character; its score is the logistic of the mean ratio.  A
    null text counts as empty and has no spans; equal keys give a row each.
    """

    def make():
        def find(keys, texts):
            out = []
            for t in texts:
                t = t or ""
                base = base_spans(t)
                spans = [(k, s, e, 1.0) for k, s, e in base]
                taken = Taken(base)
                for m in _RUN.finditer(t):
                    run, s, e = m.group(), m.start(), m.end()
                    if not run.isascii() or not any(c.isalpha() for c in run):
                        continue
                    if not taken.free(s, e):
                        continue
                    ratio = model.score(run)
                    if ratio >= total and ratio >= per_char * (e - s):
                        spans.append(("markov", s, e, 1 / (1 + math.exp(-ratio / (e - s)))))
                out.append(ordered(spans, KINDS))
            return keys, out

        return find

    spans = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
    return map_rows(df, [key, text], f"{fields(df, key)}, spans {spans}", make)
