"""Importance resampling towards a target text table.

Rows are scored by an array of bucket gains.  The cutoff of the draw is found by exact
counts over the persisted scores, the ranks by range partitions of the drawn rows alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import fields, map_rows, pieces
from hushframe.sources.tables import stage

#: Words are runs of ASCII digits and letters and of all characters beyond ASCII, whose
#: UTF-8 bytes are all 0x80 or more.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_WORDS = 1 << 16

SIZE = 10_000
LONGEST = 2
#: Thresholds that one count job tries: fifteen do four steps of a bisection.
PROBES = 15


def features(text: bytes | None, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray]]:
    """Per block of words: their number, and the CRC-32 of every run that ends there.

    Only A-Z is lower-cased.  Runs have one to ``longest`` words, joined by a space; the
    CRC of a run continues that of the run without its last word.
    """
    found = (m.group() for m in _WORD.finditer((text or b"").lower()))
    held: list[bytes] = []
    while block := list(islice(found, _WORDS)):
        words = held + block
        level = list(map(crc32, words))
        runs = level[len(held) :]
        for k in range(1, longest):
            level = list(map(crc32, words[k:], map(crc32, repeat(b" "), level)))
            runs += level[max(0, len(held) - k) :]
        yield len(block), np.array(runs, np.int64)
        held = words[len(words) - min(len(words), longest - 1) :]


def bucket_counts(
    df: DataFrame, text: str, size: int = SIZE, longest: int = LONGEST
) -> DataFrame:
    """``bucket, n``: features of all whole texts per bucket, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for piece in pieces(batch):
                for value in piece.column(0).to_pylist():
                    for _, crcs in features(value, longest):
                        counts += np.bincount(crcs % size, minlength=size)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    body = df.select(F.col(text).cast("string").cast("binary"))
    found = body.mapInArrow(run, "bucket bigint, n bigint")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the thousandfold logarithm of its smoothed share in the target to its
    share in the raw rows, rounded down."""
    size = len(raw)
    all_raw, all_target = float(raw.sum() + size), float(target.sum() + size)
    pairs = zip(raw.tolist(), target.tolist())
    return np.array(
        [math.floor(1000 * math.log((t + 1) * all_raw / ((s + 1) * all_target))) for s, t in pairs],
        np.int64,
    )


def _array(counts: DataFrame, size: int) -> np.ndarray:
    """Counts as an array of ``size`` entries, which is all that reaches the driver."""
    out = np.zeros(size, np.int64)
    for r in counts.collect():
        out[r["bucket"]] = r["n"]
    return out


def scored(
    df: DataFrame,
    gain: np.ndarray,
    key: str,
    text: str,
    seed: int,
    longest: int = LONGEST,
) -> DataFrame:
    """``key, n_words, n_features, weight, score`` of each row.

    ``weight`` is the mean gain of the row's features, rounded down (0 without features);
    ``score`` adds thousandfold Gumbel noise drawn from a hash of seed and key.
    """
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    digits = F.substring(F.sha2(name.cast("binary"), 256), 1, 8)
    draw = F.conv(digits, 16, 10).cast("bigint")

    def make():
        size = len(gain)

        def run(keys, texts, draws):
            words, runs, weights, scores = [], [], [], []
            for value, h in zip(texts, draws):
                n = m = total = 0
                for block, crcs in features(value, longest):
                    n, m = n + block, m + len(crcs)
                    total += int(gain[crcs % size].sum())
                noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
                weight = total // m if m else 0
                words.append(n), runs.append(m), weights.append(weight)
                scores.append(weight + noise)
            return keys, words, runs, weights, scores

        return run

    schema = f"{fields(df, key)}, n_words bigint, n_features bigint, weight bigint, score bigint"
    return map_rows(df, [key, F.col(text).cast("string").cast("binary"), draw], schema, make)


def threshold(df: DataFrame, value: Column, n: int, probes: int = PROBES) -> int:
    """The smallest number that at least ``n`` values of ``df`` do not exceed.

    Numeric bisection: each job counts all rows exactly under ``probes`` thresholds.
    Nothing is sorted or collected, so ties and hot values cost nothing.  ``df`` has to
    have ``n`` values that are not null.
    """
    low, high = df.agg(F.min(value), F.max(value)).first()
    while low < high:
        marks = sorted({low + (high - low) * i // (probes + 1) for i in range(1, probes + 1)})
        counts = df.agg(*(F.count_if(value <= F.lit(m)) for m in marks)).first()
        enough = [c >= n for c in counts]
        at = enough.index(True) if any(enough) else len(marks)
        low, high = marks[at - 1] + 1 if at else low, marks[at] if at < len(marks) else high
    return low


def drawn(df: DataFrame, n: int, score: str, key: str) -> Column:
    """Which rows of ``df`` are among the ``n`` of highest score, ties to smaller keys.

    Null keys come last.  Rows that share the last score and key are all taken, so there
    may be more than ``n``.  ``df`` is read once per count job: pass a written table.
    """
    if n < 1:
        return F.lit(False)
    cut = -threshold(df, -F.col(score), n)
    above, tied = F.col(score) > cut, F.col(score) == cut
    row = df.agg(
        F.count_if(above).alias("above"), F.count_if(tied & F.col(key).isNotNull()).alias("tied")
    ).first()
    left = n - row["above"]
    if left > row["tied"]:
        return above | tied
    last = threshold(df.where(tied & F.col(key).isNotNull()), F.col(key), left)
    return F.coalesce(above | (tied & (F.col(key) <= last)), F.lit(False))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with its place in ``order`` as ``rank``, from 1, without a global window.

    Rows are dealt by range and sorted within their parts; what the parts before hold is
    added.  The parts are written before they are counted, so a retry changes nothing.
    """
    place = F.monotonically_increasing_id()
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", place)
    parts = stage(parts)
    part = F.shiftright("_at", 33)
    sizes = sorted(parts.groupBy(part.alias("part")).count().collect())  # one row per part
    before, starts = 0, []
    for of, rows in sizes:
        starts.append((of, before))
        before += rows
    starts = F.broadcast(df.sparkSession.createDataFrame(starts, "_part bigint, _before bigint"))
    joined = parts.join(starts, part == F.col("_part"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    rank = (F.col("_before") + within + 1).alias("rank")
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), rank)


def resample(
    df: DataFrame,
    target: DataFrame,
    key: str,
    text: str,
    target_text: str,
    percent: int = 25,
    least_words: int = 20,
    seed: int = 7,
    longest: int = LONGEST,
    size: int = SIZE,
) -> DataFrame:
    """``key, n_features, weight, score, rank`` of each row of ``df``.

    Of the rows with ``least_words`` words or more, ``percent`` of them (rounded down) with
    the highest scores are drawn and ranked from 1, ties to the smaller key; the others'
    rank is null.  That is sampling without replacement, a row's chance growing with the
    exponential of its weight.

    ``key`` is an integer.  Null texts have no words; null keys draw alike and come last.
    Rows that share score and key come in the order of ``n_features``; what still ties has
    equal results.  An empty ``df`` gives no row; against an empty target all buckets are
    smoothed alike.  Only the ``size`` bucket counts of either side reach the driver.
    """
    raw = _array(bucket_counts(df, text, size, longest), size)
    aim = _array(bucket_counts(target, target_text, size, longest), size)
    found = scored(df, gains(raw, aim), key, text, seed, longest)
    found = found.select(
        F.col(key).cast("bigint").alias("_key"),
        "n_features",
        "weight",
        "score",
        (F.col("n_words") >= least_words).alias("_fit"),
    )
    found = stage(found)
    fit = found.where("_fit")
    n = fit.count() * percent // 100
    taken = F.col("_fit") & drawn(fit, n, "score", "_key")
    order = F.desc("score"), F.asc_nulls_last("_key"), F.asc("n_features")
    ranks = ranked(found.where(taken), *order)
    ranks = ranks.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    rest = found.where(~taken).withColumn("rank", F.lit(None).cast("bigint"))
    return ranks.unionByName(rest).select(
        F.col("_key").alias(key), "n_features", "weight", "score", "rank"
    )
