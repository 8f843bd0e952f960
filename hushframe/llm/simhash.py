"""Near-duplicates by SimHash, with candidates from pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from hushframe.llm.common import checkpointed, fields, keep_rows, map_rows
from hushframe.llm.components import components

SHINGLE = 4
SEED = 42
#: Largest number of differing bits of a link, and the ring's segments: five, of 13 bits
#: but for the last, so that the budget per segment is below one.
DISTANCE = 4
SEGMENTS = 5
WIDTHS = (13, 13, 13, 13, 12)
STARTS = (0, 13, 26, 39, 52)
#: Members of a bucket that one task compares with each other; larger ones are cut up.
BUCKET = 4096
_ROWS = 1 << 15
_BIT = np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes | None) -> int:
    """64 majority bits of the hashes of all word shingles; 0 without words."""
    words = (text or b"").lower().split()
    n = len(words) - SHINGLE + 1
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if n < 1:
        return digest(join(words), SEED)
    counts = np.zeros(64, np.int64)
    for start in range(0, n, _ROWS):
        hashes = np.array(
            [digest(join(words[i : i + SHINGLE]), SEED) for i in range(start, min(n, start + _ROWS))],
            np.uint64,
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int((np.uint64(1) << _BIT[counts * 2 > n]).sum(dtype=np.uint64))


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, print`` (the fingerprint's bits as bigint) of each whole text, a row per row."""

    def make():
        def run(keys, texts):
            found = [fingerprint(t.encode() if t else None) for t in texts]
            return keys, np.array(found, np.uint64).view(np.int64)

        return run

    return map_rows(df, [key, F.col(text).cast("string")], f"{fields(df, key)}, print bigint", make)


def _mask(first: int, length: int) -> np.uint64:
    """The bits of ``length`` consecutive segments of the ring."""
    bits = 0
    for i in range(first, first + length):
        bits |= ((1 << WIDTHS[i % SEGMENTS]) - 1) << STARTS[i % SEGMENTS]
    return np.uint64(bits)


#: Per start, the further steps of the chain: bits and budget (length * DISTANCE / SEGMENTS).
CHAINS = [
    [(_mask(i, n), n * DISTANCE // SEGMENTS) for n in range(3, SEGMENTS)]
    + [(_mask(i, SEGMENTS), DISTANCE)]
    for i in range(SEGMENTS)
]


def bucket_keys(prints: np.ndarray) -> np.ndarray:
    """Keys by which fingerprints meet: an array of one row per key kind.

    Of a pair within ``DISTANCE`` there is a segment from which on every chain of the
    ring stays within its budget: the first segment equal, the first two with at most
    one differing bit.  A key holds the first segment and the second one without one
    of its bits, for each of its bits.
    """
    keys = []
    for i in range(SEGMENTS):
        j = (i + 1) % SEGMENTS
        one = (prints >> np.uint64(STARTS[i])) & np.uint64((1 << WIDTHS[i]) - 1)
        two = (prints >> np.uint64(STARTS[j])) & np.uint64((1 << WIDTHS[j]) - 1)
        for bit in range(WIDTHS[j]):
            kind = np.uint64((i << 4 | bit) << 26)
            keys.append(kind | one << np.uint64(13) | two & ~np.uint64(1 << bit))
    return np.array(keys, np.uint64)


def linked(x: np.ndarray, y: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``DISTANCE`` whose chain from ``start`` keeps its budgets."""
    steps = CHAINS[start]
    diff = x[:, None] ^ y[None, :]
    mask, budget = steps[0]
    a, b = np.nonzero(np.bitwise_count(diff & mask) <= budget)
    left = diff[a, b]
    for mask, budget in steps[1:]:
        fits = np.bitwise_count(left & mask) <= budget
        a, b, left = a[fits], b[fits], left[fits]
    return a, b


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest connected index of each of ``n`` members."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            one, two = label[a], label[b]
            apart = one != two
            if not apart.any():
                break
            a, b, one, two = a[apart], b[apart], one[apart], two[apart]
            np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
            while (label != label[label]).any():
                label = label[label]
    return label


def _strips(x: np.ndarray, y: np.ndarray, start: int, shift: int):
    step = max(1, (1 << 20) // max(1, len(y)))
    for at in range(0, len(x), step):
        a, b = linked(x[at : at + step], y, start)
        yield a + at, b + shift


def _start(key: int) -> int:
    return int(key) >> 30


def _runs(batches, *columns: str) -> Iterator[list[np.ndarray]]:
    """Whole runs of equal first columns from sorted batches; several runs at a time."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns))]
        if not len(now[0]):
            continue
        last = np.searchsorted(now[0], now[0][-1])
        if last or (held and held[-1][0][-1] != now[0][0]):
            ready = [*held, [c[:last] for c in now]]
            yield [np.concatenate(c) for c in zip(*ready)]
            held = [[c[last:] for c in now]]
        else:
            held.append(now)
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _edges(prints: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    tied = label != np.arange(len(label))
    return prints[tied], prints[label[tied]]


def links(prints: DataFrame) -> DataFrame:
    """Edges ``a, b`` that connect all ``print`` values within ``DISTANCE`` of each other.

    ``prints`` are distinct.  They are dealt by bucket key and sorted; in each bucket
    all members are compared, but only a spanning forest of the links is returned.
    A bucket of more than ``BUCKET`` members is cut into pairs of chunks that are dealt
    anew, so no task compares more than that at once; no link is lost.
    """

    def emit(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(0, len(values), _ROWS):
                part = values[start : start + _ROWS]
                keys = bucket_keys(part).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.tile(part.view(np.int64), len(keys)))],
                    names=["bucket", "print"],
                )

    schema = "a bigint, b bigint, bucket bigint, chunk int, chunks int"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def rows(a=None, b=None, bucket=None, chunk=None, chunks=None) -> pa.RecordBatch:
        given = (a, b, bucket, chunk, chunks)
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(n, f.type) if c is None else pa.array(c, f.type) for c, f in zip(given, arrow)],
            schema=arrow,
        )

    def compare(batches):
        for keys, values in _runs(batches, "bucket", "print"):
            ends = np.flatnonzero(np.diff(keys, append=keys[-1] + 1)) + 1
            begins = np.concatenate(([0], ends[:-1]))
            many = ends - begins > 1
            left, right = [], []
            for at, end in zip(begins[many].tolist(), ends[many].tolist()):
                x = np.sort(values[at:end]).view(np.uint64)
                n, start = len(x), _start(keys[at])
                if n > BUCKET:
                    chunk = np.arange(n) // BUCKET
                    yield rows(
                        x.view(np.int64), None, np.full(n, keys[at]), chunk, np.full(n, chunk[-1] + 1)
                    )
                    continue
                if n == 2:
                    if int(x[0] ^ x[1]).bit_count() <= DISTANCE:
                        left.append(x[1:]), right.append(x[:1])
                    continue
                a, b = _edges(x, forest(n, _strips(x, x, start, 0)))
                left.append(a), right.append(b)
            if left:
                a, b = (np.concatenate(c).view(np.int64) for c in (left, right))
                yield rows(a, b)

    def cross(batches):
        for keys, chunks, values in _runs(batches, "deal", "chunk", "print"):
            ends = np.flatnonzero(np.diff(keys, append=keys[-1] + 1)) + 1
            for at, end in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist()):
                chunk, x = chunks[at:end], values[at:end].view(np.uint64)
                sides = [x[chunk == c] for c in np.unique(chunk)]
                one, two = sides[0], sides[-1]
                both = one if len(sides) == 1 else np.concatenate((one, two))
                shift = 0 if len(sides) == 1 else len(one)
                # the start of the chain is lost in the dealt key: compare in full
                pairs = (
                    (a + i, b + shift)
                    for i in range(0, len(one), 256)
                    for a, b in [_near(one[i : i + 256], two)]
                )
                a, b = _edges(both, forest(len(both), pairs))
                if len(a):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
                    )

    dealt = prints.select("print").mapInArrow(emit, "bucket bigint, print bigint")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket")
    found = checkpointed(dealt.mapInArrow(compare, schema))
    large = found.where("bucket is not null").select(
        "bucket", "chunk", F.col("a").alias("print"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("o")
    )
    pair = F.xxhash64("bucket", F.least("chunk", "o"), F.greatest("chunk", "o"))
    large = large.select(pair.alias("deal"), "chunk", "print")
    large = large.repartition("deal").sortWithinPartitions("deal", "chunk")
    crossed = large.mapInArrow(cross, "a bigint, b bigint")
    return found.where("bucket is null").select("a", "b").union(crossed)


def _near(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= DISTANCE)


def _classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, print, root, component_id``; rows of one class share the root."""
    found = checkpointed(fingerprints(df, key, text))
    nodes = checkpointed(found.groupBy("print").agg(F.min(key).alias("_least")))
    roots = components(links(nodes)).withColumnRenamed("node", "print")
    rooted = nodes.join(roots, "print", "left")
    rooted = checkpointed(
        rooted.select("print", "_least", F.coalesce("root", "print").alias("root"))
    )
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = rooted.join(least, "root").select("print", "root", "component_id")
    return found.join(named, "print").select(key, "print", "root", "component_id")


def near_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, fingerprint, component_id`` of each row of ``df``.

    ``fingerprint`` is the SimHash of the whole text as 16 hexadecimal digits;
    ``component_id`` is the smallest key that links of at most ``DISTANCE`` differing bits
    reach.  Null texts count as empty, and texts without words have the fingerprint
    zero, which is linked like any other.  Rows with a null key take part, but a null
    is the id of a component only if it has no other key.  Repeated rows, and all equal
    fingerprints, are one node.
    """
    digits = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    return _classes(df, key, text).select(key, digits, "component_id")


def keep_first(df: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``df`` that stay, whole: of each component the smallest key's.

    A null key is the largest; of rows that share the key, the smallest fingerprint
    stays, then the longest text.
    """
    found = _classes(df, key, text)
    order = F.struct(F.col(key).isNull(), F.col(key).alias("id"), F.col("print").alias("print"))
    best = found.groupBy("root").agg(F.min(order).alias("_best"))
    kept = F.col(key).eqNullSafe(F.col("_best.id")) & (F.col("print") == F.col("_best.print"))
    found = found.join(best, "root").select(key, kept.alias("kept"), F.col("print").alias("_mark"))

    @F.pandas_udf("bigint")
    def mark(texts: pd.Series) -> pd.Series:
        found = [fingerprint(t.encode() if t else None) for t in texts]
        return pd.Series(np.array(found, np.uint64).view(np.int64))

    return keep_rows(df, key, text, found, mark(F.col(text).cast("string")))
