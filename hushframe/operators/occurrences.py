"""Which of very many values may stand in a text: hashed windows, one pass over the text.

A value of n bytes is known by the hashes of its first and its last 2^k bytes, 2^k being the
largest power of two up to n, which cover it, and by n.  A text gives the hashes of all its
windows of 2^k bytes by doubling.  Bits in which values hash their beginning let few places
pass; there, bits in which values hash both ends and their length are asked for each length.
Every value that stands in a text passes; what else passes is for a join to drop.  Texts and
values are read as UTF-8, where the bytes of one string stand in those of another exactly if
its characters do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each value, and the most bits: of beginnings (for each width, 16 MB), of values (64 MB).
BITS_EACH = 32
MOST_STARTS, MOST_WHOLE = 27, 29
#: Bytes of text that are hashed at once, or twice the longest value.
SEGMENT = 1 << 18

_STARTS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
_WHOLE = tuple(
    np.uint64(x)
    for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
)
_LEFT, _FIRST, _LAST = (
    np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
)
_SIZE = 0x1D8E4E27C47D124F
_HALF = np.uint64(32)
_BYTE = np.arange(1, 257, dtype=np.uint64) * _STARTS[0]
_BYTE ^= _BYTE >> np.uint64(29)
_BYTE *= _FIRST


@dataclass(frozen=True)
class Layout:
    """Byte lengths by width, and where the bits of each width and of whole values begin."""

    lengths: dict[int, tuple[int, ...]]
    starts: dict[int, tuple[int, int]]
    whole: tuple[int, int]

    @property
    def size(self) -> int:
        return self.whole[0] + (1 << self.whole[1])


def layout(counts: dict[int, int]) -> Layout:
    """The layout for so many values (``counts``) of each byte length."""
    lengths: dict[int, tuple[int, ...]] = {}
    for size in sorted(counts):
        width = 1 << (size.bit_length() - 1)
        lengths[width] = (*lengths.get(width, ()), size)
    starts, at = {}, 0
    for width, sizes in lengths.items():
        bits = min(MOST_STARTS, max(15, (BITS_EACH * sum(counts[s] for s in sizes)).bit_length()))
        starts[width] = (at, bits)
        at += 1 << bits
    bits = min(MOST_WHOLE, max(15, (BITS_EACH * sum(counts.values())).bit_length()))
    return Layout(lengths, starts, (at, bits))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, one after the other, and where each begins, and the end."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def _windows(data: np.ndarray, widths: dict) -> Iterator[tuple[int, np.ndarray]]:
    """For each of ``widths`` the hashes of all windows of so many bytes, by their start."""
    hashes, width = _BYTE[data], 1
    while True:
        if width in widths:
            yield width, hashes
        if width >= max(widths) or len(hashes) <= width:
            return
        hashes = hashes[:-width] * _LEFT + hashes[width:]
        hashes ^= hashes >> _HALF
        width *= 2


def _places(hashes: np.ndarray, factor: np.uint64, region: tuple[int, int]) -> np.ndarray:
    at, bits = region
    return ((hashes * factor) >> np.uint64(64 - bits)).astype(np.int64) + at


def _both_ends(first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    both = first * _FIRST + last * _LAST + np.uint64(size * _SIZE % 2**64)
    return both ^ (both >> _HALF)


def _bits_of(values: pa.Array, plan: Layout) -> np.ndarray:
    """The places of all bits that the values set."""
    data, bounds = _bytes_of(values)
    sizes = np.diff(bounds)
    found = [np.zeros(0, np.int64)]
    for width, hashes in _windows(data, plan.lengths):
        at = np.flatnonzero((sizes >= width) & (sizes < 2 * width))
        first = hashes[bounds[at]]
        found += [_places(first, f, plan.starts[width]) for f in _STARTS]
        for size in np.unique(sizes[at]):
            of = at[sizes[at] == size]
            both = _both_ends(hashes[bounds[of]], hashes[bounds[of] + size - width], int(size))
            found += [_places(both, f, plan.whole) for f in _WHOLE]
    return np.unique(np.concatenate(found))


def bitmap(values: DataFrame, plan: Layout) -> np.ndarray:
    """The bits of all values; only bits pass through the driver."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(_bits_of(batch.column(0), plan) + 1)], ["place"])

    bucket, place = F.bitmap_bucket_number("place"), F.bitmap_bit_position("place")
    rows = values.mapInArrow(places, "place bigint")
    rows = rows.groupBy(bucket.alias("b")).agg(F.bitmap_construct_agg(place).alias("m"))
    out = np.zeros(plan.size // 8, np.uint8)
    for b, part in rows.toLocalIterator():
        start = (b - 1) * len(part)
        out[start : start + len(part)] = np.frombuffer(part, np.uint8)[: len(out) - start]
    return out


def _set(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def _found(
    data: np.ndarray, bounds: np.ndarray, plan: Layout, bits: np.ndarray
) -> Iterator[tuple[np.ndarray, int]]:
    """Places in ``data``, and a length, where a value may stand within one text."""
    longest = max(s for sizes in plan.lengths.values() for s in sizes)
    step = max(SEGMENT, 2 * longest)
    for begin in range(0, len(data), step):
        part = data[begin : begin + step + longest - 1]
        for width, hashes in _windows(part, plan.lengths):
            first, region = hashes[:step], plan.starts[width]
            at = np.flatnonzero(_set(bits, _places(first, _STARTS[0], region)))
            at = at[_set(bits, _places(first[at], _STARTS[1], region))]
            at = at[data[begin + at] & 0xC0 != 0x80]
            row = np.searchsorted(bounds, begin + at, "right")
            room = bounds[np.minimum(row, len(bounds) - 1)] - begin - at
            for size in plan.lengths[width]:
                on = at[room >= size]
                both = _both_ends(first[on], hashes[on + size - width], size)
                for factor in _WHOLE:
                    kept = _set(bits, _places(both, factor, plan.whole))
                    on, both = on[kept], both[kept]
                if len(on):
                    yield begin + on, size


def possible_values(texts: pa.Array, plan: Layout, bits: np.ndarray) -> pa.ListArray:
    """The distinct parts of each text that may be one of the values."""
    data, bounds = _bytes_of(texts)
    whole, found = data.tobytes(), [set() for _ in range(len(texts))]
    for places, size in _found(data, bounds, plan, bits):
        rows = np.searchsorted(bounds, places, "right") - 1
        for row, at in zip(rows.tolist(), places.tolist(), strict=True):
            end = at + size
            if end == bounds[row + 1] or whole[end] & 0xC0 != 0x80:
                found[row].add(whole[at:end])
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])])
    parts = pa.array([part for f in found for part in sorted(f)], pa.binary()).view(pa.string())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)


def possibly_in(text: Column, values: DataFrame, counts: dict[int, int]) -> Column:
    """The parts of ``text`` that may be one of ``values``, one column without empty ones.

    ``counts`` tells how many there are of each byte length.
    """
    plan = layout(counts)
    shipped = values.sparkSession.sparkContext.broadcast(bitmap(values, plan))

    @F.arrow_udf("array<string>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield possible_values(texts, plan, shipped.value)

    return find(text)
