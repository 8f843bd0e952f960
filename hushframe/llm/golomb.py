"""Golomb-Rice codes of sorted integers, with numpy."""

from __future__ import annotations

import numpy as np


def encode(values: np.ndarray) -> tuple[int, int, bytes]:
    """Code sorted distinct non-negative integers: count, remainder width, bytes.

    Gaps are split at ``width`` bits, the width that suits their mean; quotients are
    written in unary, then all remainders in ``width`` bits each.
    """
    n = len(values)
    if not n:
        return 0, 0, b""
    gaps = np.diff(values, prepend=values.dtype.type(0)).astype(np.uint64)
    mean = float(values[-1]) / n
    width = max(0, int(np.log2(max(1.0, mean * np.log(2)))))
    quotients = (gaps >> np.uint64(width)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    shifts = np.arange(width, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return n, width, np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def decode(n: int, width: int, data: bytes) -> np.ndarray:
    """The integers that were coded."""
    if not n:
        return np.empty(0, np.int64)
    tail = (n * width + 7) // 8
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(np.unpackbits(raw[: len(raw) - tail]))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.int64) << width
    if width:
        bits = np.unpackbits(raw[len(raw) - tail :])[: n * width].reshape(n, width)
        gaps += bits.astype(np.int64) @ (np.int64(1) << np.arange(width, dtype=np.int64))
    return np.cumsum(gaps)
