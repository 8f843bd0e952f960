"""Spans of kinds in a text, and the digests that the queries report."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterable, Iterator

Span = tuple[str, int, int]


def matches(kind: str, pattern: re.Pattern, text: str) -> Iterator[Span]:
    for m in pattern.finditer(text):
        yield kind, m.start(), m.end()


def ordered(spans: Iterable[tuple], kinds: tuple[str, ...]) -> list[tuple]:
    """By start, then by the kind's place in ``kinds``, then by end."""
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2]))


def joined(spans: Iterable[tuple]) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def digest(spans: Iterable[tuple]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


class Taken:
    """Disjoint stretches covered by a list of spans, to ask whether a new one is free."""

    def __init__(self, spans: Iterable[tuple]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted((s[1], s[2]) for s in spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start), self.ends.append(end)

    def free(self, start: int, end: int) -> bool:
        at = bisect.bisect_left(self.starts, end) - 1
        return at < 0 or self.ends[at] <= start
