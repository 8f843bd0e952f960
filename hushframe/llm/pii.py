"""Personal data: patterns propose, checksums confirm, context words adjust the score."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from hushframe.llm.common import fields, map_rows
from hushframe.llm.spans import Taken, ordered

#: The kinds of spans and their patterns.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
CONTEXT = {
    "email": ("mail", "contact", "@"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment", "carte", "karte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
#: Characters before a span in which context words count.
WINDOW = 48
#: Score by pattern alone; a confirmed checksum and a context word each add to it.
PRIOR = {"email": 0.7, "ip": 0.5, "card": 0.4, "phone": 0.5, "iban": 0.3, "ssn": 0.3}
CHECKED, NEAR, ENOUGH = 0.35, 0.25, 0.5
_CHECKED_KINDS = ("card", "iban")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(value: str) -> bool:
    """The check of account numbers: letters as 10 to 35, country and check digits last."""
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str):
    """From each ``@`` to the left and right, in linear time."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = start < at and _DOMAIN.match(text, at + 1)
        if m:
            yield "email", start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the four fixed kinds that pass their checks."""
    found = list(emails(text))
    if "." in text:
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def further_spans(text: str):
    """Account numbers (15 to 34 characters) and social security numbers."""
    for m in _IBAN.finditer(text):
        value = m.group().replace(" ", "")
        while len(value) >= 15:  # words in capitals may follow the number
            if mod97(value):
                end, left = m.start(), len(value)
                while left:
                    left -= text[end] != " "
                    end += 1
                yield "iban", m.start(), end
                break
            cut = m.group()[: _length(m.group(), len(value))].rstrip()
            space = cut.rfind(" ")
            if space < 0:
                break
            value = cut[:space].replace(" ", "")
    for m in _SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", m.start(), m.end()


def _length(text: str, letters: int) -> int:
    """How much of ``text`` holds so many characters other than spaces."""
    for i, c in enumerate(text):
        letters -= c != " "
        if not letters:
            return i + 1
    return len(text)


def score(text: str, kind: str, start: int) -> float:
    before = text[max(0, start - WINDOW) : start].lower()
    near = any(w in before for w in CONTEXT[kind])
    return min(1.0, PRIOR[kind] + CHECKED * (kind in _CHECKED_KINDS) + NEAR * near)


def find_personal_data(df: DataFrame, key: str, text: str) -> DataFrame:
    """All spans of each whole text: ``key, spans array<struct<kind,start,end,score>>``.

    The four base kinds stay whatever their score.  Account numbers (mod-97) and social
    security numbers are added where their score reaches ``ENOUGH`` and they overlap no
    base span; a social security number so needs a context word.  A null text counts as
    empty and has no spans; equal keys give a row each.
    """

    def make():
        def find(keys, texts):
            out = []
            for t in texts:
                t = t or ""
                base = base_spans(t)
                spans = [(*s, score(t, s[0], s[1])) for s in base]
                taken = Taken(base)
                for s in further_spans(t):
                    sure = score(t, s[0], s[1])
                    if sure >= ENOUGH and taken.free(s[1], s[2]):
                        spans.append((*s, sure))
                out.append(ordered(spans, KINDS))
            return keys, out

        return find

    spans = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
    return map_rows(df, [key, text], f"{fields(df, key)}, spans {spans}", make)
