"""Pattern detectors: one narrow pass over the text, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions import patterns as P
from hushframe.functions.spans import SPANS, empty_spans, gaps, locate, matches, settle, unfused
from hushframe.functions.text import luhn_valid


@dataclass(frozen=True)
class Detector:
    """A pattern, what it finds, and cheap tests that every match implies."""

    name: str
    det_ord: int
    entity_type: str
    pattern: str
    digit: bool = True  # every match has a digit
    part: str = ""  # every match has this part
    like: str | None = None  # every match has a part like this
    first: str = ""  # what a match starts with
    after: str = ""  # what no match starts after
    score: float = 0.95
    ignore_case: bool = False

    @property
    def java(self) -> str:
        return P.java_pattern(self.pattern, self.ignore_case, self.first, self.after)


DETECTORS: dict[str, Detector] = {
    d.name: d
    for d in (
        Detector("email", 0, "EMAIL_ADDRESS", P.EMAIL, digit=False, part="@"),
        Detector(
            "phone", 1, "PHONE_NUMBER", P.PHONE, like=r"[0-9]{4}|\+[0-9]",
            first=r"[\d+(]", after=r"\d(?=[\d(])",
        ),
        # det_ord 2 is the national phone format, chosen by language.
        Detector("card", 3, "CREDIT_CARD", P.CARD, first=r"\d"),
        Detector("iban", 4, "IBAN_CODE", P.IBAN, first="[A-Z]"),
        Detector("ssn", 5, "SSN", P.SSN, first=r"\d"),
        Detector("ipv4", 6, "IP_ADDRESS", P.IPV4, like=r"[0-9]\.[0-9]", first=r"\d"),
        Detector(
            "ipv6", 7, "IP_ADDRESS", P.IPV6, digit=False, part=":",
            like=":[0-9a-fA-F]{1,4}:", first="[0-9a-fA-F]",
        ),
        Detector("btc", 8, "CRYPTO", P.BTC, first="[13b]"),
        Detector("eth", 9, "CRYPTO", P.ETH, part="0x", first="0"),
        Detector(
            "secret", 10, "SECRET_KEY", P.SECRET, digit=False,
            # \W stands for what may precede a secret, it is tested faster
            like=r"(?:\A|\W)(?i:bearer|token|passw|secret|api[_-]?key|sk-|gh[ps]_|glpat-|eyj)",
            score=0.9, ignore_case=True,
        ),
        Detector(
            "dob", 11, "DATE_OF_BIRTH", P.DOB, first="[db]", score=0.8, ignore_case=True,
        ),
    )
}
PHONE_LOCALE_ORD = 2
_LANGS = {
    lang: P.java_pattern(p, first=r"\d") for lang, p in P.PHONE_BY_LANG.items()
}


def _guarded(text: Column, detector: Detector) -> Column:
    """The matches, looked for only where the cheap tests leave a chance; else NULL."""
    hint = F.col("__digit") if detector.digit else F.lit(True)
    if detector.part:
        hint = hint & F.contains(text, F.lit(detector.part))
    if detector.like:
        hint = hint & text.rlike(detector.like)
    return F.when(hint, matches(text, detector.java))


def _locale_pattern(lang: Column) -> Column:
    """The national phone pattern of a language, NULL where there is none."""
    pattern = F.lit(None).cast("string")
    for code, national in _LANGS.items():
        pattern = F.when(lang == code, F.lit(national)).otherwise(pattern)
    return pattern


def _apart(columns: dict[str, Column]) -> dict[str, Column]:
    """The columns as a projection of its own (see ``unfused``)."""
    first = next(iter(columns), None)
    return {n: unfused(c) if n == first else c for n, c in columns.items()}


def _place(text: Column, found: Column) -> Column:
    """Where the only match starts, from 1, if its value stands in the text once; else NULL."""
    value = F.get(found, F.lit(0))
    at = F.instr(text, value)
    once = (F.size(found) == 1) & (F.call_function("locate", value, text, at + 1) == 0)
    return F.when(once, at)


def _span(entity: Column, score: Column, order: Column, end: Column, value: Column) -> Column:
    return F.struct(
        entity.alias("entity_type"),
        (end - F.length(value)).alias("start"),
        end.alias("end"),
        score.alias("score"),
        value.alias("value"),
        F.lit("regex").alias("source"),
        order.alias("det_ord"),
    )


def _without_lead(value: Column) -> Column:
    """A secret without the separator in front of it."""
    return F.regexp_replace(value, P.java_pattern(P.SECRET_LEAD), "")


def _without_label(value: Column) -> Column:
    """A labelled birth date without its label."""
    return F.regexp_extract(value, P.java_pattern(P.DOB, ignore_case=True, groups=True), 1)


#: The part of a match that is the span, by detector order; both cuts are at its start.
_NARROWED = {
    DETECTORS["secret"].det_ord: _without_lead,
    DETECTORS["dob"].det_ord: _without_label,
}
_CARD = DETECTORS["card"].det_ord


def _single(order: int, entity: str, score: float, name: str) -> Column:
    """The spans of a detector that found nothing, or one match that has its place.

    That needs neither a second scan with the pattern nor a function of each element.
    """
    only, at = F.get(F.col(f"__found_{name}"), F.lit(0)), F.col(f"__at_{name}")
    value = F.col(f"__value_{name}") if order in _NARROWED else only
    one = F.array(
        _span(F.lit(entity), F.lit(score), F.lit(order), at - 1 + F.length(only), value)
    )
    valid = at.isNotNull()
    if order == _CARD:
        valid = valid & luhn_valid(only)
    return F.when(valid, one).otherwise(empty_spans())


def _several(parts: Sequence[tuple[int, str, float, str]]) -> Column:
    """The spans of all detectors where some match has to be placed by the gaps.

    One function serves all detectors, which keeps the plan small.
    """
    by_part = F.array(
        *(
            F.struct(
                F.lit(order).alias("order"), F.lit(entity).alias("entity"),
                F.lit(score).alias("score"), F.col(f"__found_{name}").alias("found"),
                F.col(f"__at_{name}").alias("at"), F.col(f"__gaps_{name}").alias("gaps"),
            )
            for order, entity, score, name in parts
        )
    )

    def narrowed(order: Column, value: Column) -> Column:
        part = value
        for det_ord, cut in _NARROWED.items():
            part = F.when(order == det_ord, cut(value)).otherwise(part)
        return part

    def placed(p: Column) -> Column:
        only = F.get(p["found"], F.lit(0))
        start = p["at"] - 1
        one = F.struct(
            start.alias("start"), (start + F.length(only)).alias("end"), only.alias("value")
        )
        where = F.when(p["at"].isNotNull(), F.array(one)).otherwise(locate(p["found"], p["gaps"]))
        return F.transform(
            where,
            lambda s: _span(
                p["entity"], p["score"], p["order"], s["end"], narrowed(p["order"], s["value"])
            ),
        )

    hit = F.filter(by_part, lambda p: p["at"].isNotNull() | p["gaps"].isNotNull())
    spans = F.flatten(F.transform(hit, placed))
    return F.filter(spans, lambda s: (s["det_ord"] != _CARD) | luhn_valid(s["value"]))


def detect(
    df: DataFrame,
    names: Sequence[str] | None = None,
    text: str = "text",
    lang: str | None = "lang",
    out: str = "detections",
) -> DataFrame:
    """Add the spans of the named detectors (all by default), in detector order.

    ``lang`` names the column that picks the national phone format (the
    pseudo-detector ``phone_locale``); None leaves that format out.  A NULL text
    gives a NULL array.
    """
    wanted = set(names) if names is not None else {*DETECTORS, "phone_locale"}
    chosen = [d for d in DETECTORS.values() if d.name in wanted]
    with_locale = lang is not None and "phone_locale" in wanted
    body = F.col(text)

    # First only the matches: they are nearly always missing, and the
    # offsets below are worked out for the few that are not.
    hints = {"__digit": body.rlike("[0-9]")}
    found = {f"__found_{d.name}": _guarded(body, d) for d in chosen}
    patterns = {d.name: d.java for d in chosen}
    parts = [(d.det_ord, d.entity_type, d.score, d.name) for d in chosen]
    if with_locale:
        hints["__national"] = F.when(body.rlike("[0-9]"), _locale_pattern(F.col(lang)))
        patterns["phone_locale"] = F.col("__national")
        found["__found_phone_locale"] = F.when(
            F.col("__national").isNotNull(), matches(body, F.col("__national"))
        )
        parts.append((PHONE_LOCALE_ORD, "PHONE_NUMBER", 0.95, "phone_locale"))
    parts.sort()
    staged = df.withColumns(hints).withColumns(_apart(found))

    # Each step is a projection of plain expressions; only texts where a value stands twice
    # need functions of elements.
    places = {f"__at_{name}": _place(body, F.col(f"__found_{name}")) for *_, name in parts}
    between = {
        f"__gaps_{name}": F.when(
            F.col(f"__at_{name}").isNull() & (F.size(f"__found_{name}") > 0),
            gaps(body, patterns[name]),
        )
        for *_, name in parts
    }
    values = {
        f"__value_{name}": F.when(
            F.col(f"__at_{name}").isNotNull(),
            _NARROWED[order](F.get(F.col(f"__found_{name}"), F.lit(0))),
        )
        for order, *_, name in parts
        if order in _NARROWED
    }
    staged = staged.withColumns(_apart(places)).withColumns(_apart(between | values))
    if parts:
        plain = F.coalesce(*between).isNull()
        singles = F.flatten(
            F.array(*(_single(*part) for part in parts))
        )
        spans = F.when(body.isNull(), F.lit(None).cast(SPANS)).when(plain, singles)
        spans = spans.otherwise(_several(parts))
    else:
        spans = F.when(body.isNotNull(), empty_spans())
    staged = staged.withColumn("__detections", spans)
    used = [*hints, *found, *places, *between, *values, "__detections"]
    return settle(staged, out, F.col("__detections")).drop(*used)


def hits_only(df: DataFrame, detections: str = "detections") -> DataFrame:
    """Keep messages with at least one span (see ``settle``)."""
    rest = [c for c in df.columns if c != detections]
    hit = F.when(F.size(detections) > 0, F.array(detections))
    return df.select(*rest, F.explode(hit).alias(detections))


def explode_detections(
    df: DataFrame, keys: Sequence[str], detections: str = "detections"
) -> DataFrame:
    """One row per span, with the message keys and without the text."""
    spans = F.when(F.size(detections) > 0, F.col(detections))
    return df.select(*keys, F.explode(spans).alias("__d")).select(*keys, "__d.*")
