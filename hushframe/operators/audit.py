"""Audits: each gives one row ``(checked, violations)``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.operators.dictionary import AUTOMATON_CHARS
from hushframe.operators.occurrences import possibly_in
from hushframe.operators.overlap import by_start
from hushframe.operators.tokens import TOKEN_PATTERN, restore_document, restore_text
from hushframe.sources.tables import stage

#: Longer than any token.
TOKEN_LENGTH = 100


def _summary(df: DataFrame, violations: Column) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("checked"),
        F.coalesce(F.sum(violations), F.lit(0)).cast("bigint").alias("violations"),
    )


def _flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def audit_no_leak(df: DataFrame, scrubbed: str = "scrubbed") -> DataFrame:
    """Spans whose raw value still stands in the scrubbed text of their message."""
    leaks = F.filter("detections", lambda d: F.col(scrubbed).contains(d["value"]))
    return df.agg(
        F.coalesce(F.sum(F.size("detections")), F.lit(0)).cast("bigint").alias("checked"),
        F.coalesce(F.sum(F.size(leaks)), F.lit(0)).cast("bigint").alias("violations"),
    )


def audit_span_integrity(df: DataFrame, text: str = "text") -> DataFrame:
    """Spans whose offsets do not cut out their value."""
    wrong = F.filter(
        "detections",
        lambda d: F.substring(F.col(text), d["start"] + 1, d["end"] - d["start"])
        != d["value"],
    )
    return df.agg(
        F.coalesce(F.sum(F.size("detections")), F.lit(0)).cast("bigint").alias("checked"),
        F.coalesce(F.sum(F.size(wrong)), F.lit(0)).cast("bigint").alias("violations"),
    )


def audit_overlap(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Kept spans that start before the one on their left has ended."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    return _summary(
        spans.withColumn("__left", F.lag("end").over(order)),
        _flag(F.col("__left") > F.col("start")),
    )


def audit_round_trip(df: DataFrame, text: str = "text") -> DataFrame:
    """Messages that do not come back from ``scrub_document`` as they were."""
    return _summary(restore_document(df), _flag(F.col("restored") != F.col(text)))


def audit_round_trip_session(
    sent: DataFrame, vault: DataFrame, text: str = "text", scrubbed: str = "scrubbed"
) -> DataFrame:
    """Scrubbed messages that the vault does not restore to what they were."""
    back = restore_text(sent, vault, scrubbed, "restored")
    return _summary(back, _flag(~F.col("restored").eqNullSafe(F.col(text))))


def _values_in(text: Column, values: list[str], spark) -> Column:
    """The distinct ``values`` that stand anywhere in ``text``."""
    shipped = spark.sparkContext.broadcast(values)

    @F.arrow_udf("array<string>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = ahocorasick.Automaton()
        for value in shipped.value:
            automaton.add_word(value, value)
        automaton.make_automaton()
        for texts in batches:
            found = [sorted({v for _, v in automaton.iter(t)}) if t else [] for t in texts.to_pylist()]
            yield pa.array(found, pa.list_(pa.string()))

    return find(text)


def scope_leaks(
    sent: DataFrame, vault: DataFrame, text: str = "scrubbed", chars: int = AUTOMATON_CHARS
) -> DataFrame:
    """Values of a scope's vault that stand in any text sent in that scope.

    Gives ``scope_id, seq, entity_type, token``, so no raw value.  A value may leak in
    another message than the one it was found in: where a detector misses it, or where a
    message was never scrubbed.  Texts are read once, where they are: values of up to
    ``chars`` characters in all become one automaton, of more a bitmap lets those parts of a
    text pass that may be a value (``occurrences``).  Only what was found is joined with the
    vault, by scope and value.  Null texts and rows without a scope hold nothing.
    """
    spark = sent.sparkSession
    values = stage(vault.select("value").where(F.length("value") > 0).distinct())
    size, n = F.octet_length("value").alias("size"), F.count(F.lit(1)).alias("n")
    chars_of = F.sum(F.length("value")).alias("chars")
    sizes = values.groupBy(size).agg(n, chars_of).collect()
    if sum(r["chars"] for r in sizes) <= chars:
        listed = sorted(r["value"] for r in values.collect())
        hits = _values_in(F.col(text), listed, spark) if listed else F.array().cast("array<string>")
    else:
        hits = possibly_in(F.col(text), values, {r["size"]: r["n"] for r in sizes})
    found = sent.select("scope_id", "seq", F.explode(hits).alias("value"))
    known = vault.select("scope_id", "value", "entity_type", "token").distinct()
    return found.distinct().join(known, ["scope_id", "value"]).drop("value")


def _kept_outside(text: Column, scrubbed: Column, detections: Column) -> Column:
    """Whether ``scrubbed`` is the text with a token in place of each span, by position.

    Reads both from left to right: the text between two spans has to be the same, and
    at each span one token stands.  Tokens that the source text has itself are text.
    """

    def step(acc: Column, d: Column) -> Column:
        size = d["start"] - acc["prev"]
        same = F.substring(scrubbed, acc["pos"] + 1, size) == F.substring(
            text, acc["prev"] + 1, size
        )
        rest = F.substring(scrubbed, acc["pos"] + size + 1, F.lit(TOKEN_LENGTH))
        token = F.regexp_extract(rest, f"^(?:{TOKEN_PATTERN})", 0)
        return F.struct(
            (acc["ok"] & same & (token != "")).alias("ok"),
            (acc["pos"] + size + F.length(token)).alias("pos"),
            d["end"].alias("prev"),
        )

    zero = F.struct(F.lit(True).alias("ok"), F.lit(0).alias("pos"), F.lit(0).alias("prev"))

    def rest(acc: Column) -> Column:
        tail = F.substring(text, acc["prev"] + 1, F.length(text))
        return acc["ok"] & (F.substring(scrubbed, acc["pos"] + 1, F.length(scrubbed)) == tail)

    return F.aggregate(by_start(detections), zero, step, rest)


def audit_preserve(df: DataFrame, text: str = "text", scrubbed: str = "scrubbed") -> DataFrame:
    """Messages whose text outside the spans is changed by scrubbing."""
    kept = _kept_outside(F.col(text), F.col(scrubbed), F.col("detections"))
    return _summary(df, _flag(~kept))
