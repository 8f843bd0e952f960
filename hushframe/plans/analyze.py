"""From message to decision: language, detectors, dictionary, overlaps, policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.functions.spans import empty_spans
from hushframe.operators.detectors import detect
from hushframe.operators.dictionary import dictionary_matches
from hushframe.operators.language import DEFAULT_LANG, with_language
from hushframe.operators.overlap import resolve_overlaps
from hushframe.operators.policy import (
    DEFAULT_SETTINGS,
    Settings,
    message_decision,
    top_tier,
)


def analyze(
    df: DataFrame,
    settings: Settings = DEFAULT_SETTINGS,
    dictionary: DataFrame | None = None,
    profiles: DataFrame | None = None,
    keys: Sequence[str] = ("scope_id", "seq"),
    default_lang: str = DEFAULT_LANG,
    max_chars: int | None = None,
    keep_raw: bool = False,
) -> DataFrame:
    """Add ``detections``, ``top_tier``, ``decision`` and ``failed`` to messages.

    Without dictionary and profiles this is one narrow pass, in batch and on
    streams.  A text that cannot be analysed (NULL, or longer than ``max_chars``
    where that is set) fails closed: tier high, decision block, in both modes.
    ``keep_raw`` also keeps the spans before overlap resolution, as ``raw``.
    """
    failed = F.col("text").isNull()
    if max_chars is not None:
        failed = failed | (F.length("text") > max_chars)
    guarded = with_language(df, profiles, default=default_lang).withColumn(
        "failed", failed
    )
    body = guarded.withColumn("__body", F.when(~F.col("failed"), F.col("text")))
    if dictionary is not None:
        # before the detectors, which would run twice where the dictionary is joined
        body = dictionary_matches(body, dictionary, keys, text="__body", out="__names")
    found = detect(body, text="__body", out="__hits")
    if dictionary is not None:
        found = found.withColumn("__hits", F.concat("__hits", "__names"))
    found = found.withColumn("detections", F.coalesce(F.col("__hits"), empty_spans()))
    resolved = resolve_overlaps(found)
    decided = resolved.withColumn(
        "top_tier",
        F.when(F.col("failed"), F.lit("high")).otherwise(top_tier(F.col("detections"))),
    ).withColumn(
        "decision",
        F.when(F.col("failed"), F.lit("block")).otherwise(
            message_decision(F.col("detections"), settings)
        ),
    )
    if keep_raw:
        decided = decided.withColumn("raw", F.coalesce(F.col("__hits"), empty_spans()))
    return decided.select(
        *df.columns,
        "failed",
        "detections",
        "top_tier",
        "decision",
        *(["raw"] if keep_raw else []),
    )
