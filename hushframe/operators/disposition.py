"""What happens to a message after its decision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.text import is_blank, scrubbed_notice


def outcome(
    decision: Column, action: Column, blank: Column, failed: Column | None = None
) -> Column:
    """``sent_raw``, ``sent_scrubbed`` or ``held``.

    A message that could not be analysed is held, whatever the decision or action.  A
    blank text is sent without a look at the decision.  A warning follows the
    user's action; a blocked message can only be scrubbed or edited.  Whatever is
    not released is held.
    """
    scrubs = (decision == "auto_scrub") | (
        decision.isin("warn", "block") & (action == "scrub")
    )
    passes = decision.isin("allow", "notify") | (
        (decision == "warn") & (action == "send")
    )
    failed = F.lit(False) if failed is None else F.coalesce(failed, F.lit(True))
    return (
        F.when(failed, F.lit("held"))
        .when(blank, F.lit("sent_raw"))
        .when(scrubs, F.lit("sent_scrubbed"))
        .when(passes, F.lit("sent_raw"))
        .otherwise(F.lit("held"))
    )


def one_action(actions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One action per message: where a message has several different ones, none counts."""
    return actions.groupBy(*keys).agg(
        F.when(F.min("action") == F.max("action"), F.min("action")).alias("action")
    )


def dispose(
    analysed: DataFrame, actions: DataFrame | None, keys: Sequence[str] = ("scope_id", "seq")
) -> DataFrame:
    """Add ``n_detections``, ``action`` and ``outcome``; ``actions`` is ``(keys, action)``.

    What the outcome needs of text and detections is worked out before the join, so they
    are not shuffled where only the outcome is asked for.
    """
    flagged = analysed.withColumn("n_detections", F.size("detections")).withColumn(
        "__blank", is_blank(F.col("text"))
    )
    if actions is None:
        joined = flagged.withColumn("action", F.lit(None).cast("string"))
    else:
        joined = flagged.join(one_action(actions, keys), list(keys), "left")
    return joined.withColumn(
        "outcome",
        outcome(F.col("decision"), F.col("action"), F.col("__blank"), F.col("failed")),
    ).drop("__blank")


def offered_actions(decision: Column, tier: Column) -> Column:
    """Actions offered for a pasted fragment; silent decisions offer none.

    A high tier leaves out sending it as it is.
    """
    return (
        F.when(decision.isin("allow", "notify"), F.lit(""))
        .when(tier == "high", F.lit("scrub,edit"))
        .otherwise(F.lit("scrub,edit,send"))
    )


def entity_summary(detections: Column) -> Column:
    """Distinct entity types in the order of the detections, as one string."""
    return F.array_join(F.array_distinct(detections["entity_type"]), ", ")


def entity_counts(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spans per message and entity type, with the label a list would show."""
    return (
        spans.groupBy(*keys, "entity_type")
        .agg(F.count(F.lit(1)).cast("int").alias("n"))
        .withColumn(
            "label",
            F.when(
                F.col("n") > 1,
                F.concat(F.col("entity_type"), F.lit(" ×"), F.col("n").cast("string")),
            ).otherwise(F.col("entity_type")),
        )
        .withColumn("notice", scrubbed_notice(F.col("n")))
    )


def scrub_count(disposed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Spans in scrubbed messages: occurrences, not distinct values."""
    scrubbed = F.when(F.col("outcome") == "sent_scrubbed", F.col("n_detections"))
    return disposed.groupBy(*by).agg(
        F.coalesce(F.sum(scrubbed), F.lit(0)).cast("bigint").alias("scrub_count")
    )


def exposure_rollup(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """Spans, distinct values and messages by any of the span's columns.

    ``spans`` has one row per span with ``scope_id`` and ``seq``.  Values are
    deduplicated first, so a hot group is reduced before it meets in one task.
    """
    return spans.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_spans"),
        F.count_distinct("value").alias("n_values"),
        # a struct, so that messages without scope or number count like their spans
        F.count_distinct(F.struct("scope_id", "seq")).alias("n_messages"),
    )
