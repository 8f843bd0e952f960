"""Overlap resolution: the best spans win, score first, then length.

Spans are taken by score descending, length descending, detector order, start;
each is kept if it overlaps none kept before.  Spans that touch do not overlap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions.spans import SPANS, empty_spans, let, running, settle


#: Up to so many spans a message is resolved as one island.
FEW_SPANS = 8


def by_rank(spans: Column) -> Column:
    """Sort detections by the rank in which overlap resolution takes them."""
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            (-s["score"]).alias("a"),
            (-F.length(s["value"])).alias("b"),
            s["det_ord"].alias("c"),
            s["start"].alias("d"),
            s.alias("span"),
        ),
    )
    return F.transform(F.sort_array(keyed), lambda k: k["span"])


def by_start(spans: Column) -> Column:
    """Sort detections left to right."""
    keyed = F.transform(
        spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s.alias("span"))
    )
    return F.transform(F.sort_array(keyed), lambda k: k["span"])


def _greedy(spans: Column) -> Column:
    def step(kept: Column, s: Column) -> Column:
        clash = F.exists(
            kept, lambda k: (s["end"] > k["start"]) & (s["start"] < k["end"])
        )
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(s)))

    return F.aggregate(by_rank(spans), empty_spans(), step)


def _islands(spans: Column) -> Column:
    """Group spans into runs that are linked by overlaps."""

    def runs(ordered: Column, reach: Column) -> Column:
        def first(s: Column, i: Column) -> Column:
            opens = (i == 0) | (s["start"] >= F.get(reach, i - 1))
            return F.when(opens, i)

        begins = F.filter(F.transform(ordered, first), lambda i: i.isNotNull())
        return let(
            begins,
            lambda at: F.zip_with(
                at,
                F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(ordered))),
                lambda a, b: F.slice(ordered, a + 1, b - a),
            ),
        )

    return let(
        by_start(spans),
        lambda ordered: let(
            running(ordered["end"], F.greatest), lambda reach: runs(ordered, reach)
        ),
    )


def resolve(spans: Column) -> Column:
    """Resolve overlaps inside one array; the result is in rank order.

    Only spans linked by overlaps are compared with each other, so the cost does
    not grow with the square of the number of spans in a message.  A few spans, as most
    messages have, are compared at once, as finding the islands would cost more.
    """
    per_island = F.transform(
        _islands(spans), lambda i: F.when(F.size(i) > 1, _greedy(i)).otherwise(i)
    )
    return (
        F.when(F.size(spans) <= 1, spans)
        .when(F.size(spans) <= FEW_SPANS, _greedy(spans))
        .otherwise(F.when(spans.isNotNull(), by_rank(F.flatten(per_island))))
    )


def _apart(spans: Column, starts: Column, ends: Column) -> Column:
    """Whether no two of at most ``FEW_SPANS`` spans overlap, given their sorted starts and ends.

    Spans that are not empty lie apart exactly if each but the last one's end comes no later
    than the next start, in sorted order.
    """
    apart = (F.size(spans) <= FEW_SPANS) & ~F.array_contains(spans["value"], "")
    for i in range(FEW_SPANS - 1):
        after = F.get(ends, F.lit(i)) <= F.get(starts, F.lit(i + 1))
        apart = apart & ((F.size(spans) <= i + 1) | after)
    return F.coalesce(apart, F.lit(False))


def resolve_overlaps(df: DataFrame, detections: str = "detections") -> DataFrame:
    """Resolve overlaps in a detections column: narrow, no shuffle.

    Most messages have a few spans that lie apart; they are only sorted.
    """
    spans = F.col(detections)
    ends = {"__starts": F.sort_array(spans["start"]), "__ends": F.sort_array(spans["end"])}
    apart = _apart(spans, F.col("__starts"), F.col("__ends"))
    staged = df.withColumns(ends).withColumn("__apart", apart)
    kept = (
        F.when(F.size(spans) <= 1, spans)
        .when(F.col("__apart"), by_rank(spans))
        .otherwise(resolve(spans))
    )
    staged = staged.withColumn("__kept", kept)
    return settle(staged, detections, F.col("__kept")).drop(*ends, "__apart", "__kept")


def _with_islands(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number the runs of linked spans of each message, and the spans in order."""
    ordered = Window.partitionBy(*keys).orderBy("start", "end", "det_ord", "entity_type")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.when(F.col("start") < F.col("__reach"), F.lit(0)).otherwise(F.lit(1))
    return (
        spans.withColumn("__reach", F.max("end").over(before))
        .withColumn("__pos", F.row_number().over(ordered))
        .withColumn(
            "__island",
            F.sum(opens).over(ordered.rowsBetween(Window.unboundedPreceding, 0)),
        )
    )


def resolve_exploded(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Resolve overlaps in a table with one row per span.

    One shuffle by message, which the windows and the grouping share.  A group is
    one island of one message, so it is bounded by the message, however the
    messages are distributed.
    """
    fields = [f.name for f in SPANS.elementType.fields]
    grouped = (
        _with_islands(spans, keys)
        .groupBy(*keys, "__island")
        .agg(F.collect_list(F.struct(*fields)).cast(SPANS).alias("__spans"))
    )
    kept = F.when(F.size("__spans") > 1, _greedy(F.col("__spans"))).otherwise(
        F.col("__spans")
    )
    return grouped.select(*keys, F.explode(kept).alias("__s")).select(*keys, "__s.*")


def overlap_pairs(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of overlapping spans of a message, earlier span first.

    Spans meet only inside an island, not across a whole message.
    """
    grouped = (
        _with_islands(spans, keys)
        .groupBy(*keys, "__island")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("__pos", "start", "end", "entity_type"))
            ).alias("__spans")
        )
    )

    def with_later(a: Column) -> Column:
        later = F.filter(
            F.col("__spans"),
            lambda b: (b["__pos"] > a["__pos"])
            & (b["start"] < a["end"])
            & (b["end"] > a["start"]),
        )
        return F.transform(later, lambda b: F.struct(a.alias("a"), b.alias("b")))

    pairs = F.flatten(F.transform("__spans", with_later))
    return grouped.select(
        *keys, F.explode(F.when(F.size("__spans") > 1, pairs)).alias("__p")
    ).select(
        *keys,
        F.col("__p.a.entity_type").alias("entity_a"),
        F.col("__p.a.start").alias("start_a"),
        F.col("__p.a.end").alias("end_a"),
        F.col("__p.b.entity_type").alias("entity_b"),
        F.col("__p.b.start").alias("start_b"),
        F.col("__p.b.end").alias("end_b"),
    )


def shadowed(raw: str, kept: str) -> Column:
    """Spans dropped by overlap resolution that are not fully covered.

    Each is returned with the number of its characters left outside all kept
    spans (``clear_chars``): such a part stays in the text as it is.
    """

    def measure(s: Column) -> Column:
        covered = F.aggregate(
            F.col(kept),
            F.lit(0),
            lambda acc, k: acc
            + F.greatest(
                F.lit(0),
                F.least(s["end"], k["end"]) - F.greatest(s["start"], k["start"]),
            ),
        )
        return F.struct(
            s.alias("span"), (s["end"] - s["start"] - covered).alias("clear_chars")
        )

    return F.filter(F.transform(F.col(raw), measure), lambda m: m["clear_chars"] > 0)
