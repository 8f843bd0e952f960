"""Spans in a text: find all matches with offsets, cut the text around them.

Offsets count code points, so ``substring(text, start + 1, end - start)`` is
always the span's value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType(
    [
        T.StructField("entity_type", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("value", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("det_ord", T.IntegerType()),
    ]
)
SPANS = T.ArrayType(SPAN)

FEW_EDITS = 100
FOLD = 256
_MARK = "\u0001"
_PLAIN = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("value", T.StringType()),
        ]
    )
)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often it is used.

    Inside a lambda any expression but the lambda's own variables is evaluated
    again for each element; binding it to a variable avoids that.
    """
    return F.transform(F.array(value), body)[0]


def unfused(value: Column) -> Column:
    """The value, in a projection that Spark compiles on its own, in many small methods.

    Large projections without a function of elements are fused with their neighbours into
    one method, which the JVM leaves to its interpreter beyond 8,000 bytes of code.  One
    such function, around a cheap column, keeps a projection apart.
    """
    return let(value, lambda x: x)


def settle(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters do not work out again.

    A filter on a plain column is moved below it, together with everything the
    column is made of: the detectors would run twice, and a column used many times
    over would be copied as often.  An exploded array of one element is a limit
    that only filters on other columns pass.
    """
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.explode(F.array(value)).alias(name))


def empty_spans() -> Column:
    return F.array().cast(SPANS)


def matches(text: Column, pattern: str | Column) -> Column:
    """All non-overlapping matches, left to right, as ``array<string>``."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def gaps(text: Column, pattern: str | Column) -> Column:
    """The text before, between and after the matches of ``pattern``.

    ``split`` compiles its pattern for every row, ``regexp_replace`` keeps it; so
    the matches are first replaced by one character, which then parts the text.  A
    text that has this character of its own is split on the pattern.
    """
    return F.when(text.contains(_MARK), F.split(text, pattern, -1)).otherwise(
        F.split(F.regexp_replace(text, pattern, _MARK), _MARK, -1)
    )


def running(values: Column, merge, start: int = 0) -> Column:
    """The running ``merge`` of an array of integers, each with its own value.

    A fold that appends copies its array at every step.  So it runs over blocks of
    ``FOLD`` values, and once more over the blocks' last results; the cost grows with the
    number of values, not with its square.
    """
    none = F.array().cast("array<int>")

    def fold(block: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            now = merge(acc["now"], x)
            return F.struct(now.alias("now"), F.concat(acc["out"], F.array(now)).alias("out"))

        zero = F.struct(F.lit(start).alias("now"), none.alias("out"))
        return F.aggregate(block, zero, step, lambda acc: acc["out"])

    def joined(blocks: Column) -> Column:
        before = F.concat(
            F.array(F.lit(start)), fold(F.transform(blocks, lambda x: F.element_at(x, -1)))
        )
        return F.flatten(
            F.zip_with(
                blocks,
                F.slice(before, F.lit(1), F.size(blocks)),
                lambda block, b: F.transform(block, lambda x: merge(b, x)),
            )
        )

    def cut(whole: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(whole), F.lit(FOLD))
        return F.transform(starts, lambda at: fold(F.slice(whole, at, F.lit(FOLD))))

    return F.when(F.size(values) <= FOLD, fold(values)).otherwise(
        let(values, lambda whole: let(cut(whole), joined))
    )


def locate(found: Column, between: Column) -> Column:
    """Give each match its offsets: running lengths over matches and gaps."""

    def placed(values: Column) -> Column:
        steps = F.zip_with(
            values,
            F.slice(between, F.lit(1), F.size(values)),
            lambda value, gap: F.length(value) + F.length(gap),
        )
        several = F.zip_with(
            values,
            running(steps, lambda a, b: a + b),
            lambda value, end: F.struct(
                (end - F.length(value)).alias("start"), end.alias("end"), value.alias("value")
            ),
        )
        # most often a detector finds one match, which needs no sums
        only, before = F.get(values, F.lit(0)), F.length(F.get(between, F.lit(0)))
        one = F.struct(
            before.alias("start"), (before + F.length(only)).alias("end"), only.alias("value")
        )
        return F.when(F.size(values) == 1, F.array(one)).otherwise(several)

    return placed(found)


def find_spans(text: Column, pattern: str | Column) -> Column:
    """``array<struct<start, end, value>>`` of all matches of ``pattern``."""
    found = matches(text, pattern)
    return F.when(
        F.size(found) > 0, locate(found, gaps(text, pattern))
    ).otherwise(F.array().cast(_PLAIN))


def tag(
    spans: Column, entity_type: str | Column, score: float, source: str, det_ord: int
) -> Column:
    """Turn plain spans into detections."""
    entity = F.lit(entity_type) if isinstance(entity_type, str) else entity_type
    return F.transform(
        spans,
        lambda s: F.struct(
            entity.alias("entity_type"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.lit(float(score)).alias("score"),
            s["value"].alias("value"),
            F.lit(source).alias("source"),
            F.lit(det_ord).alias("det_ord"),
        ),
    )


def splice(text: Column, edits: Column) -> Column:
    """Replace spans by other text.

    ``edits`` is an array of ``struct<start, end, put>`` that do not overlap, in
    any order.  The pieces are joined once.  A substring is found by counting from
    the start of the text; where there are many edits, the text is taken apart into
    characters first, so that the cost stays linear.
    """

    def rebuilt(ordered: Column, cut) -> Column:
        kept_from = F.concat(F.array(F.lit(0)), ordered["end"])
        kept_to = F.concat(ordered["start"], F.array(F.length(text)))
        puts = F.concat(ordered["put"], F.array(F.lit("")))
        kept = F.zip_with(kept_from, kept_to, cut)
        return F.array_join(F.zip_with(kept, puts, lambda k, p: F.concat(k, p)), "")

    def by_substring(ordered: Column) -> Column:
        return rebuilt(ordered, lambda a, b: F.substring(text, a + 1, b - a))

    def by_characters(ordered: Column) -> Column:
        return let(
            F.split(text, ""),
            lambda chars: rebuilt(
                ordered, lambda a, b: F.array_join(F.slice(chars, a + 1, b - a), "")
            ),
        )

    return (
        F.when(F.size(edits) == 0, text)
        .when(F.size(edits) <= FEW_EDITS, let(F.array_sort(edits), by_substring))
        .otherwise(let(F.array_sort(edits), by_characters))
    )


def gaps_text(text: Column, spans: Column) -> Column:
    """The text outside the given spans, joined."""
    return splice(
        text,
        F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("put")
            ),
        ),
    )
