"""Mixing of sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushframe.llm.common import (
    broadcast_if_small,
    checkpointed,
    fresh,
    own_columns,
    same,
)

#: Most times that a source's text is taken.
CAP = 3
#: A word is a run of other characters than these.
WORD = r"[^\x20\t-\r]++"


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per source.

    Sources in code-point order, null last, have ``weights`` in turn and share the
    total size by weight.  No target is above ``cap`` times its source's size; what is
    over is shared by weight among the others until none is above.  That level is found
    at once: with sources sorted by ``size / weight``, a source stays below its cap if
    its share of what the smaller ones leave does.  The windows run over one row per
    source, with the sum of sizes before.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("bigint")
    rows = sizes.select("source", "source_size", weight.alias("w"))
    ratio = F.col("source_size") / F.col("w")
    before = Window.orderBy(ratio, F.col("source").isNull(), "source").rowsBetween(
        Window.unboundedPreceding, -1
    )
    all_rows = Window.partitionBy()
    size, w = F.col("source_size"), F.col("w")
    rows = rows.select(
        "*",
        (F.sum(size).over(all_rows) - cap * F.coalesce(F.sum(size).over(before), F.lit(0))).alias(
            "left"
        ),
        (F.sum(w).over(all_rows) - F.coalesce(F.sum(w).over(before), F.lit(0))).alias("w_left"),
    )
    # below the cap: w * left / w_left <= cap * size
    free = w * F.col("left").cast("double") <= cap * size.cast("double") * F.col("w_left")
    rows = rows.withColumn("free", free)
    # the first free source, the one with the most weight left, has the level of all
    level = F.max(F.when(F.col("free"), F.struct("w_left", "left"))).over(all_rows)
    at = rows.withColumn("at", level)
    most = cap * size.cast("double")
    shared = F.least(w * F.col("at.left").cast("double") / F.col("at.w_left"), most)
    target = F.when(F.col("free"), shared).otherwise(most)
    return at.select("source", "source_size", target.alias("target"))


def mix(
    df: DataFrame,
    key: str,
    text: str,
    source: str,
    weights: Sequence[int] = (1, 2, 3),
    cap: int = CAP,
    seed: int = 0,
) -> DataFrame:
    """``key, size, source_size, target, copies, taken``, one row per row.

    ``copies`` is the whole part of the source's repetition rate (target over size) plus
    one with the probability of the rest, by a hash of seed and key; ``taken`` is size
    times copies.  Repeated rows draw alike.  Sizes are counted once and kept in the
    shared folder; sources are summed before they are shuffled, and their few rows come
    back by broadcast if they are few, else by a join that adaptive execution splits.
    Null texts have size 0; a source without words has the rate 0.
    """
    size = words(F.col(text)).alias("size")
    sizes = checkpointed(df.select(F.col(key).alias("_key"), F.col(source).alias("_of"), size))
    per_source = sizes.groupBy(F.col("_of").alias("source")).agg(
        F.sum("size").alias("source_size")
    )
    aims = broadcast_if_small(targets(per_source, weights, cap))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    part = F.col("rate") - F.floor("rate")
    copies = F.floor("rate") + F.when(_draw(F.col("_key"), seed) < part, 1).otherwise(0)
    return (
        sizes.join(aims, same("_of", "source"), "left")
        .withColumn("rate", rate)
        .withColumn("copies", copies.cast("bigint"))
        .select(
            F.col("_key").alias(key),
            "size",
            "source_size",
            "target",
            "copies",
            (F.col("size") * F.col("copies")).alias("taken"),
        )
    )


def _draw(key: Column, seed: int) -> Column:
    """A number from 0 to below 1 from 52 bits of the MD5 of seed and key."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    digits = F.substring(F.md5(name.cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def repeat_rows(
    df: DataFrame,
    key: str,
    text: str,
    source: str,
    weights: Sequence[int] = (1, 2, 3),
    cap: int = CAP,
    seed: int = 0,
) -> DataFrame:
    """The mix itself: every row of ``df`` as many times as it is taken.

    The rate of each row's source joins the rows directly, so texts are not shuffled
    while the sources are few.
    """
    counted = df.groupBy(F.col(source).alias("source")).agg(
        F.sum(words(F.col(text))).alias("source_size")
    )
    aims = targets(counted, weights, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    of, often, copy = fresh(df, "_of", "_rate", "_copy")
    rates = broadcast_if_small(aims.select(F.col("source").alias(of), rate.alias(often)))
    whole = F.floor(often)
    extra = F.when(_draw(F.col(key), seed) < F.col(often) - whole, 1).otherwise(0)
    each = F.explode(F.array_repeat(F.lit(0), (whole + extra).cast("int"))).alias(copy)
    drawn = df.join(rates, same(source, of))
    return drawn.select(*own_columns(df), each).drop(copy)
