"""Places and running sums in a global order, without a window over a hot key.

A window by key puts all rows of a key in one task, and one key may hold a third of
the table.  Here rows are dealt by sampled ranges of (keys, order), so a key's rows are
spread over as many parts as they fill, whatever the values look like.  The sorted parts
are written to the shared folder before anything is counted: both later reads see the
same places, and a lost executor changes none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.sources.tables import stage

#: Rows of a block that one window of ``prefix_sum`` runs over.
BLOCK_BITS = 16
_LOW = (1 << 33) - 1


def sorted_parts(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` staged in sorted range parts, with ``__part`` and ``__pos`` (from 0) in it."""
    at = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at)
    rows = stage(rows)
    part, pos = F.shiftright("__at", 33).cast("int"), F.col("__at").bitwiseAND(F.lit(_LOW))
    return rows.withColumn("__part", part).withColumn("__pos", pos).drop("__at")


def _before(rows: DataFrame, value: Column) -> DataFrame:
    """``__part, __before``: the sum of ``value`` in all earlier parts, one row per part.

    There are as many rows as range partitions, so they may pass through the driver.
    """
    sums = rows.groupBy("__part").agg(F.sum(value).alias("n")).collect()
    total, out = 0, []
    for part, n in sorted(sums):
        out.append((part, total))
        total += n
    return F.broadcast(rows.sparkSession.createDataFrame(out, "__part int, __before bigint"))


def _since_key(rows: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """The running sum ``__sum`` over everything, less what lies before each key's rows.

    The sums before the keys are staged, so Spark knows their size before it plans the join:
    for a few keys no row is shuffled, by key least of all.
    """
    first = stage(rows.groupBy(*keys).agg(F.min(F.col("__sum") - value).alias("__start")))
    return (
        rows.join(first, list(keys))
        .withColumn(out, F.col("__sum") - F.col("__start"))
        .drop("__sum", "__start", "__part", "__pos", "__before")
    )


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """The place of each row among those of its ``keys`` in ``order``, from 1.

    Rows with a missing key are left out.
    """
    rows = sorted_parts(df.dropna(subset=list(keys)), *keys, *order)
    one = F.lit(1).cast("bigint")
    rows = rows.join(_before(rows, one), "__part")
    rows = rows.withColumn("__sum", F.col("__before") + F.col("__pos") + 1)
    return _since_key(rows, keys, one, out)


def prefix_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """Running sum of ``value`` (not negative) by ``keys`` in ``order``, inclusive.

    Rows are summed within blocks of 2^bits neighbours, blocks within their part, and
    parts over the table.  Rows with a missing key are left out.
    """
    named = df.dropna(subset=list(keys)).withColumn("__value", value.cast("bigint"))
    rows = sorted_parts(named, *keys, *order)
    rows = rows.withColumn("__block", F.shiftright("__pos", bits))
    block = Window.partitionBy("__part", "__block").orderBy("__pos")
    earlier = Window.partitionBy("__part").orderBy("__block")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("__part", "__block").agg(F.sum("__value").alias("__total"))
    blocks = blocks.select(
        "__part",
        "__block",
        F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__ahead"),
    )
    within = F.sum("__value").over(block.rowsBetween(Window.unboundedPreceding, 0))
    rows = (
        rows.withColumn("__within", within)
        .join(blocks, ["__part", "__block"])
        .join(_before(rows, F.col("__value")), "__part")
        .withColumn("__sum", F.col("__before") + F.col("__ahead") + F.col("__within"))
        .drop("__within", "__ahead", "__block")
    )
    return _since_key(rows, keys, F.col("__value"), out).drop("__value")
