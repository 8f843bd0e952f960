"""Small column expressions over text: white space, Luhn, tokens, hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.functions.patterns import SPACE


def trim_space(text: Column) -> Column:
    """Trim Unicode white space (Spark's ``trim`` strips plain spaces only)."""
    return F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def is_blank(text: Column) -> Column:
    """True where the text is empty or white space only."""
    return ~text.rlike(rf"[^{SPACE}]")


def luhn_valid(number: Column) -> Column:
    """Luhn check of the digits in ``number``; other characters are skipped."""
    digits = F.regexp_replace(number, r"[^0-9]", "")

    def weighted(char: Column, pos: Column) -> Column:
        d = F.ascii(char) - F.lit(48)
        doubled = d * 2
        return (
            F.when(pos % 2 == 0, d)
            .when(doubled > 9, doubled - 9)
            .otherwise(doubled)
        )

    weights = F.transform(F.split(F.reverse(digits), ""), weighted)
    total = F.aggregate(weights, F.lit(0), lambda acc, w: acc + w)
    return F.when(digits == "", F.lit(True)).otherwise(total % 10 == 0)


def format_token(entity_type: Column, idx: Column) -> Column:
    """``<ENTITY_TYPE_N>``."""
    return F.concat(F.lit("<"), entity_type, F.lit("_"), idx.cast("string"), F.lit(">"))


def scrubbed_notice(count: Column) -> Column:
    """``N item(s) scrubbed`` with the right number."""
    return F.concat(
        count.cast("string"),
        F.when(count == 1, F.lit(" item scrubbed")).otherwise(F.lit(" items scrubbed")),
    )
