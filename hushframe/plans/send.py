"""From analysed messages to what is sent: dispose, scrub what is released, deliver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.operators.disposition import dispose
from hushframe.operators.tokens import scrub_session
from hushframe.sources.tables import stage


def deliver(disposed: DataFrame, vault: DataFrame | None = None) -> DataFrame:
    """Add ``delivered``, the text that leaves; held messages have none.

    Only messages that are sent scrubbed mint tokens.  One whose scrubbing fails is
    held.  Give staged messages, as detection is costly: those that pass and those that are
    scrubbed are read apart, the latter three times; the former pass without a shuffle.
    """
    scrubs = (F.col("outcome") == "sent_scrubbed") & (F.size("detections") > 0)
    scrubs = F.coalesce(scrubs, F.lit(False))
    raw = F.when(F.col("outcome") != "held", F.col("text"))
    passed = disposed.where(~scrubs).withColumn("delivered", raw)
    done = scrub_session(disposed.where(scrubs), vault, out="delivered")
    done = done.withColumn(
        "outcome", F.when(F.col("delivered").isNull(), "held").otherwise(F.col("outcome"))
    )
    return passed.unionByName(done)


def send(
    analysed: DataFrame, actions: DataFrame | None = None, vault: DataFrame | None = None
) -> DataFrame:
    """Analysed messages with ``action``, ``outcome`` and ``delivered``.

    The messages are analysed once, and staged with their outcome.
    """
    return deliver(stage(dispose(analysed, actions)), vault)
