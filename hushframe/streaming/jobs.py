"""Structured Streaming jobs.

Detection and decision are stateless, so a stream runs the same plan as a table.
Tokens keep state per (scope, entity type); see ``streaming.tokens``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from hushframe.sources.session import shared_dir


AVAILABLE_NOW = {"availableNow": True}
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def _start(
    writer: DataStreamWriter, checkpoint: str, trigger: dict, spark: SparkSession
) -> StreamingQuery:
    """Start a query; one that only runs over what is available is waited for.

    Such a run makes no batches without data: operators with processing-time timers ask
    for one after the other, and it would never end.  Their timers fire in later runs.
    The setting is that of the stream's own session, which need not be the active one.
    """
    writer = writer.option("checkpointLocation", checkpoint).trigger(**trigger)
    if trigger != AVAILABLE_NOW:
        return writer.start()
    conf = spark.conf
    before = conf.get(_EMPTY_BATCHES)
    conf.set(_EMPTY_BATCHES, "false")
    try:
        query = writer.start()
        query.awaitTermination()
    finally:
        conf.set(_EMPTY_BATCHES, before)
    return query


def run_available(
    stream: DataFrame, path: str, checkpoint: str, trigger: dict = AVAILABLE_NOW
) -> StreamingQuery:
    """Append to parquet files under ``path``: what is available now, or by ``trigger``."""
    writer = stream.writeStream.format("parquet").option("path", path).outputMode("append")
    return _start(writer, checkpoint, trigger, stream.sparkSession)


def drain(stream: DataFrame) -> DataFrame:
    """Run a stream over what is available and read the result back."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    run_available(stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def for_each_batch(
    stream: DataFrame,
    work: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: dict = AVAILABLE_NOW,
) -> StreamingQuery:
    """Run ``work(batch, batch_id)`` for what is available now, or by ``trigger``.

    ``work`` is called again with the same id after a failure, so it has to write
    under that id.
    """
    return _start(stream.writeStream.foreachBatch(work), checkpoint, trigger, stream.sparkSession)


def analyze_with_live_settings(
    stream: DataFrame,
    read_settings: Callable[[], dict],
    out_path: str,
    checkpoint: str,
    **options,
) -> StreamingQuery:
    """Analyse each micro-batch under the settings that hold when it starts."""
    from hushframe.operators.policy import load_settings
    from hushframe.plans.analyze import analyze

    def work(batch: DataFrame, batch_id: int) -> None:
        result = analyze(batch, load_settings(read_settings()), **options)
        result.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return for_each_batch(stream, work, checkpoint)


def scrub_counter(
    disposed: DataFrame, out_path: str, checkpoint: str
) -> StreamingQuery:
    """Write the scrubbed spans of each batch and scope, keyed by batch id.

    The counter is the sum over the batches (``read_counter``).  A batch that runs
    again replaces its own rows, so nothing is counted twice.
    """
    from hushframe.operators.disposition import scrub_count

    def work(batch: DataFrame, batch_id: int) -> None:
        counts = scrub_count(batch, ["scope_id"])
        counts.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return for_each_batch(disposed, work, checkpoint)


def read_counter(spark: SparkSession, out_path: str, since_batch: int = 0) -> DataFrame:
    """The counter per scope; a reset starts it again from a later batch."""
    return (
        spark.read.option("basePath", out_path)
        .parquet(out_path)
        .where(F.col("batch") >= since_batch)
        .groupBy("scope_id")
        .agg(F.sum("scrub_count").cast("bigint").alias("scrub_count"))
    )
