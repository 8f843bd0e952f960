"""Readers, writers and staged tables."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.sources.session import shared_dir

_SPLIT_BYTES = 128 * 1024 * 1024
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: ``folders``: of each open ``scratch`` of this thread, what was staged inside, innermost last.
_SCRATCH = threading.local()


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of the files under ``path`` (listed, not read)."""
    row = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .agg(F.sum("length").alias("n"))
        .first()
    )
    return int(row["n"] or 0)


def spread(df: DataFrame, path: str, *keys: str) -> DataFrame:
    """Use all cores on a table too small to be split.

    Text work is bound by the processor, and one small file is one task.  Only
    tables of less than one split per core are redistributed, by key so that a
    retried task sees the same rows; larger ones are left as they are read.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    if stored_bytes(spark, path) >= cores * _SPLIT_BYTES:
        return df
    return df.repartition(cores, *keys)


def read_messages(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    scope: str | Column = "scope_id",
    seq: str | Column = "seq",
    text: str | Column = "text",
    lang: str | Column | None = None,
    url: str | Column | None = None,
    stream: bool = False,
    schema=None,
    **options: str,
) -> DataFrame:
    """Read messages as ``(scope_id string, seq bigint, text, lang, url)``.

    Any Spark file format works, in batch or as a stream (which needs a schema).
    """
    reader = spark.readStream if stream else spark.read
    reader = reader.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return as_messages(reader.load(path), scope, seq, text, lang, url)


def as_messages(
    df: DataFrame,
    scope: str | Column,
    seq: str | Column,
    text: str | Column = "text",
    lang: str | Column | None = None,
    url: str | Column | None = None,
) -> DataFrame:
    """Normalise any table with text to the message columns."""

    def column(c: str | Column | None, kind: str) -> Column:
        if c is None:
            return F.lit(None).cast(kind)
        return (F.col(c) if isinstance(c, str) else c).cast(kind)

    return df.select(
        column(scope, "string").alias("scope_id"),
        column(seq, "bigint").alias("seq"),
        column(text, "string").alias("text"),
        column(lang, "string").alias("lang"),
        column(url, "string").alias("url"),
    )


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write inside go with its end, not when garbage is collected."""
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)


def _written(df: DataFrame, partition_by: Sequence[str] = ()) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _shuffles_removed(spark):
        writer.parquet(path)
    done = spark.read.schema(df.schema).parquet(path)
    done._staged = True
    return done, path


def _scratches() -> list[list[str]]:
    if not hasattr(_SCRATCH, "folders"):
        _SCRATCH.folders = []
    return _SCRATCH.folders


def stage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write a result once to the shared folder and read it back.

    Used where several steps need the same costly rows.  A lost executor then
    re-reads files; nothing upstream is computed again, and later steps still
    prune columns.
    """
    done, path = _written(df, partition_by)
    for folders in _scratches()[-1:]:
        folders.append(path)
    return done


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete at the end what was staged inside, except by the function that it gives.

    That function stages like ``stage``.  Nothing that reads from what was staged otherwise
    may be used after the end.
    """
    scratches = _scratches()
    folders: list[str] = []
    outer = scratches[-1:]

    def keep(df: DataFrame) -> DataFrame:
        done, path = _written(df)
        for around in outer:
            around.append(path)
        return done

    scratches.append(folders)
    try:
        yield keep
    finally:
        scratches.pop()
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _sent() -> Column:
    sent = (F.col("outcome") != "held") & F.col("delivered").isNotNull()
    return F.coalesce(sent, F.lit(False))


def sink_rows(df: DataFrame) -> DataFrame:
    """Delivered messages without what no sink takes: of sent rows all but what goes onward."""
    onward = ("scope_id", "seq", "delivered", "outcome")
    held = {c: F.when(~_sent(), F.col(c)) for c in df.columns if c not in onward}
    return df.withColumns(held)


def write_outcomes(
    df: DataFrame, sent_path: str, held_path: str, fmt: str = "parquet", run: str | None = None
) -> None:
    """Write delivered messages: sent texts onward, held rows to quarantine only.

    ``df`` comes from ``plans.send.deliver``.  Onward go keys, outcome and ``delivered``
    only, never the text or the detections as they were; a row without delivered text
    counts as held.

    ``df`` is worked out once, in the shared folder if it is not staged already, and both
    sinks are filled from there: first the held rows, then the sent ones, each in one job
    that commits as a whole.  With ``run`` they go to a folder of that name in either sink,
    and the same call again replaces them: a job that is tried again sends nothing twice.
    A run is done when its folder in ``sent_path`` is there.  Without ``run`` rows are
    appended.
    """
    with scratch(df.sparkSession):
        done = df if getattr(df, "_staged", False) else stage(sink_rows(df))
        onward = done.where(_sent()).select("scope_id", "seq", "delivered", "outcome")
        held = done.where(~_sent()).drop("delivered")
        for rows, path in ((held, held_path), (onward, sent_path)):
            writer = rows.write.mode("append" if run is None else "overwrite").format(fmt)
            if rows is onward:
                writer = writer.partitionBy("outcome")
            writer.save(path if run is None else f"{path}/run={run}")


def write_columns(df: DataFrame, path: str, columns: Sequence[str], fmt: str = "parquet"):
    """Append the given columns only."""
    df.select(*columns).write.mode("append").format(fmt).save(path)
