"""Helpers that the operators share: Arrow batches, checkpoints, hash-ordered samples."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from hushframe.sources.session import shared_dir

#: Most text bytes that one call of a batch function sees, but for a longer single text.
PIECE_BYTES = 4 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def fields(df: DataFrame, *columns: str) -> str:
    """The columns of ``df`` as DDL, under their own names and types."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{c}` {types[c]}" for c in columns)


def pieces(batch: pa.RecordBatch, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``size`` bytes, or one long row."""
    rows = batch.num_rows
    step = max(1, min(rows, rows * size // max(1, batch.nbytes)))
    for start in range(0, rows, step):
        yield batch.slice(start, step)


def map_rows(
    df: DataFrame,
    columns: Sequence[str | Column],
    schema: str,
    make: Callable[[], Callable[..., Iterable[Sequence]]],
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """Apply a function of Python lists to batches of ``columns``, without a shuffle.

    ``make`` runs once per task and returns the function; that one gets a list per
    column and returns a list (or Arrow array) per column of ``schema``.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for piece in pieces(batch, piece_bytes):
                out = fn(*(c.to_pylist() for c in piece.columns))
                arrays = [
                    c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
                    for c, f in zip(out, arrow, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return df.select(*columns).mapInArrow(run, schema)


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` distinct non-null keys, those of the smallest seeded hashes."""
    keys = df.where(F.col(key).isNotNull()).select(key).distinct()
    return keys.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


#: Most rows that are ever broadcast, all of them narrow.
BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark a narrow side for broadcast if it has few rows; else it is shuffled.

    ``df`` is written to the shared folder first, so the count is of what is joined.
    """
    held = checkpointed(df)
    most = BROADCAST_ROWS if rows is None else min(rows, BROADCAST_ROWS)
    return F.broadcast(held) if held.count() <= most else held


def same(left: str, right: str) -> Column:
    """Null-safe equality of two columns by name."""
    return F.col(left).eqNullSafe(F.col(right))


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names like the stems that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem = f"_{stem}"
        out.append(stem)
    return out


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever characters are in their names."""
    return [F.col(f"`{c}`") for c in df.columns]


def keep_rows(df: DataFrame, key: str, text: str, found: DataFrame, mark: Column) -> DataFrame:
    """The rows of ``df`` that ``found`` keeps, with all their columns.

    ``found`` has a row ``key, kept, _mark`` per row of ``df``.  Rows are told apart by key
    alone where it is unique, so that only keys are joined.  Rows that share a key are told
    apart by ``mark`` (the column of ``df`` that gives ``_mark``); of rows that share that
    too, the one with the longest and then the largest text stays.
    """
    found = checkpointed(found.select(F.col(key).alias("_key"), "kept", "_mark"))
    per_key = found.groupBy("_key").agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(~F.col("kept")).alias("_lost")
    )
    per_key = checkpointed(per_key.where("_rows > 1 or _lost > 0"))
    id_, is_, winner, won = fresh(df, "_id", "_is", "_winner", "_won")
    touched = broadcast_if_small(per_key.select(F.col("_key").alias(id_)))
    out = df.join(touched, same(key, id_), "left_anti")
    several = per_key.where("_rows > 1 and _lost < _rows").select(F.col("_key").alias(id_))
    if several.isEmpty():
        return out
    several = broadcast_if_small(several)
    winners = found.where("kept").select(F.col("_key").alias(winner), F.col("_mark").alias(won))
    winners = winners.join(several, same(winner, id_), "left_semi").distinct()
    rows = df.join(several, same(key, id_), "left_semi").withColumn(is_, mark)
    rows = rows.join(winners, same(key, winner) & (F.col(is_) == F.col(won)), "left_semi")
    body = F.coalesce(text, F.lit(""))
    best = F.max_by(F.struct(*own_columns(df)), F.struct(F.length(body), body))
    again = rows.groupBy(F.col(key).alias(winner), is_).agg(best.alias(won))
    return out.unionByName(again.select(f"{won}.*"))
