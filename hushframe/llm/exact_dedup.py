"""Exact deduplication by an exchange of Golomb-coded fingerprints."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from hushframe.llm import golomb
from hushframe.llm.common import (
    broadcast_if_small,
    checkpointed,
    fields,
    keep_rows,
    map_rows,
    pieces,
    same,
)

#: Characters that do not count when texts are compared.
SPACE = b"\x20\t\n\x0b\x0c\r"
#: Bits of a fingerprint.  Suspects are verified, so a chance hit costs only a comparison.
BITS = 48
#: Most rows of a block: one sorted hash list, and one group when the bitmaps return.
BLOCK = 1 << 17
#: Most groups that are broadcast to their rows; more are joined.
GROUPS = 100_000


def normalise(text: bytes | None) -> bytes:
    return (text or b"").translate(None, SPACE)


def _fingerprint(norm: bytes) -> int:
    return xxhash.xxh3_64_intdigest(norm) >> (64 - BITS)


def _owner(prints: np.ndarray, owners: int) -> np.ndarray:
    """Owners hold equal ranges of fingerprints; ascending with them."""
    return ((prints >> 16) * owners) >> (BITS - 16)


def _send(df: DataFrame, key: str, text: str, owners: int) -> DataFrame:
    """A row per document, and per block and owner one of coded fingerprints."""
    schema = (
        f"{fields(df, key)}, _row bigint, _block bigint, _print bigint, _chars bigint, "
        "_sha binary, _owner int, _n int, _width int, _codes binary"
    )
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batch(columns: dict, rows: int) -> pa.RecordBatch:
        arrays = [
            columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in arrow
        ]
        return pa.RecordBatch.from_arrays(
            [a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, arrow)],
            schema=arrow,
        )

    def coded(block: int, prints: list[np.ndarray]) -> pa.RecordBatch:
        values = np.unique(np.concatenate(prints))
        cuts = np.searchsorted(_owner(values, owners), np.arange(owners + 1))
        rows = [
            (o, *golomb.encode(values[a:b]))
            for o, (a, b) in enumerate(zip(cuts, cuts[1:]))
            if b > a
        ]
        own, n, width, codes = map(list, zip(*rows))
        columns = {"_block": [block] * len(rows), "_owner": own, "_n": n, "_width": width}
        return batch(columns | {"_codes": codes}, len(rows))

    def run(batches):
        part = TaskContext.get().partitionId()
        block, row, prints, held = part << 32, part << 40, [], 0
        for whole in batches:
            for piece in pieces(whole):
                texts = piece.column(1).cast(pa.binary()).to_pylist()
                norms = [normalise(t) for t in texts]
                found = np.fromiter(map(_fingerprint, norms), np.int64, len(norms))
                if held and held + len(norms) > BLOCK:
                    yield coded(block, prints)
                    prints, held, block = [], 0, block + 1
                columns = {
                    key: piece.column(0).cast(arrow.field(0).type),
                    "_row": np.arange(row, row + len(norms)),
                    "_block": np.full(len(norms), block),
                    "_print": found,
                    "_chars": [len(t.decode()) if t else 0 for t in texts],
                    "_sha": [hashlib.sha256(n).digest() for n in norms],
                }
                yield batch(columns, len(norms))
                prints.append(found)
                held, row = held + len(norms), row + len(norms)
        if held:
            yield coded(block, prints)

    return df.select(key, F.col(text).cast("string")).mapInArrow(run, schema)


def _answer(codes: DataFrame) -> DataFrame:
    """Each owner tells each block which of its fingerprints another block has too."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [golomb.decode(*r) for r in zip(pdf["_n"], pdf["_width"], pdf["_codes"])]
        values, counts = np.unique(np.concatenate(lists), return_counts=True)
        shared = values[counts > 1]
        bitmaps = [np.packbits(np.isin(x, shared, assume_unique=True)).tobytes() for x in lists]
        return pd.DataFrame(
            {"_block": pdf["_block"], "_owner": pdf["_owner"], "_bitmap": bitmaps}
        )

    return codes.groupBy("_owner").applyInPandas(
        run, "_block bigint, _owner int, _bitmap binary"
    )


def _mark(rows: DataFrame, bitmaps: DataFrame, owners: int) -> DataFrame:
    """Mark as suspects the rows whose fingerprint occurs twice in or across blocks."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        prints = left.column("_print").to_numpy()
        values, at, counts = np.unique(prints, return_inverse=True, return_counts=True)
        twice = counts > 1
        own = _owner(values, owners)
        for owner, bitmap in zip(*(right.column(c).to_pylist() for c in ("_owner", "_bitmap"))):
            a, b = np.searchsorted(own, [owner, owner + 1])
            bits = np.unpackbits(np.frombuffer(bitmap, np.uint8))[: b - a]
            twice[a:b] |= bits.astype(bool)
        return left.append_column("_suspect", pa.array(twice[at]))

    schema = StructType(list(rows.schema.fields)).add("_suspect", "boolean")
    sides = rows.groupBy("_block").cogroup(bitmaps.groupBy("_block"))
    return sides.applyInArrow(run, schema)


def duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """Groups of equal texts: ``key, keep_id, group_size, kept, text_sha256``, a row per row.

    Texts are equal when identical without the white space of ``SPACE``; null counts as
    empty.  Of a group stays the row with the most code points in its original text,
    then the smallest key (null last), then the first read; exactly one of repeated rows.

    Partitions cut their rows into blocks and send each owner the block's sorted
    fingerprints in its range, Golomb-coded.  Owners return bitmaps of those that
    another block has.  Only the texts of rows so marked move: their distinct
    normalised texts are brought together under their SHA-256 and compared byte by byte.
    A SHA-256 with two texts fails the job.  Rows of a group are counted and compared
    before they are shuffled, so a group of any size is one row per task.
    """
    spark = df.sparkSession
    owners = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = checkpointed(_send(df, key, text, owners))
    rows = sent.where(F.col("_owner").isNull()).drop("_owner", "_n", "_width", "_codes")
    codes = sent.where(F.col("_owner").isNotNull())
    bitmaps = _answer(codes.select("_owner", "_block", "_n", "_width", "_codes"))
    marked = checkpointed(_mark(rows, bitmaps, owners))
    suspects = marked.where("_suspect")

    keys = suspects.select(F.col(key).alias("_key")).distinct()
    texts = df.select(F.col(key).alias("_of"), F.col(text).cast("string").alias("_text"))
    moved = texts.join(broadcast_if_small(keys), same("_of", "_key"), "left_semi")

    def make():
        def hashed(texts):
            norms = [normalise(t.encode() if t else None) for t in texts]
            return [hashlib.sha256(n).digest() for n in norms], norms

        return hashed

    distinct = map_rows(moved, ["_text"], "_sha binary, _norm binary", make).distinct()
    verified = distinct.groupBy("_sha").agg(F.count(F.lit(1)).alias("_texts"))
    order = F.struct(-F.col("_chars"), F.col(key).isNull(), F.col(key).alias("id"), F.col("_row"))
    groups = suspects.groupBy("_sha").agg(
        F.min(order).alias("_best"), F.count(F.lit(1)).alias("_size")
    )
    one = F.when(F.col("_texts") == 1, F.col("_size")).otherwise(
        F.raise_error(F.lit("two texts share a SHA-256")).cast("bigint")
    )
    groups = groups.join(verified, "_sha").select(
        "_sha",
        F.col("_best.id").alias("keep_id"),
        F.col("_best._row").alias("_keep"),
        one.alias("group_size"),
    )
    groups = broadcast_if_small(groups.where("group_size > 1"), GROUPS)
    sha = F.lower(F.hex("_sha")).alias("text_sha256")
    grouped = suspects.join(groups, "_sha", "left").select(
        key,
        F.when(F.col("group_size").isNull(), F.col(key)).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("_row") == F.col("_keep"), F.lit(True)).alias("kept"),
        sha,
    )
    single = marked.where("not _suspect").select(
        key,
        F.col(key).alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        sha,
    )
    return single.unionByName(grouped)


def keep_first(df: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``df`` that stay, whole: one of each group of equal texts."""
    found = duplicates(df, key, text).withColumnRenamed("text_sha256", "_mark")
    norm = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\t-\r]+", "")
    return keep_rows(df, key, text, found, F.sha2(norm, 256))
