"""Exact top-k inner products over a bit-sliced index."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from hushframe.llm.common import checkpointed

#: Rows of an index block and queries of a query block.
ROWS = 1 << 15
QUERIES = 256
#: Low bits of a component that the index leaves out; boundary rows make up for them.
DROP = 2


def scaled(vector: Column, scale: int = 256) -> Column:
    """``scale * x`` of each component as a double; null for vectors that take no part.

    Those are null vectors and such with components that are null or not finite.
    """
    x = F.transform(vector, lambda c: c.cast("double") * float(scale))
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(odd, F.lit(True)), x)


PACK = "dim int, block bigint, n int, ids binary, known binary, vectors binary"


def _packed(df: DataFrame, group: str) -> DataFrame:
    """Groups of rows (of equal dimension) as matrices of whole numbers, rounded down."""
    arrow = to_arrow_schema(StructType.fromDDL(PACK))

    def run(table: pa.Table) -> pa.Table:
        keys = table.column("id").combine_chunks()
        ids = np.asarray(keys.fill_null(0), np.int64)
        known = np.asarray(keys.is_valid(), bool)
        dim = table.column("dim")[0].as_py()
        flat = np.asarray(table.column("v").combine_chunks().flatten(), float)
        vectors = np.floor(flat).reshape(len(ids), dim)
        row = (dim, table.column(group)[0].as_py(), len(ids))
        most = np.abs(vectors).max(initial=0)
        kind = np.int16 if most < 1 << 15 else np.int64 if most < 2.0**62 else np.float64
        blobs = (ids.tobytes(), known.tobytes(), kind(0).dtype.char.encode() + vectors.astype(kind).tobytes())
        return pa.Table.from_pylist([dict(zip(arrow.names, row + blobs))], arrow)

    return df.select("dim", group, "id", "v").groupBy("dim", group).applyInArrow(run, PACK)


def _unpack(n: int, dim: int, ids: bytes, known: bytes, vectors: bytes):
    """Ids, which are known, and the matrix: of int64, or of Python integers if too large."""
    matrix = np.frombuffer(vectors, vectors[:1].decode(), offset=1).reshape(n, dim)
    if matrix.dtype == np.float64:
        whole = np.array([int(x) for x in matrix.ravel()] + [None], object)[:-1].reshape(n, dim)
    else:
        whole = matrix.astype(np.int64)
    return np.frombuffer(ids, np.int64), np.frombuffer(known, bool), whole


class Exact:
    """A block of rows whose scores may not fit 64 bits: all are computed, without an index."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors.astype(object)

    def top(self, query: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int):
        q = query.tolist()
        scores = [sum(a * b for a, b in zip(v, q)) for v in self.vectors.tolist()]
        order = sorted(range(len(scores)), key=lambda i: (-scores[i], not known[i], ids[i]))[:k]
        return np.array(order, np.int64), [scores[i] for i in order]


class BitSliced:
    """The slices of all components of a block of rows, as bitmaps of 64-bit words."""

    def __init__(self, vectors: np.ndarray, drop: int = DROP):
        self.vectors, self.drop = vectors, drop
        n, dim = vectors.shape
        self.n = n
        self.words = (n + 63) // 64
        low = vectors.min(axis=0) if n else np.zeros(dim, np.int64)
        self.low = low
        coarse = (vectors - low) >> drop
        self.bits = int(coarse.max(initial=0)).bit_length()
        self.high = low + (((1 << self.bits) - 1) << drop)  # of the inverted slices
        padded = np.zeros((dim, self.words * 64), np.int64)
        padded[:, :n] = coarse.T
        slices = [
            np.packbits((padded >> b) & 1, axis=1, bitorder="little").view(np.uint64)
            for b in range(self.bits)
        ]
        self.slices = np.array(slices, np.uint64).reshape(self.bits, dim, self.words)
        self.full = np.full(self.words, ~np.uint64(0))
        if n % 64:
            self.full[-1] = np.uint64((1 << (n % 64)) - 1)

    def add_up(self, query: np.ndarray) -> tuple[list[np.ndarray], int, int]:
        """Slices of ``sum |q| * a`` per row, with the offset and slack of the true score.

        ``a`` is the sliced component, inverted where ``q`` is negative, so that all terms
        add.  Bitmaps of one weight are summed three at a time, a sum and a carry.  The
        score lies from ``offset + 2^drop * sum`` to that plus ``slack``.
        """
        columns: list[list[np.ndarray]] = [[] for _ in range(80)]
        offset = slack = 0
        for d, q in enumerate(query.tolist()):
            if not q:
                continue
            size, inverted = abs(q), q < 0
            offset += q * int(self.high[d] if inverted else self.low[d])
            # components are a*2^drop + r, 0 <= r < 2^drop; for q < 0 the rest pulls down
            rest = size * ((1 << self.drop) - 1)
            slack += rest
            offset -= rest if inverted else 0
            for b in range(self.bits):
                bitmap = self.slices[b, d]
                if inverted:
                    bitmap = ~bitmap & self.full
                for k in range(size.bit_length()):
                    if size >> k & 1:
                        columns[b + k].append(bitmap)
        sums: list[np.ndarray] = []
        for weight, column in enumerate(columns):
            while len(column) > 2:
                a, b, c = column.pop(), column.pop(), column.pop()
                half = a ^ b
                column.append(half ^ c)
                columns[weight + 1].append((a & b) | (half & c))
                if len(column) > 2:
                    column.insert(0, column.pop())
            if len(column) == 2:
                a, b = column.pop(), column.pop()
                column.append(a ^ b)
                columns[weight + 1].append(a & b)
            sums.append(column[0] if column else np.zeros(self.words, np.uint64))
            if not any(columns[weight + 1 :]):
                break
        return sums, offset, slack

    def kth(self, sums: list[np.ndarray], k: int) -> int:
        """The k-th largest sum, found from the most significant slice downward."""
        sure, maybe, value = 0, self.full, 0
        for weight in range(len(sums) - 1, -1, -1):
            ones = maybe & sums[weight]
            n = int(np.bitwise_count(ones).sum())
            if sure + n >= k:
                maybe, value = ones, value | 1 << weight
            else:
                sure, maybe = sure + n, maybe & ~sums[weight]
        return value

    def at_least(self, sums: list[np.ndarray], value: int) -> np.ndarray:
        """Rows whose sum is ``value`` or more."""
        if value <= 0:
            return np.arange(self.n)
        if value >> len(sums):
            return np.empty(0, np.int64)
        above, equal = np.zeros_like(self.full), self.full
        for weight in range(len(sums) - 1, -1, -1):
            if value >> weight & 1:
                equal = equal & sums[weight]
            else:
                above = above | (equal & sums[weight])
                equal = equal & ~sums[weight]
        bits = np.unpackbits((above | equal).view(np.uint8), bitorder="little")
        return np.flatnonzero(bits[: self.n])

    def top(self, query: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int):
        """Rows and scores of the k largest scores, ties to the smaller id (unknown ids last)."""
        if k >= self.n:
            near = np.arange(self.n)
        else:
            sums, _, slack = self.add_up(query)
            # a row can only be among the k if its upper bound reaches the k-th lower bound
            least = self.kth(sums, k) - (slack >> self.drop) - 1
            near = self.at_least(sums, least)
        scores = self.vectors[near] @ query
        order = np.lexsort((ids[near], ~known[near], -scores))[:k]
        return near[order], scores[order].tolist()


#: Components from this size on go to blocks of their own, which may need exact sums.
WIDE = float(1 << 26)


def _fits(rows: np.ndarray, queries: np.ndarray) -> bool:
    """Whether all scores of a block and a query block surely fit 64 bits."""
    if rows.dtype == object or queries.dtype == object:
        return False
    most = [int(max(abs(int(m.min(initial=0))), int(m.max(initial=0)))) for m in (rows, queries)]
    return most[0] * most[1] * max(1, rows.shape[1]) < 1 << 62


def _search(k: int):
    """Answers of the query blocks that follow each block of rows; the index is built once."""

    def run(batches):
        at = index = plain = None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids, known, matrix = _unpack(r.n, r.dim, r.ids, r.known, r.vectors)
                if r.group < 0:
                    at, index, plain = (ids, known, matrix), None, None
                    continue
                held_ids, held_known, vectors = at
                if _fits(vectors, matrix):
                    index = use = index or BitSliced(vectors)
                else:
                    plain = use = plain or Exact(vectors)
                found = []
                for i, q in enumerate(matrix):
                    near, scores = use.top(q, held_ids, held_known, k + 1)
                    same = held_known[near] & (held_ids[near] == ids[i]) & (vectors[near] == q).all(1)
                    for row, score, x in zip(near.tolist(), scores, same):
                        cut = max(-(1 << 63), min((1 << 63) - 1, score))
                        id_ = held_ids[row] if held_known[row] else None
                        found.append((f"{r.dim}:{r.group}:{i}", ids[i], id_, cut, _double(score), x))
                out = pd.DataFrame(found, columns=[c.split()[0] for c in FOUND.split(", ")])
                yield out.astype({"vec_id": "Int64", "score": "int64", "same": "bool"})

    return run


def _double(score: int) -> float:
    try:
        return float(score)
    except OverflowError:
        return float("inf") if score > 0 else float("-inf")


FOUND = "asked string, query_id bigint, vec_id bigint, score bigint, size double, same boolean"


def top_k(
    df: DataFrame,
    key: str,
    vector: str,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
) -> DataFrame:
    """Each query row's ``k`` best rows: ``query_id, rank, vec_id, score``.

    Components are ``floor(scale * x)``; the score is the integer inner product, ties go
    to the smaller key (null last), and a row is no candidate of itself.  Vectors that
    are null or have components that are null or not finite take no part; only vectors of
    the same length are compared.  Scores are exact whatever their size; one beyond a bigint
    is given as its largest or smallest value, and such scores are ordered as doubles.
    Repeated rows are candidates of each other, and repeated query rows have results each.
    Fewer candidates give fewer rows.

    Rows are cut into blocks, each becoming a bit-sliced index, and queries into blocks.
    Every block of rows meets all blocks of queries, in as many lanes as give each core
    work; a lane builds the index once.  Rows with large components are in blocks of
    their own.  A block returns ``k + 1`` rows per query, which one window per query merges.
    """
    spark = df.sparkSession
    held = df.select(
        F.col(key).cast("bigint").alias("id"),
        scaled(F.col(vector), scale).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("q"),
    )
    held = held.where("v is not null").withColumn("dim", F.size("v"))
    held = checkpointed(held.withColumn("row", F.monotonically_increasing_id()))
    count = held.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q")).first()
    blocks, groups = (max(1, -(-count[c] // size)) for c, size in (("n", ROWS), ("q", QUERIES)))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lanes = min(groups, max(1, -(-tasks // blocks)))
    wide = F.exists("v", lambda c: F.abs(c) >= WIDE).cast("int")
    mixed = F.xxhash64("row")
    # narrow rows are in the blocks 0, 2, 4 …, wide ones in 1, 3, 5 …
    rows = _packed(held.withColumn("block", 2 * F.pmod(mixed, F.lit(blocks)) + wide), "block")
    asked = _packed(
        held.where("q").withColumn("group", 2 * F.pmod(mixed, F.lit(groups)) + wide), "group"
    )
    body = ["dim", "n", "ids", "known", "vectors"]
    places = rows.select("dim", "block").distinct()
    lane = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    rows = rows.select(*body, "block", lane, F.lit(-1).cast("bigint").alias("group"))
    asked = asked.withColumnRenamed("block", "group").join(places, "dim")
    asked = asked.select(*body, "block", F.pmod("group", F.lit(lanes)).cast("int").alias("lane"), "group")
    deal = ["dim", "block", "lane"]
    both = rows.unionByName(asked).repartition(max(tasks, 1), *deal)
    found = both.sortWithinPartitions(*deal, "group").mapInPandas(_search(k), FOUND)
    order = (F.col("score").desc(), F.col("size").desc(), F.col("vec_id").asc_nulls_last())
    of_query = Window.partitionBy("asked")
    # of the rows that equal the query's own in key and vector, one is the query's own
    own = F.row_number().over(Window.partitionBy("asked", "same").orderBy(*order))
    others = found.withColumn("_own", own).where("not (same and _own = 1)")
    ranked = others.withColumn("rank", F.row_number().over(of_query.orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
