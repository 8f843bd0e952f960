"""Groups of spelling variants: words that are one edit apart, found by bit-sliced sets.

Words are compared inside cells that hold an exact half of them in common.  In a cell each
(position, letter) has a bitset over the cell's words; one pass over a word's letters keeps
the set of words without an error so far and, by shifted positions, those with one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import checkpointed, pieces

_RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
#: Distinct words that a task counts before it hands its counts on.
_WORDS = 200_000
_ROWS = 20_000

LENGTH = 6
COUNT = 5
FACTOR = 5
#: Words whose bitsets a task holds at once, and words compared with them in one cell.
BLOCK = 1 << 14


def text_words(key: str, text: bytes | None, every: int) -> Iterator[tuple[str, int]]:
    """A text's distinct runs of Latin letters, with A-Z in lower case, and their counts.

    A run loses one of its code points if ``every`` divides the hash of key and run.
    """
    start = crc32(f"{key}:".encode())
    runs = Counter(map(re.Match.group, _RUN.finditer((text or b"").lower().decode())))
    for run, n in runs.items():
        h = crc32(run.encode(), start)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def word_counts(
    df: DataFrame, key: str, text: str, length: int = LENGTH, every: int = 199
) -> DataFrame:
    """``word, n``: words of ``length`` code points or more over all whole texts.

    Tasks add up before the shuffle, in a table of bounded size.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            words, ns = pa.array(list(counts), pa.string()), pa.array(list(counts.values()))
            counts.clear()
            return pa.RecordBatch.from_arrays([words, ns.cast(pa.int64())], ["word", "n"])

        for batch in batches:
            for piece in pieces(batch):
                for of, value in zip(*(c.to_pylist() for c in piece.columns)):
                    for word, n in text_words(of, value, every):
                        if len(word) >= length:
                            counts[word] += n
                    if len(counts) >= _WORDS:
                        yield out()
        yield out()

    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    body = F.col(text).cast("string").cast("binary")
    found = df.select(name, body).mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def halves(words: DataFrame) -> DataFrame:
    """``part, short, side, word, n``: each word under every half that it may share.

    Of two words one edit apart let ``short`` be the shorter one's length.  The edit is in
    one place, so either both start with the same ``short // 2`` letters (side 0) or they
    end with the same others (side 1).  A word takes part as the shorter one, or one of two
    equally long, and as the longer one.
    """
    size, short = F.length("word"), F.col("short")
    head = F.floor(short / 2).cast("int")
    tail = short - head
    first = F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), head).alias("half"))
    last = F.substring("word", size - tail + 1, tail)
    last = F.struct(F.lit(1).alias("side"), last.alias("half"))
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("short"))
    rows = rows.select("word", "n", "short", F.explode(F.array(first, last)).alias("at"))
    part = F.xxhash64("short", "at.side", "at.half").alias("part")
    return rows.select(part, "short", "at.side", "word", "n")


def cells(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows ``(part, col, row, asked)``: words held as bitsets and words asked about, by cell.

    Parts are counted first.  One with more words than ``block`` (fewer if they are long)
    becomes a grid: a word is held in all cells of its column and asked in all cells of its
    row, so any two words still meet, once, and no cell has many more than ``block``.
    """
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("_n"), F.max("short").alias("_s"))
    room = F.greatest(F.lit(1), F.floor(F.lit(16 * block) / F.greatest("_s", F.lit(16))))
    sizes = sizes.where("_n > 1").select("part", F.ceil(F.col("_n") / room).cast("int").alias("_cuts"))
    rows = rows.join(checkpointed(sizes), "part")
    own = F.pmod(F.xxhash64("word"), F.col("_cuts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1))
    rows = rows.withColumn("_own", own).withColumn("_other", other)

    def place(asked: int, col: str, row: str) -> Column:
        return F.struct(F.lit(asked).alias("asked"), F.col(col).alias("col"), F.col(row).alias("row"))

    both = F.explode(F.array(place(0, "_own", "_other"), place(1, "_other", "_own")))
    return rows.withColumn("_at", both).select("part", "short", "side", "_at.*", "word", "n")


class Slices:
    """Bitsets over at most some ``BLOCK`` words: per (position, letter) and per length.

    Bits are given in the order of falling counts, then words, so that the lowest bit of a
    set is its most frequent word.
    """

    def __init__(self, words: list[tuple[int, str]]):
        self.words = words = sorted(words, key=lambda w: (-w[0], w[1]))
        self.all = (1 << len(words)) - 1
        self.size: dict[int, int] = {}
        self.at: dict[tuple[int, str], int] = {}
        bits: dict[tuple[int, str], bytearray] = {}
        sizes: dict[int, bytearray] = {}
        width = len(words) + 7 >> 3
        for i, (_, word) in enumerate(words):
            byte, bit = i >> 3, 1 << (i & 7)
            sizes.setdefault(len(word), bytearray(width))[byte] |= bit
            for place in enumerate(word):
                bits.setdefault(place, bytearray(width))[byte] |= bit
        for found, of in ((self.at, bits), (self.size, sizes)):
            found.update((k, int.from_bytes(v, "little")) for k, v in of.items())

    def near(self, word: str, head: int, same_head: bool, lengths: tuple[int, ...]) -> int:
        """The set of words of ``lengths`` that are exactly one edit from ``word``.

        Only those that start with the same ``head`` letters, or only the others.
        """
        at, none = self.at.get, 0
        exact = self.all  # the letters so far are equal
        replaced = inserted = deleted = none
        heads = exact
        for i, letter in enumerate(word):
            here = at((i, letter), 0)
            # the other word has a letter more: its next position answers
            inserted = (inserted | exact) & at((i + 1, letter), 0)
            # it has a letter less: its last position answers, or this letter is the one
            deleted = (deleted & at((i - 1, letter), 0)) | exact
            replaced = (replaced & here) | (exact & ~here)
            exact &= here
            if i + 1 == head:
                heads = exact
            if not (exact | replaced | inserted | deleted):
                return 0
        size, n = self.size.get, len(word)
        found = 0
        if n in lengths:
            found = replaced & size(n, 0)
        if n + 1 in lengths:
            found |= (inserted | exact) & size(n + 1, 0)
        if n - 1 in lengths:
            found |= deleted & size(n - 1, 0)
        return found & heads if same_head else found & ~heads


def neighbours(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word, n_near, near_n, near`` of every word that is one edit from another.

    ``words`` has distinct ``word`` and ``n``.  ``near`` is the near word of the largest
    ``n``, ties to the smaller.  A cell answers each word with a count and its best, never
    with pairs.
    """
    place = ["part", "short", "side", "col", "row"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            row
            for batch in batches
            for piece in pieces(batch)
            for row in zip(*(c.to_pylist() for c in piece.columns))
        )
        out: list[tuple] = []
        for (_, short, side, _, _), group in groupby(rows, key=lambda r: r[:5]):
            held: list[tuple[int, str]] = []
            slices = None
            for *_, asked, word, n in group:
                if not asked:
                    held.append((n, word))
                    continue
                if slices is None:
                    slices = Slices(held)
                lengths = (short, short + 1) if len(word) == short else (short,)
                found = slices.near(word, short // 2, side == 0, lengths)
                if found:
                    best = slices.words[(found & -found).bit_length() - 1]
                    out.append((word, found.bit_count(), *best))
            if len(out) >= _ROWS:
                yield _answers(out)
                out = []
        yield _answers(out)

    rows = cells(halves(words), block).select(*place, "asked", "word", "n")
    # the work grows with the words, not with the bytes by which parts are merged
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, *place).sortWithinPartitions(*place, "asked")
    found = rows.mapInArrow(run, "word string, n_near bigint, near_n bigint, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select(
        "word", "n_near", (-F.col("best.order")).alias("near_n"), F.col("best.near").alias("near")
    )


def _answers(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    columns = zip(*rows) if rows else [()] * 4
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, ["word", "n_near", "near_n", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: where following the forms ends.

    Every step goes to a word with a larger count, so chains end; each round doubles the
    steps, and there are few, as counts grow by a factor.
    """
    ends = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if ends.join(on, "root", "left_semi").isEmpty():
            return ends
        ends = ends.join(on, "root", "left")
        ends = checkpointed(ends.select("word", F.coalesce("_next", "root").alias("root")))


def variants(
    df: DataFrame,
    key: str,
    text: str,
    length: int = LENGTH,
    least: int = COUNT,
    factor: int = FACTOR,
    every: int = 199,
    block: int = BLOCK,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the table.

    Words have at least ``length`` code points and ``least`` uses.  ``form`` is the near
    word (one code point inserted, deleted or replaced) with the most uses, if those are at
    least ``factor`` times the word's own; ``root`` is where following forms ends.

    Null and empty texts have no words; a null key counts as empty; repeated rows count
    again.  Ties go to the smaller word.  An empty table gives no row.
    """
    words = word_counts(df, key, text, length, every)
    words = checkpointed(words.where(F.col("n") >= least))
    found = words.join(neighbours(words, block), "word", "left")
    is_form = F.col("near_n") >= factor * F.col("n")
    found = checkpointed(
        found.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(is_form, F.col("near")).alias("form"),
            F.when(is_form, F.col("near_n")).alias("form_n"),
        )
    )
    ends = roots(found.where("form is not null"))
    root = F.coalesce("root", "word").alias("root")
    return found.join(ends, "word", "left").select("word", "form", root, "n", "n_near", "form_n")
