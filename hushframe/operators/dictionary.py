"""Names, places and organisations, matched against a dictionary table.

The dictionary is a DataFrame ``(phrase, entity_type)`` with the entity types
below.  A phrase is found in a message where its words stand in the text as
consecutive words; then every occurrence of the phrase as a substring is a span.

A small dictionary travels in the plan.  A larger one becomes two Aho-Corasick
automata, built once in each Python worker, that read each text once in Arrow
batches.  What would not fit a worker is joined on the word runs that a bitmap of the
dictionary lets pass.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.spans import SPANS, empty_spans, running
from hushframe.functions.text import is_blank
from hushframe.sources.tables import stage

# Score and detector order by entity type; source and language.
SCORES = {"PERSON": (0.75, 12), "LOCATION": (0.65, 13), "ORG": (0.65, 14)}
SOURCE = "nlp"
LANGUAGE = "en"
MIN_PHRASE = 2
# End of fixed values.

# Letters and digits, with inner apostrophes and hyphens; possessive, so that a
# long chain needs no recursion.
WORD = r"[\p{L}\p{N}]++(?:['’-][\p{L}\p{N}]++)*+"
INLINE_PHRASES = 5000
#: Characters of all phrases up to which automata are built: some hundred bytes of a
#: worker's memory each.
AUTOMATON_CHARS = 4_000_000
#: Bits of the bitmap for each entry of a joined dictionary, and at most (2^28: 32 MB).
BITS_EACH, MOST_BITS = 16, 28
#: Words that are hashed at a time.
HASHED_WORDS = 1 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def ngrams(tokens: Column, longest: int) -> Column:
    """Distinct runs of 1 to ``longest`` consecutive words."""

    def runs(n: int) -> Column:
        if n == 1:
            return tokens
        starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
        return F.when(
            F.size(tokens) >= n,
            F.transform(
                starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " ")
            ),
        ).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*(runs(n) for n in range(1, longest + 1))))


def occurrences(text: Column, phrase: Column) -> Column:
    """0-based starts of every occurrence of ``phrase``, overlapping ones too.

    The text is split in front of each occurrence; the pieces' running length
    gives the starts.  One character is put in front because a split at the very
    start leaves no empty piece.
    """
    quoted = F.concat(
        F.lit(r"(?=\Q"), F.replace(phrase, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)")
    )
    pieces = F.split(F.concat(F.lit("\n"), text), quoted, -1)

    # The last end is that of the text; the others are where a phrase starts.
    ends = running(F.transform(pieces, F.length), lambda a, b: a + b)
    return F.transform(F.slice(ends, F.lit(1), F.size(pieces) - 1), lambda end: end - 1)


def _of_type(entity_type: Column, field: int, kind: str) -> Column:
    value = F.lit(None).cast(kind)
    for name, fixed in SCORES.items():
        value = F.when(entity_type == name, F.lit(fixed[field])).otherwise(value)
    return value


def _spans(text: Column, entry: Column) -> Column:
    """All spans of one dictionary entry ``struct<phrase, entity_type>``."""
    return F.transform(
        occurrences(text, entry["phrase"]),
        lambda start: F.struct(
            entry["entity_type"].alias("entity_type"),
            start.alias("start"),
            (start + F.length(entry["phrase"])).alias("end"),
            _of_type(entry["entity_type"], 0, "double").alias("score"),
            entry["phrase"].alias("value"),
            F.lit(SOURCE).alias("source"),
            _of_type(entry["entity_type"], 1, "int").alias("det_ord"),
        ),
    )


def _expand(text: Column, entries: Column) -> Column:
    return F.when(
        F.size(entries) > 0,
        F.flatten(F.transform(entries, lambda e: _spans(text, e))).cast(SPANS),
    ).otherwise(empty_spans())


def usable(dictionary: DataFrame) -> DataFrame:
    """Distinct entries of a known type that are long enough and have words.

    ``run`` is the phrase's words joined by one space, by which it is looked for: signs
    between words (``St. Louis``) are then those of the phrase, as only its occurrences
    become spans.
    """
    return (
        dictionary.where(F.col("entity_type").isin(*SCORES))
        .where(F.length("phrase") >= MIN_PHRASE)
        .select("phrase", "entity_type")
        .distinct()
        .withColumn("run", F.array_join(words(F.col("phrase")), " "))
        .where(F.col("run") != "")
    )


def dictionary_matches(
    df: DataFrame,
    dictionary: DataFrame | None,
    keys: Sequence[str] = ("scope_id", "seq"),
    text: str = "text",
    lang: str = "lang",
    out: str = "dictionary_spans",
    inline_phrases: int = INLINE_PHRASES,
    automaton_chars: int = AUTOMATON_CHARS,
) -> DataFrame:
    """Add the dictionary spans of each message; ``None`` means no dictionary.

    Only English, non-blank text is searched.  The size of the dictionary is
    measured first.  One of at most ``inline_phrases`` travels inside the plan, one of at
    most ``automaton_chars`` characters as automata; either way the search is one narrow
    pass over the text.  A larger one is joined on the phrase: of the distinct word runs of
    each message those that a bitmap of the dictionary lets pass, without text, meet the
    dictionary.  A very common phrase is a skewed key with few dictionary rows, which
    adaptive execution splits.
    """
    if dictionary is None:
        return df.withColumn(out, empty_spans())
    entries = stage(usable(dictionary))  # read some times, and often the result of a job
    # One row more than may travel in the plan tells whether the dictionary is small.
    head = entries.limit(inline_phrases + 1).collect()
    if not head:
        return df.withColumn(out, empty_spans())
    searched = (F.col(lang) == LANGUAGE) & ~is_blank(F.col(text))
    if len(head) <= inline_phrases:
        longest = max(r["run"].count(" ") + 1 for r in head)
        grams = F.when(searched, ngrams(words(F.col(text)), max(1, longest)))
        return _inline(df, head, grams, text, out)
    size = entries.agg(
        F.sum(F.length("phrase") + F.length("run")).alias("chars"),
        F.count(F.lit(1)).alias("n"),
        F.sort_array(F.collect_set(F.size(F.split("run", " ")))).alias("lengths"),
    ).first()
    if size["chars"] <= automaton_chars:
        listed = sorted(tuple(r) for r in entries.select("phrase", "entity_type", "run").collect())
        return _scanned(df, listed, searched, text, out)
    return _joined(df, entries, size["n"], size["lengths"], searched, keys, text, out)


def _inline(df, entries, grams, text, out) -> DataFrame:
    listed = sorted((r["phrase"], r["entity_type"], r["run"]) for r in entries)
    known = F.from_json(
        F.lit(json.dumps([{"phrase": p, "entity_type": t, "run": r} for p, t, r in listed])),
        "array<struct<phrase:string,entity_type:string,run:string>>",
    )
    runs = sorted({r for _, _, r in listed})
    found = F.filter(F.coalesce(F.col("__grams"), F.array()), lambda g: g.isin(runs))
    picked = F.when(
        F.size("__found") > 0,
        F.filter(known, lambda k: F.array_contains(F.col("__found"), k["run"])),
    ).otherwise(F.array().cast("array<struct<phrase:string,entity_type:string,run:string>>"))
    return (
        df.withColumn("__grams", grams)
        .withColumn("__found", found)
        .withColumn("__picked", picked)
        .withColumn(out, _expand(F.col(text), F.col("__picked")))
        .drop("__grams", "__found", "__picked")
    )


#: Of an arrow function: the type ``SPANS``.
_ARROW_SPANS = pa.list_(
    pa.struct(
        [
            pa.field("entity_type", pa.string()),
            pa.field("start", pa.int32()),
            pa.field("end", pa.int32()),
            pa.field("score", pa.float64()),
            pa.field("value", pa.string()),
            pa.field("source", pa.string()),
            pa.field("det_ord", pa.int32()),
        ]
    )
)

#: A phrase, its entity type and where it starts.
Place = tuple[str, str, int]


def _packed(found: Sequence[list[Place]]) -> pa.ListArray:
    """The spans of each text, put together by column: no Python object for each field."""
    flat = [place for places in found for place in places]
    phrases, kinds, starts = zip(*flat, strict=True) if flat else ((), (), ())
    value, start = pa.array(phrases, pa.string()), pa.array(starts, pa.int32())
    kind = pa.array(kinds, pa.string()).dictionary_encode()
    fixed = [SCORES[k] for k in kind.dictionary.to_pylist()]
    columns = {
        "entity_type": kind.dictionary.take(kind.indices),
        "start": start,
        "end": pc.add(start, pc.utf8_length(value)),
        "score": pa.array([score for score, _ in fixed], pa.float64()).take(kind.indices),
        "value": value,
        "source": pa.repeat(pa.scalar(SOURCE), len(flat)),
        "det_ord": pa.array([order for _, order in fixed], pa.int32()).take(kind.indices),
    }
    fields = list(_ARROW_SPANS.value_type)
    spans = pa.StructArray.from_arrays([columns[f.name] for f in fields], fields=fields)
    offsets = np.concatenate([[0], np.cumsum([len(places) for places in found])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)


def scanner(entries: Sequence[tuple[str, str, str]]) -> Callable[[str, str], list[Place]]:
    """Finds all spans of ``(phrase, entity_type, run)`` entries in a text, given its words.

    One automaton reads the words, joined by spaces, for runs of whole words; if it finds
    any, the other reads the text for all occurrences of phrases, also inside words.
    """
    by_phrase: dict[str, tuple[str, list[str]]] = {}
    for phrase, entity_type, run in entries:
        by_phrase.setdefault(phrase, (run, []))[1].append(entity_type)
    runs, phrases = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, (run, kinds) in by_phrase.items():
        runs.add_word(f" {run} ", run)
        phrases.add_word(phrase, (phrase, run, sorted(kinds)))
    runs.make_automaton()
    phrases.make_automaton()

    def scan(text: str, spaced: str) -> list[Place]:
        found = {run for _, run in runs.iter(spaced)}
        if not found:
            return []
        return sorted(
            (phrase, kind, end + 1 - len(phrase))
            for end, (phrase, run, kinds) in phrases.iter(text)
            if run in found
            for kind in kinds
        )

    return scan


#: The last dictionary's scanner of this worker, by the broadcast's number.
_SCANNER: dict[int, Callable[[str, str], list[Place]]] = {}


def _scanner(entries: Broadcast) -> Callable[[str, str], list[Place]]:
    number = hash(tuple(entries.value)) if entries.value else 0
    if number not in _SCANNER:
        _SCANNER.clear()
        _SCANNER[number] = scanner(entries.value)
    return _SCANNER[number]


def _scanned(df, entries, searched, text, out) -> DataFrame:
    """The same by automata.  Only texts that hold something cross back as spans."""
    shipped = df.sparkSession.sparkContext.broadcast(entries)

    @F.arrow_udf(SPANS)
    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        scan = _scanner(shipped)
        for texts, spaced in batches:
            rows = zip(texts.to_pylist(), spaced.to_pylist(), strict=True)
            yield _packed([scan(t, w) if t and w else [] for t, w in rows])

    spaced = F.concat(F.lit(" "), F.array_join(words(F.col(text)), " "), F.lit(" "))
    read = F.when(searched, F.col(text))
    return df.withColumn(out, find(read, F.when(searched, spaced)).cast(SPANS))


def _hashed_runs(
    words: pa.ListArray, lengths: Sequence[int]
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of ``lengths`` the places and hashes of the runs of so many words.

    A place is that of the run's first word in ``words.flatten()``; no run goes over the end
    of its list.
    """
    encoded = words.flatten().dictionary_encode()
    listed = encoded.dictionary.to_numpy(zero_copy_only=False).astype(object)
    each = pd.util.hash_array(listed, categorize=False) if len(listed) else np.zeros(0, np.uint64)
    one = each[encoded.indices.to_numpy()]
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(one))
    at, run = np.arange(len(one)), one
    for n in range(1, max(lengths, default=0) + 1):
        if n > 1:
            on = left[at] >= n
            at = at[on]
            run = run[on] * np.uint64(0x100000001B3) + one[at + n - 1]
        if n in lengths:
            yield n, at, run


def _bit(run: np.ndarray, bits: int) -> np.ndarray:
    return ((run * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _bitmap(entries: DataFrame, lengths: Sequence[int], bits: int) -> np.ndarray:
    """2^bits bits, of which those are set that the runs of ``entries`` hash to.

    At most 32 MB, however many entries there are; only bits pass through the driver.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = pc.split_pattern(batch.column(0), " ").cast(pa.list_(pa.string()))
            starts, sizes = runs.offsets.to_numpy()[:-1], pc.list_value_length(runs).to_numpy()
            size_at = np.zeros(len(runs.flatten()), np.int64)
            size_at[starts - runs.offsets[0].as_py()] = sizes
            for n, at, run in _hashed_runs(runs, lengths):
                found = np.unique(_bit(run[size_at[at] == n], bits)) + 1
                yield pa.record_batch([pa.array(found)], ["place"])

    bucket, place = F.bitmap_bucket_number("place"), F.bitmap_bit_position("place")
    rows = entries.select("run").mapInArrow(places, "place bigint")
    rows = rows.groupBy(bucket.alias("b")).agg(F.bitmap_construct_agg(place).alias("m"))
    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for b, part in rows.toLocalIterator():
        start = (b - 1) * len(part)
        out[start : start + len(part)] = np.frombuffer(part, np.uint8)[: len(out) - start]
    return out


def _runs_in(words: pa.ListArray, lengths: Sequence[int], bitmap: np.ndarray) -> pa.ListArray:
    """The distinct runs of each list that the bitmap lets pass."""
    bits = (8 * len(bitmap)).bit_length() - 1
    flat = words.flatten()
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
    row_of = np.repeat(np.arange(len(words)), sizes)
    rows, runs = [np.zeros(0, np.int64)], [pa.array([], pa.string())]
    for n, at, run in _hashed_runs(words, lengths):
        bit = _bit(run, bits)
        at = at[(bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
        parts = [flat.take(pa.array(at + i)) for i in range(n)]
        rows.append(row_of[at])
        runs.append(parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " "))
    encoded = pa.concat_arrays([r.cast(pa.string()) for r in runs]).dictionary_encode()
    kinds = max(1, len(encoded.dictionary))
    pairs = np.unique(np.concatenate(rows) * kinds + encoded.indices.to_numpy())
    offsets = np.searchsorted(pairs // kinds, np.arange(len(words) + 1))
    found = encoded.dictionary.take(pa.array(pairs % kinds))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found)


def _candidates(words: Column, entries: DataFrame, n: int, lengths: Sequence[int]) -> Column:
    """The distinct runs of each message that may be in the dictionary."""
    bits = min(MOST_BITS, max(15, (BITS_EACH * n).bit_length()))
    shipped = entries.sparkSession.sparkContext.broadcast(_bitmap(entries, lengths, bits))

    @F.arrow_udf("array<string>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bitmap = shipped.value
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy()
            part = (np.cumsum(sizes) - sizes) // HASHED_WORDS
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
            found = [_runs_in(batch[a:b], lengths, bitmap) for a, b in zip(cuts, cuts[1:])]
            yield pa.concat_arrays(found)

    return find(words)


def _picked_spans(text: Column, picked: Column) -> Column:
    """All occurrences of each message's own phrases, by one small automaton per text."""

    def places(text: str, phrases: list[str], kinds: list[str]) -> list[Place]:
        of: dict[str, list[str]] = {}
        for phrase, kind in zip(phrases, kinds, strict=True):
            of.setdefault(phrase, []).append(kind)
        automaton = ahocorasick.Automaton()
        for phrase in of:
            automaton.add_word(phrase, phrase)
        automaton.make_automaton()
        return sorted(
            (phrase, kind, end + 1 - len(phrase))
            for end, phrase in automaton.iter(text)
            for kind in of[phrase]
        )

    @F.arrow_udf(SPANS)
    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            ends = np.cumsum(sizes)
            phrases, kinds = (c.to_pylist() for c in lists.flatten().flatten())
            rows = zip(texts.to_pylist(), (ends - sizes).tolist(), ends.tolist(), strict=True)
            yield _packed(
                [places(t, phrases[a:b], kinds[a:b]) if t and a < b else [] for t, a, b in rows]
            )

    return find(F.when(picked.isNotNull(), text), picked).cast(SPANS)


def _joined(df, entries, n, lengths, searched, keys, text, out) -> DataFrame:
    """The same by a join on the word runs.

    Messages meet their phrases again by the SHA-256 of keys and text, so that missing
    keys are no loss and messages that share a key do not get each other's phrases.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0001")) for c in (*keys, text)]
    row = F.unhex(F.sha2(F.concat_ws("\u0000", *parts).cast("binary"), 256))
    named = df.withColumn("__row", row)
    runs = _candidates(F.when(searched, words(F.col(text))), entries, n, lengths)
    picked = (
        named.select("__row", F.explode(runs).alias("run"))
        .join(entries, "run")
        .groupBy("__row")
        .agg(F.collect_set(F.struct("phrase", "entity_type")).alias("__picked"))
    )
    return (
        named.join(picked, "__row", "left")
        .withColumn(out, _picked_spans(F.col(text), F.col("__picked")))
        .drop("__picked", "__row")
    )
