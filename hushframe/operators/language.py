"""Language of a text by character trigrams (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions.patterns import SPACE

# ---------------------------------------------------------------------------
# Supported languages, three-letter codes, shortest text.
# ---------------------------------------------------------------------------
SUPPORTED = ("en", "fr", "de", "es", "it", "pt", "nl", "pl", "ru", "ja", "zh")
ISO3 = {
    "eng": "en", "fra": "fr", "deu": "de", "spa": "es", "ita": "it", "por": "pt",
    "nld": "nl", "pol": "pl", "rus": "ru", "jpn": "ja", "cmn": "zh", "zho": "zh",
}
MIN_LENGTH = 10
DEFAULT_LANG = "en"
# End of fixed values.

PROFILE_SIZE = 300


def default_lang(locale: str | None) -> str:
    """The language of a locale such as ``fr-CA`` where supported, else English."""
    lang = (locale or "").split("-")[0]
    return lang if lang in SUPPORTED else DEFAULT_LANG


def normalise_lang(code: Column, default: str = DEFAULT_LANG) -> Column:
    """Map a three-letter code to a supported two-letter one.

    Codes outside the map are cut to two letters, which can meet a supported
    language; what is not supported becomes the default.
    """
    short = F.substring(code, 1, 2)
    for iso3, lang in ISO3.items():
        short = F.when(code == iso3, F.lit(lang)).otherwise(short)
    return F.when(short.isin(*SUPPORTED), short).otherwise(F.lit(default))


def _padded(text: Column) -> Column:
    """The lower-case letters, words parted by a space, with a space at both ends."""
    letters = F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")
    return F.concat(F.lit(" "), F.trim(letters), F.lit(" "))


def trigrams(text: Column) -> Column:
    """All character trigrams of the lower-case letters, words parted by a space."""
    return F.regexp_extract_all(_padded(text), F.lit("(?=(...))"), F.lit(1))


def _top(counts: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "trigram")
    return counts.withColumn("rank", F.row_number().over(best)).where(
        F.col("rank") <= size
    )


#: Bits of a code point; characters that are counted at a time; most cells of a table.
POINT_BITS, COUNTED_CHARS, MOST_CELLS = 21, 1 << 21, 1 << 22


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _packed(points: np.ndarray) -> np.ndarray:
    """All trigrams as integers, which sort as the trigrams do."""
    wide = points.astype(np.int64)
    return (((wide[:-2] << POINT_BITS) | wide[1:-1]) << POINT_BITS) | wide[2:]


def _strings(packed: np.ndarray) -> list[str]:
    mask = (1 << POINT_BITS) - 1
    parts = [(packed >> (POINT_BITS * i)) & mask for i in (2, 1, 0)]
    encoded = np.stack(parts, axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [encoded[i : i + 3] for i in range(0, len(encoded), 3)]


def trigram_counts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct packed trigrams, in order, and how often each stands in ``points``."""
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = np.zeros(int(points.max()) + 1, bool)
    seen[points] = True
    letters = np.flatnonzero(seen)
    k = len(letters)
    if k**3 > min(MOST_CELLS, 64 * len(points)):
        return np.unique(_packed(points), return_counts=True)
    one = (np.cumsum(seen) - 1)[points]
    table = np.bincount((one[:-2] * k + one[1:-1]) * k + one[2:])
    cell = np.flatnonzero(table)
    first, second, third = letters[cell // (k * k)], letters[cell // k % k], letters[cell % k]
    return (((first << POINT_BITS) | second) << POINT_BITS) | third, table[cell]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams of ``(lang, padded text)``, counted by language in pieces of the batch.

    Padded texts are put one after the other: only a trigram that goes over the end of one
    has two spaces together.
    """
    two = (32 << POINT_BITS) | 32
    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            joined = "".join(texts)
            for at in range(0, len(joined), COUNTED_CHARS):
                packed, n = trigram_counts(_points(joined[at : at + COUNTED_CHARS + 2]))
                inside = ((packed >> POINT_BITS) != two) & ((packed & ((1 << 2 * POINT_BITS) - 1)) != two)
                found = _strings(packed[inside])
                langs = pa.array([lang] * len(found), pa.string())
                columns = [langs, pa.array(found, pa.string()), pa.array(n[inside], pa.int64())]
                yield pa.record_batch(columns, ["lang", "trigram", "n"])


def language_profiles(
    df: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE
) -> DataFrame:
    """The most frequent trigrams of each language of a labelled corpus.

    Counted in Arrow batches before the shuffle, so that no row is made of each trigram of
    each text: what moves is one row per trigram and task.
    """
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    padded = labelled.select(F.col(lang).alias("lang"), _padded(F.col(text)).alias("text"))
    counts = (
        padded.mapInArrow(_counted, "lang string, trigram string, n bigint")
        .groupBy("lang", "trigram")
        .agg(F.sum("n").alias("n"))
    )
    return _top(counts, ["lang"], size)


#: Most languages of the profiles: their ranks are sent with the tasks.
MAX_PROFILES = 200


def profile_ranks(profiles: DataFrame, size: int = PROFILE_SIZE) -> dict[str, list]:
    """``{trigram: [(language, rank)]}`` of at most ``MAX_PROFILES`` profiles."""
    rows = profiles.where(F.col("rank") <= size).select("trigram", "lang", "rank")
    head = rows.limit(MAX_PROFILES * size + 1).collect()
    if len(head) > MAX_PROFILES * size:
        raise ValueError(f"profiles of more than {MAX_PROFILES} languages")
    ranks: dict[str, list] = {}
    for trigram, lang, rank in head:
        ranks.setdefault(trigram, []).append((lang, rank))
    return ranks


class Nearest:
    """Finds the language with the smallest rank distance; None if it shares no trigram.

    A trigram that a profile lacks costs ``size``, for all profiles alike, so the
    smallest distance is the largest sum of ``size - difference`` over the shared ones.
    """

    def __init__(self, ranks: dict[str, list], size: int):
        self.size = size
        self.langs = sorted({lang for known in ranks.values() for lang, _ in known})
        column = {lang: i for i, lang in enumerate(self.langs)}
        listed = [t for t in ranks if len(t) == 3]
        packed = _packed(_points("".join(listed)))[::3] if listed else np.zeros(0, np.int64)
        order = np.argsort(packed)
        self.known = packed[order]
        self.rank = np.zeros((len(listed), len(self.langs)), np.int64)
        for row, i in enumerate(order.tolist()):
            for lang, rank in ranks[listed[i]]:
                self.rank[row, column[lang]] = rank

    def __call__(self, padded: str) -> str | None:
        found, n = trigram_counts(_points(padded))
        if not len(found) or not len(self.known):
            return None
        best = found[np.argsort(-n, kind="stable")[: self.size]]
        row = np.minimum(np.searchsorted(self.known, best), len(self.known) - 1)
        shared = np.flatnonzero(self.known[row] == best)
        other = self.rank[row[shared]]
        gain = np.where(other > 0, self.size - np.abs(other - (shared + 1)[:, None]), 0)
        scores = gain.sum(axis=0)
        return self.langs[int(scores.argmax())] if scores.any() else None


def nearest_profile(padded: str, ranks: dict[str, list], size: int) -> str | None:
    return Nearest(ranks, size)(padded)


def detected_lang(
    text: Column,
    profiles: DataFrame,
    default: str = DEFAULT_LANG,
    size: int = PROFILE_SIZE,
) -> Column:
    """The language of each text, worked out in its row; null texts get the default.

    Ranking needs a histogram per text, which no built-in function gives: exploded
    trigrams are some twenty times the text and would have to be shuffled.  So letters
    are prepared by built-in functions and ranked in Arrow batches.  Short texts get the
    default, ties go to the smaller language code.
    """
    ranks = profile_ranks(profiles, size)

    @F.arrow_udf("string")
    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        language = Nearest(ranks, size)
        for batch in batches:
            found = (t if t is None else language(t) for t in batch.to_pylist())
            yield pa.array(found, pa.string())

    # of at least MIN_LENGTH characters from the first to the last that is no white space
    long_enough = text.rlike(rf"(?s)[^{SPACE}].{{{MIN_LENGTH - 2}}}.*?[^{SPACE}]")
    code = nearest(F.when(long_enough, _padded(text)))
    return F.coalesce(normalise_lang(code, default), F.lit(default))


def identify_language(
    df: DataFrame,
    profiles: DataFrame,
    keys: Sequence[str] = ("scope_id", "seq"),
    text: str = "text",
    default: str = DEFAULT_LANG,
    size: int = PROFILE_SIZE,
) -> DataFrame:
    """``(keys, detected_lang)`` for every message, a row per row and without a shuffle."""
    found = detected_lang(F.col(text), profiles, default, size)
    return df.select(*keys, found.alias("detected_lang"))


def with_language(
    df: DataFrame,
    profiles: DataFrame | None = None,
    text: str = "text",
    lang: str = "lang",
    default: str = DEFAULT_LANG,
) -> DataFrame:
    """Fill a missing ``lang``: by identification with profiles, else the default."""
    known = F.col(lang)
    if profiles is None:
        return df.withColumn(lang, F.coalesce(known, F.lit(default)))
    found = detected_lang(F.when(known.isNull(), F.col(text)), profiles, default)
    return df.withColumn(lang, F.coalesce(known, found))
