"""Language identification by compression against per-language dictionaries."""

from __future__ import annotations

import math

import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushframe.llm.common import broadcast_if_small, fields, map_rows

#: Letters and their combining marks make words; numbers and signs of any kind do not.
_BETWEEN = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
#: Texts are compressed in chunks of so many bytes, so that a long one never moves
#: the dictionary out of the window.
CHUNK = 16 << 10
#: Most labels that are learned: all dictionaries are sent to every task.
LANGUAGES = 500
#: A raw-content dictionary has to have so many bytes.
LEAST_BYTES = 8


def _parameters() -> zstandard.ZstdCompressionParameters:
    """Matches from three bytes on, as syllables are short; a window over chunk and dictionary."""
    return zstandard.ZstdCompressionParameters(
        window_log=18,
        chain_log=17,
        hash_log=17,
        search_log=4,
        min_match=3,
        target_length=32,
        strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=0,
        write_dict_id=0,
    )


def letters_only(text: str) -> bytes:
    """Lower-case words of letters, a space between them, in UTF-8; empty without letters."""
    words = _BETWEEN.sub(" ", text.lower()).strip()
    return words.encode("utf-8", "replace") if _LETTER.search(words) else b""


def language_dictionaries(
    labelled: DataFrame,
    text: str,
    lang: str,
    key: str,
    docs: int = 128,
    piece: int = 1024,
    seed: int = 7,
) -> dict[str, bytes]:
    """One raw-content dictionary per language, from labelled rows.

    Of each language the ``docs`` rows with the smallest seeded key hashes give a
    passage of at most ``piece`` bytes from a place that the hash picks, so a
    dictionary has at most ``docs * piece`` bytes whatever the size of the table.
    Rows without language, key or letters give nothing and take no place.  The languages
    come in falling order of their rows (all are counted), then by name; of a column with
    more than ``LANGUAGES`` labels the first ones are learned.  A passage of few bytes is
    repeated, so a language with one short text is learned too.
    """
    lettered = F.col(text).rlike(r"\p{L}")
    rows = labelled.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & lettered)
    counted = rows.groupBy(F.col(lang).alias("lang")).count()
    sizes = dict(counted.orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect())
    rows = rows.where(F.col(lang).isin(list(sizes)))
    order = F.xxhash64(F.lit(seed), F.col(key))
    chosen = rows.select(F.col(lang).alias("_lang"), F.col(key).alias("_key"), order.alias("_h"))
    chosen = chosen.distinct().withColumn("_part", F.col("_h").bitwiseAND(63))
    for parts in (["_lang", "_part"], ["_lang"]):  # in parts first: a language may be most rows
        first = F.row_number().over(Window.partitionBy(*parts).orderBy("_h", "_key"))
        chosen = chosen.withColumn("_n", first).where(F.col("_n") <= docs).drop("_n")
    chosen = broadcast_if_small(chosen.drop("_part"))
    texts = rows.select(
        F.col(lang).alias("_lang"), F.col(key).alias("_key"), F.col(text).alias("_text")
    ).join(chosen, ["_lang", "_key"])

    def make():
        def passage(langs, keys, hashes, texts):
            cut = []
            for h, t in zip(hashes, texts, strict=True):
                body = letters_only(t or "")
                start = h % max(1, len(body) - piece + 1)
                cut.append(body[start : start + piece].decode("utf-8", "ignore").strip())
            return langs, hashes, cut

        return passage

    schema = f"{fields(texts, '_lang')}, _h bigint, _cut string"
    found = map_rows(texts, ["_lang", "_key", "_h", "_text"], schema, make)
    out: dict[str, list] = {}
    for row in found.collect():  # bounded: docs * piece bytes a language
        out.setdefault(row["_lang"], []).append((row["_h"], row["_cut"]))
    joined = {k: " ".join(c for _, c in sorted(v) if c).encode() for k, v in out.items()}
    order = sorted(joined, key=lambda k: (-sizes[k], k))
    return {k: joined[k] * -(-LEAST_BYTES // len(joined[k])) for k in order if joined[k]}


def identify(
    df: DataFrame,
    dictionaries: dict[str, bytes],
    key: str,
    text: str,
    min_margin: float = 0.02,
) -> DataFrame:
    """Language of each whole text: ``key, lang_best, lang_pred, margin, score``.

    A text is encoded once per language with that language's dictionary; the smallest
    total size wins, ties go to the language that comes first.  ``margin`` is how much larger the
    second size is, as a share of it; below ``min_margin`` the choice is rejected
    (``lang_pred`` null, ``lang_best`` still tells it).  ``score`` weighs the sizes as
    code lengths, one over the sum of ``exp((best - size) / 8)``.  A null text or one
    without letters is ``und`` with margin and score 0, as is every text if there is no
    dictionary.
    """
    names = list(dictionaries)

    def make():
        coders, params = [], _parameters()
        for name in names:
            d = zstandard.ZstdCompressionDict(
                dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT
            )
            d.precompute_compress(compression_params=params)
            coders.append(
                zstandard.ZstdCompressor(compression_params=params, dict_data=d).compress
            )

        def classify(keys, texts):
            best, pred, margins, scores = [], [], [], []
            for t in texts:
                body = letters_only(t or "")
                if not body or not coders:
                    best.append("und"), pred.append("und"), margins.append(0.0), scores.append(0.0)
                    continue
                chunks = [body[i : i + CHUNK] for i in range(0, len(body), CHUNK)]
                sizes = [sum(len(f(c)) for c in chunks) for f in coders]
                least = min(sizes)
                at = sizes.index(least)
                rest = sizes[:at] + sizes[at + 1 :]
                second = min(rest) if rest else math.inf
                margin = 1.0 if not rest else (second - least) / second
                best.append(names[at])
                pred.append(names[at] if margin >= min_margin else None)
                margins.append(margin)
                scores.append(1 / sum(math.exp(max(-700.0, (least - s) / 8)) for s in sizes))
            return keys, best, pred, margins, scores

        return classify

    schema = f"{fields(df, key)}, lang_best string, lang_pred string, margin double, score double"
    return map_rows(df, [key, text], schema, make)


def held_out(key, folds: int = 5):
    """True where crc32 of the key's text is divisible by ``folds``; null keys are held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(True))

