import pytest
from pyspark.sql import functions as F

from hushframe.operators.language import (
    default_lang,
    identify_language,
    language_profiles,
    nearest_profile,
    normalise_lang,
    trigrams,
    with_language,
)

SAMPLES = {
    "en": "the quick brown fox jumps over the lazy dog and then the other thing that they think",
    "fr": "le renard brun saute par dessus le chien paresseux et puis les autres choses de la ville",
    "de": "der schnelle braune fuchs springt ueber den faulen hund und dann noch eine andere sache",
}


@pytest.fixture(scope="module")
def profiles(messages):
    return language_profiles(messages(*((t, lang) for lang, t in SAMPLES.items())))


def brute(text, profiles):
    def ranks(t):
        words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        padded = " " + " ".join(words) + " "
        counts = {}
        for i in range(len(padded) - 2):
            counts[padded[i : i + 3]] = counts.get(padded[i : i + 3], 0) + 1
        best = sorted(counts, key=lambda g: (-counts[g], g))[:300]
        return {g: i + 1 for i, g in enumerate(best)}

    own = ranks(text)
    far = {
        lang: sum(abs(p[g] - r) if g in p else 300 for g, r in own.items())
        for lang, p in ((lang, ranks(t)) for lang, t in profiles.items())
    }
    return min(far, key=lambda lang: (far[lang], lang))


def test_identify(messages, profiles):
    texts = [
        "the dog thinks that this is the thing", "la ville et les choses", "und der hund springt",
        "then le der", "short", "", None, "1234567890 42", "that andere chose de la",
    ]
    got = {
        r.seq: r.detected_lang
        for r in identify_language(messages(*((t, None) for t in texts)), profiles).collect()
    }
    for i, text in enumerate(texts):
        usable = text is not None and len(text.strip()) >= 10 and any(c.isalpha() for c in text)
        assert got[i] == (brute(text, SAMPLES) if usable else "en"), text


def test_given_language_wins(messages, profiles):
    df = messages(("la ville et les choses", "de"), ("la ville et les choses", None))
    got = {r.seq: r.lang for r in with_language(df, profiles).collect()}
    assert got == {0: "de", 1: "fr"}
    assert {r.lang for r in with_language(df, default="it").collect()} == {"de", "it"}


def test_codes(spark):
    codes = ["eng", "deu", "cmn", "zho", "est", "swe", "und", "jpn", "fr"]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    got = [r[0] for r in df.select(normalise_lang(F.col("c"), "en")).collect()]
    assert got == ["en", "de", "zh", "zh", "es", "en", "en", "ja", "fr"]
    assert [default_lang(x) for x in ("fr-CA", "sv-SE", None, "zh")] == ["fr", "en", "en", "zh"]


def test_trigrams(spark):
    row = spark.range(1).select(trigrams(F.lit("Éa, b"))).first()
    assert row[0] == [" éa", "éa ", "a b", " b "]


def test_nothing_is_shuffled(messages, profiles):
    plan = identify_language(messages(("some longer text here", None)), profiles)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_messages_that_share_a_key_stay_apart(spark, profiles):
    rows = [("s", 1, "la ville et les choses", None), ("s", 1, "und der hund springt", None)]
    df = spark.createDataFrame(rows, "scope_id string, seq bigint, text string, lang string")
    assert [r.lang for r in with_language(df, profiles).collect()] == ["fr", "de"]


def test_profiles_count_in_batches(spark, messages, monkeypatch):
    """No row is made of each trigram; counts equal those of plain loops, over all cuts."""
    import io
    from contextlib import redirect_stdout

    texts = [
        ("Éa, b b b", "fr"), ("", "fr"), ("x", "fr"), ("1 2", "fr"), (None, "fr"), ("ab ab", None),
        ("漢字かな交じり文の例文", "ja"), ("\U0001d400\U0001d401 漢 z", "ja"), ("a b " * 700, "en"),
    ]
    df = messages(*texts)
    found = language_profiles(df, size=10_000)
    want = {}
    for text, lang in texts:
        if text is None or lang is None:
            continue
        padded = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        for i in range(len(padded) - 2):
            key = lang, padded[i : i + 3]
            want[key] = want.get(key, 0) + 1
    assert {(r.lang, r.trigram): r.n for r in found.collect()} == want
    with redirect_stdout(shown := io.StringIO()):
        found.explain()
    assert "Generate" not in shown.getvalue()


def test_counts_over_cuts(monkeypatch):
    import pyarrow as pa

    from hushframe.operators import language as L

    texts = [" ab cd ", "  ", " abc ", " 漢 abcd ef "] * 5
    whole = {}
    for t in texts:
        for i in range(len(t) - 2):
            whole[t[i : i + 3]] = whole.get(t[i : i + 3], 0) + 1
    batch = pa.record_batch([pa.array(["en"] * len(texts)), pa.array(texts)], ["lang", "text"])
    for cut, cells in ((1, 1 << 22), (7, 0), (1 << 20, 1 << 22), (1 << 20, 0)):
        monkeypatch.setattr(L, "COUNTED_CHARS", cut)
        monkeypatch.setattr(L, "MOST_CELLS", cells)
        got = {}
        for part in L._counted(iter([batch])):
            for r in part.to_pylist():
                got[r["trigram"]] = got.get(r["trigram"], 0) + r["n"]
        assert got == whole


def test_length_without_white_space(messages, profiles):
    """Ten characters between the white space; what is shorter gets the default."""
    texts = ["\u3000\n la ville \u3000\n", "  la villes ", "la  \n\n\n\nvi", "l         ", "\n\nla\n\n\n\n\n\nvi\n"]
    rows = identify_language(messages(*((t, None) for t in texts)), profiles).collect()
    for r in rows:
        long_enough = len(texts[r.seq].strip()) >= 10
        assert r.detected_lang == (brute(texts[r.seq], SAMPLES) if long_enough else "en"), r


def test_nearest_profile_equals_counter():
    from collections import Counter

    ranks = {" la": [("fr", 1), ("es", 2)], "la ": [("fr", 3), ("es", 1)], "漢字": [("ja", 1)]}
    for text, size in ((" la la ", 300), ("  ", 300), ("", 300), (" xyz ", 300), (" la 漢字 b ", 2)):
        counts = Counter(text[i : i + 3] for i in range(len(text) - 2))
        scores = Counter()
        for rank, t in enumerate(sorted(counts, key=lambda t: (-counts[t], t))[:size], 1):
            for lang, other in ranks.get(t, ()):
                scores[lang] += size - abs(other - rank)
        assert nearest_profile(text, ranks, size) == min(scores, key=lambda k: (-scores[k], k), default=None)
