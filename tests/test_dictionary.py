import random
import time
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hushframe.operators.detectors import explode_detections
from hushframe.operators.dictionary import _ARROW_SPANS, _packed, dictionary_matches, occurrences
from hushframe.plans.analyze import analyze

KEYS = ["scope_id", "seq"]
ENTRIES = [
    ("Microsoft", "ORG"), ("Google", "ORG"), ("Bill Gates", "PERSON"),
    ("John Smith", "PERSON"), ("Alice", "PERSON"), ("Al", "PERSON"),
    ("London", "LOCATION"), ("Redmond", "LOCATION"), ("London", "ORG"),
    ("X", "PERSON"), ("Paris", "CITY"), ("O'Brien-Smith", "PERSON"),
]


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame(ENTRIES, "phrase string, entity_type string")


def found(df, dictionary, **options):
    rows = explode_detections(
        dictionary_matches(df, dictionary, **options), KEYS, "dictionary_spans"
    ).collect()
    return sorted((r.seq, r.entity_type, r.start, r.end, r.value, r.score, r.source) for r in rows)


TEXTS = [
    "Microsoft was founded by Bill Gates. Microsoft is headquartered in Redmond.",
    ("Microsoft, Bill Gates", "fr"),
    "  ",
    None,
    "Al is Also here",
    "Also here",
    "Bill  Gates and X in Paris, London",
    "O'Brien-Smith met Alice's Alice",
]


@pytest.mark.parametrize("sizes", [(5000, 0), (3, 10_000), (3, 0)])
def test_matches(messages, dictionary, sizes):
    got = found(messages(*TEXTS), dictionary, inline_phrases=sizes[0], automaton_chars=sizes[1])
    assert got == [
        (0, "LOCATION", 67, 74, "Redmond", 0.65, "nlp"),
        (0, "ORG", 0, 9, "Microsoft", 0.65, "nlp"),
        (0, "ORG", 37, 46, "Microsoft", 0.65, "nlp"),
        (0, "PERSON", 25, 35, "Bill Gates", 0.75, "nlp"),
        # every substring occurrence, also inside a word
        (4, "PERSON", 0, 2, "Al", 0.75, "nlp"),
        (4, "PERSON", 6, 8, "Al", 0.75, "nlp"),
        (6, "LOCATION", 28, 34, "London", 0.65, "nlp"),
        (6, "ORG", 28, 34, "London", 0.65, "nlp"),
        (7, "PERSON", 0, 13, "O'Brien-Smith", 0.75, "nlp"),
        (7, "PERSON", 18, 23, "Alice", 0.75, "nlp"),
        (7, "PERSON", 26, 31, "Alice", 0.75, "nlp"),
    ]


def test_alice_in_a_longer_word_counts_once_found(messages, dictionary):
    got = found(messages("Alice's friend Alice"), dictionary)
    assert [(s, v) for _, _, s, _, v, *_ in got] == [(0, "Alice"), (15, "Alice")]


def test_no_dictionary(messages, spark):
    empty = spark.createDataFrame([], "phrase string, entity_type string")
    for dictionary in (None, empty):
        assert found(messages("Alice"), dictionary) == []


def test_overlapping_occurrences(spark):
    df = spark.createDataFrame(
        [("banana ana", "ana"), ("aaaa", "aa"), ("x\\Ey.*", "\\Ey.*"), ("none", "z"), ("💥ab", "ab")],
        "t string, p string",
    )
    got = [r[0] for r in df.select(occurrences(F.col("t"), F.col("p"))).collect()]
    assert got == [[1, 3, 7], [0, 1, 2], [1], [], [1]]


def test_layers_meet_in_overlap_resolution(messages, dictionary):
    row = analyze(messages("mail Alice@x.com or London"), dictionary=dictionary).first()
    assert [(d.entity_type, d.value) for d in row.detections] == [
        ("EMAIL_ADDRESS", "Alice@x.com"), ("LOCATION", "London"),
    ]
    assert row.decision == "block"


def test_long_chains_of_words(messages, dictionary):
    text = "a-" * 50000 + "b London"
    assert [v for *_, v, _, _ in found(messages(text), dictionary)] == ["London", "London"]


@pytest.mark.parametrize("inline_phrases", [5000, 1])
def test_phrases_with_signs_between_words(messages, spark, inline_phrases):
    phrases = ("St. Louis", "J. Smith", "Johnson & Johnson", "New York", "...")
    entries = spark.createDataFrame([(p, "ORG") for p in phrases], "phrase string, entity_type string")
    text = "J. Smith of Johnson & Johnson left St. Louis for New York; St Louis, J Smith"
    got = found(messages(text), entries, inline_phrases=inline_phrases)
    assert sorted(v for *_, v, _, _ in got) == ["J. Smith", "Johnson & Johnson", "New York", "St. Louis"]


def test_both_ways_agree_on_missing_and_shared_keys(spark, dictionary):
    rows = [(None, 1, "Alice in London", "en"), ("s", 2, "Al", "en"), ("s", 2, "Also London", "en")]
    df = spark.createDataFrame(rows, "scope_id string, seq bigint, text string, lang string")

    def spans(inline_phrases):
        got = dictionary_matches(df, dictionary, inline_phrases=inline_phrases).collect()
        return sorted((r.text, sorted(s.value for s in r.dictionary_spans)) for r in got)

    assert spans(5000) == spans(1) == [
        ("Al", ["Al"]), ("Alice in London", ["Alice", "London", "London"]), ("Also London", ["London", "London"]),
    ]


def test_paths_agree_and_automata_move_no_text(spark, messages):
    """Inline, automata and join on random phrases; the automata's plan has no exchange."""
    rng = random.Random(5)
    names = ["Ann", "Anna", "Ann Lee", "Lee Ann", "Lee", "Le", "O'Neil", "St. Louis", "Né", "Zoë-Marie", "An"]
    entries = spark.createDataFrame(
        [(n, rng.choice(["PERSON", "ORG", "LOCATION"])) for n in names] + [("Ann", "ORG"), ("Ann", "PERSON")],
        "phrase string, entity_type string",
    )
    glue = [" ", " ", "  ", ", ", ".", "x", "💥 "]
    texts = ["".join(rng.choice(names) + rng.choice(glue) for _ in range(rng.randint(0, 30))) for _ in range(80)]
    df = messages(*texts, *texts[:5], None, "")
    got = [
        found(df, entries, inline_phrases=inline, automaton_chars=chars)
        for inline, chars in ((5000, 0), (0, 10_000), (0, 0))
    ]
    assert got[0] == got[1] == got[2] and len(got[0]) > 300
    scanned = dictionary_matches(df, entries, inline_phrases=0)
    assert "Exchange" not in scanned._jdf.queryExecution().executedPlan().toString()


def test_many_phrases_in_one_joined_text(spark, messages):
    """A search for each phrase by itself would take the number of phrases times the text."""
    names = [f"Name{i} Of{i % 7}" for i in range(12_000)]
    entries = spark.createDataFrame([(n, "ORG") for n in names], "phrase string, entity_type string")
    df = messages(", ".join(names), "no Name1 here", names[5])
    began = time.monotonic()
    got = found(df, entries, inline_phrases=0, automaton_chars=0)
    assert time.monotonic() - began < 20
    assert [v for q, *_, v, _, _ in got if q == 2] == [names[5]] and not [g for g in got if g[0] == 1]
    text = ", ".join(names)
    assert all(text[s:e] == v for q, _, s, e, v, *_ in got if q == 0)
    # also as the start of longer names: "Name1 Of1" in "Name1 Of1", "Name11 ..." has none
    assert {v for q, *_, v, _, _ in got if q == 0} == set(names)


def test_a_joined_dictionary_runs_the_detectors_once(spark, messages, monkeypatch):
    from hushframe.operators import dictionary as D

    entries = spark.createDataFrame([("Alice Lee", "PERSON"), ("London", "ORG")], "phrase string, entity_type string")
    joined = partial(D.dictionary_matches, inline_phrases=0, automaton_chars=0)
    monkeypatch.setattr("hushframe.plans.analyze.dictionary_matches", joined)
    done = analyze(messages("mail a@x.com, Alice Lee of London", "none"), dictionary=entries)
    assert [d.value for d in done.where("seq = 0").first().detections] == ["a@x.com", "Alice Lee", "London"]
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS __found_email") == 1


def test_only_likely_runs_are_joined():
    """The bitmap lets pass what the dictionary has, and hardly anything else."""
    from hushframe.operators.dictionary import _bit, _hashed_runs, _runs_in

    known = pa.array([[f"w{i}"] for i in range(500)] + [["a", f"w{i}", "b"] for i in range(500)])
    bitmap = np.zeros(1 << 12, np.uint8)
    for n, at, run in _hashed_runs(known, [1, 3]):
        size = known.value_lengths().to_numpy()
        first = np.repeat(np.arange(len(known)), size)[at]
        place = _bit(run[(size[first] == n)], 15)
        np.bitwise_or.at(bitmap, place >> 3, (1 << (place & 7)).astype(np.uint8))
    texts = [["a", "w1", "b", "a", "w1", "b"], None, [], ["x", "w2"], ["b", "a", "w3"], [f"z{i}" for i in range(900)]]
    got = _runs_in(pa.array([None, *texts], pa.list_(pa.string()))[1:], [1, 3], bitmap).to_pylist()
    assert set(got[0]) >= {"w1", "a w1 b"} and "w2" in got[3] and "w3" in got[4]
    assert len(got[0]) == len(set(got[0])) and got[1] == got[2] == [] and len(got[5]) < 100


def test_spans_are_put_together_by_column():
    texts = [[("Al", "PERSON", 0), ("Zo\U00010400", "ORG", 5)], [], [("Al", "LOCATION", 2)]]
    spans = _packed(texts)
    assert spans.type == _ARROW_SPANS
    assert [[tuple(s.values()) for s in row] for row in spans.to_pylist()] == [
        [("PERSON", 0, 2, 0.75, "Al", "nlp", 12), ("ORG", 5, 8, 0.65, "Zo\U00010400", "nlp", 14)],
        [],
        [("LOCATION", 2, 4, 0.65, "Al", "nlp", 13)],
    ]
    assert _packed([]).to_pylist() == [] and _packed([[], []]).to_pylist() == [[], []]
