import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions.spans import SPANS, running
from hushframe.operators import overlap
from hushframe.operators.detectors import detect, explode_detections
from hushframe.operators.overlap import (
    overlap_pairs,
    resolve_exploded,
    resolve_overlaps,
    shadowed,
)

KEYS = ["scope_id", "seq"]


def brute(spans):
    ranked = sorted(spans, key=lambda s: (-s[3], -(s[2] - s[1]), s[6], s[1]))
    kept = []
    for s in ranked:
        if all(s[2] <= k[1] or s[1] >= k[2] for k in kept):
            kept.append(s)
    return kept


def random_messages(n, size):
    rng = random.Random(7)
    rows = []
    for seq in range(n):
        spans = set()
        for _ in range(rng.randrange(size)):
            start, length = rng.randrange(60), rng.randrange(1, 12)
            spans.add((start, start + length, rng.choice([0.65, 0.8, 0.9, 0.95]), rng.randrange(12)))
        rows.append(
            ("s", seq, [("T", a, b, sc, "x" * (b - a), "regex", o) for a, b, sc, o in sorted(spans)])
        )
    return rows


def test_both_paths_equal_brute_force(spark):
    rows = random_messages(60, 25)
    schema = f"scope_id string, seq bigint, detections {SPANS.simpleString()}"
    df = spark.createDataFrame(rows, schema)
    want = {(r[1], *s) for r in rows for s in brute(r[2])}
    narrow = explode_detections(resolve_overlaps(df), KEYS)
    wide = resolve_exploded(explode_detections(df, KEYS), KEYS)
    for got in (narrow, wide):
        assert {tuple(r)[1:] for r in got.collect()} == want
    # rank order is kept inside the array
    for r in resolve_overlaps(df).collect():
        assert [tuple(d) for d in r.detections] == brute(rows[r.seq][2])


def test_touching_spans_do_not_overlap(spark):
    spans = [("A", 0, 3, 0.9, "abc", "regex", 0), ("B", 3, 5, 0.9, "de", "regex", 1)]
    df = spark.createDataFrame(
        [("s", 0, spans)], f"scope_id string, seq bigint, detections {SPANS.simpleString()}"
    )
    assert len(resolve_overlaps(df).first().detections) == 2
    assert overlap_pairs(explode_detections(df, KEYS), KEYS).count() == 0


def test_equal_score_and_length_takes_detector_order(spark):
    spans = [("B", 0, 3, 0.9, "abc", "regex", 5), ("A", 1, 4, 0.9, "bcd", "regex", 2)]
    df = spark.createDataFrame(
        [("s", 0, spans)], f"scope_id string, seq bigint, detections {SPANS.simpleString()}"
    )
    assert [d.entity_type for d in resolve_overlaps(df).first().detections] == ["A"]


def test_email_inside_a_secret_wins_and_is_reported(messages):
    df = detect(messages("password: joe@x.com#1")).withColumn("raw", F.col("detections"))
    row = resolve_overlaps(df).withColumn("left", shadowed("raw", "detections")).first()
    assert [d.entity_type for d in row.detections] == ["EMAIL_ADDRESS"]
    assert [(m.span.entity_type, m.clear_chars) for m in row.left] == [("SECRET_KEY", 12)]


def test_long_chain_of_overlaps(spark):
    n = 3000
    spans = [("T", i * 2, i * 2 + 3, 0.9, "abc", "regex", 0) for i in range(n)]
    df = spark.createDataFrame(
        [("s", 0, spans)], f"scope_id string, seq bigint, detections {SPANS.simpleString()}"
    )
    assert len(resolve_overlaps(df).first().detections) == n // 2


@pytest.mark.parametrize("n", [0, 1, 256, 257, 1000, 70_000])
def test_running_folds(spark, n):
    values = [(i * 7919) % 101 for i in range(n)]
    row = spark.createDataFrame([(values,)], "v array<int>").select(
        running(F.col("v"), lambda a, b: a + b), running(F.col("v"), F.greatest)
    )
    assert [list(x) for x in row.first()] == [list(accumulate(values)), list(accumulate(values, max))]


def test_few_spans_are_resolved_as_many_are(spark, monkeypatch):
    """Below and above ``FEW_SPANS`` the same spans stay, in the same order."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        spans = []
        for _ in range(rng.randint(0, 8)):
            start, size = rng.randint(0, 20), rng.randint(1, 8)
            spans.append(("E", start, start + size, rng.choice([0.8, 0.95]), "v" * size, "regex", rng.randint(0, 11)))
        rows.append((i, spans))
    df = spark.createDataFrame([*rows, (-1, None)], T.StructType([T.StructField("i", T.LongType()), T.StructField("s", SPANS)]))

    def kept(few):
        monkeypatch.setattr(overlap, "FEW_SPANS", few)
        return {r.i: r.s for r in df.select("i", overlap.resolve(F.col("s")).alias("s")).collect()}

    assert kept(8) == kept(0) and kept(8)[-1] is None


def test_ordinary_messages_skip_the_islands(spark, monkeypatch):
    """A few spans are sorted and compared once, without looking for islands."""
    span = ("E", 0, 3, 0.9, "abc", "regex", 0)
    df = spark.createDataFrame([([span, ("E", 2, 4, 0.9, "cd", "regex", 0)],)], T.StructType([T.StructField("s", SPANS)]))
    # if the islands were looked for, this would fail
    monkeypatch.setattr(overlap, "_islands", lambda s: F.array(F.raise_error(F.lit("islands")).cast(SPANS)))
    assert [tuple(x) for x in df.select(overlap.resolve(F.col("s")).alias("s")).first().s] == [span]


def test_spans_that_lie_apart_are_only_sorted(spark, monkeypatch):
    """Spans that touch lie apart, an empty one inside another does not."""
    kind = T.StructType([T.StructField("detections", SPANS)])
    apart = [("E", 5, 8, 0.8, "abc", "regex", 0), ("E", 0, 5, 0.9, "abcde", "regex", 1), ("E", 9, 10, 0.9, "a", "regex", 2)]
    empty = [("E", 1, 5, 0.9, "abcd", "regex", 0), ("E", 3, 3, 0.8, "", "regex", 1)]
    rows = [(apart,), (empty,), (None,), ([],)]
    got = [r.detections for r in resolve_overlaps(spark.createDataFrame(rows, kind).coalesce(1)).collect()]
    assert [[tuple(s) for s in r] if r is not None else None for r in got] == [brute(apart), [empty[0]], None, []]
    # if spans that lie apart were compared, this would fail
    monkeypatch.setattr(overlap, "_greedy", lambda s: F.raise_error(F.lit("compared")).cast(SPANS))
    assert len(resolve_overlaps(spark.createDataFrame([(apart,)], kind)).first().detections) == 3
