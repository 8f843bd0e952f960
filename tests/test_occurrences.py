import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hushframe.operators import audit, occurrences


def counted(values):
    counts = {}
    for v in values:
        counts[len(v.encode())] = counts.get(len(v.encode()), 0) + 1
    return counts


@pytest.mark.parametrize("segment", [1, 7, 64, 1 << 18])
def test_every_value_that_stands_in_a_text_passes(monkeypatch, segment):
    monkeypatch.setattr(occurrences, "SEGMENT", segment)
    rng = random.Random(segment)
    more = 0
    for _ in range(60):
        letters, longest = rng.choice(["ab", "aé", "abc€x", "x😀y"]), rng.choice([2, 9, 70])
        word = lambda n: "".join(rng.choice(letters) for _ in range(n))  # noqa: B023, E731
        values = sorted({word(rng.randrange(1, longest)) for _ in range(rng.randrange(1, 30))})
        made = [rng.choice([None, "", word(rng.randrange(200))]) for _ in range(rng.randrange(12))]
        texts = [t if t is None else t + rng.choice(values) for t in made]
        plan = occurrences.layout(counted(values))
        places, bits = occurrences._bits_of(pa.array(values), plan), np.zeros(plan.size // 8, np.uint8)
        np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
        got = occurrences.possible_values(pa.array(["ab", *texts], pa.string()).slice(1), plan, bits)
        for text, parts in zip(texts, got.to_pylist(), strict=True):
            want = {v for v in values if v in (text or "")}
            assert want <= set(parts) and all(p in text for p in parts)
            more += len(set(parts) - want)
    assert more < 20


def test_texts_are_read_once_whatever_the_vault_holds(spark):
    """Before, each ``chars`` characters of the vault's values took a pass of their own."""
    values = [f"u{i}@b.com" for i in range(300)] + ["ü", "x" * 300, "", None]
    rows = [("s", "E", v, f"<E_{i}>") for i, v in enumerate(values)] + [("t", "E", "u7@b.com", "<E_1>")]
    vault = spark.createDataFrame(rows, "scope_id string, entity_type string, value string, token string")
    texts = [("s", 1, "mail u7@b.com, u17@b.com"), ("s", 2, "für " + "x" * 300), ("t", 3, "u7@b.com u8@b.com"),
             (None, 4, "u7@b.com"), ("s", None, "u9@b.com"), ("s", 5, None), ("s", 6, "u@b.com"), ("s", 7, "")]
    sent = spark.createDataFrame(texts, "scope_id string, seq bigint, scrubbed string")
    leaks = audit.scope_leaks(sent, vault, chars=50)
    assert leaks._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 2  # with the initial plan
    got = sorted(((r.scope_id, r.seq or 0, r.token) for r in leaks.collect()))
    want = sorted(
        (s, n or 0, r[3])
        for s, n, t in texts
        for r in rows
        if r[0] == s and r[2] and t and r[2] in t
    )
    assert got == want and len(want) == 6
    assert audit.scope_leaks(sent, vault.where("false"), chars=0).count() == 0
    everything = audit.scope_leaks(sent, vault, chars=10**6).collect()
    assert sorted(((r.scope_id, r.seq or 0, r.token) for r in everything)) == want


def test_values_of_many_tasks_make_one_bitmap(spark):
    values = spark.range(5000).select(F.concat(F.lit("v"), F.col("id") * 7919).alias("value")).repartition(9)
    plan = occurrences.layout(counted(f"v{i * 7919}" for i in range(5000)))
    bits = occurrences.bitmap(values, plan)
    texts = pa.array([f"..v{i * 7919}-" for i in range(5000)] + ["none", "v"])
    got = occurrences.possible_values(texts, plan, bits).to_pylist()
    assert all(f"v{i * 7919}" in got[i] for i in range(5000)) and got[5000:] == [[], []]
