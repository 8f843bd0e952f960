"""Resampling, spelling variants and toxicity, against plain definitions and held-out labels."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.llm import resampling, spelling, toxicity
from hushframe.llm.oracle import oracle_sql
from hushframe.llm.queries import queries
from tests.check_oracle import compare, connect

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ("rank", "score", "n", "word", "_key", "_fit", "_at", "votes", "target", "_text", "known")


def docs(spark, rows, clash=False):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC)
    for name in CLASH if clash else ():
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.mark.parametrize("name", ["op11_resample", "op12_spelling"])
def test_query_equals_sql(spark, sf_dir, name):
    assert name in oracle_sql()
    problem, *_ = compare(spark, connect(sf_dir), sf_dir, name)
    assert problem is None, problem


# -- resampling -------------------------------------------------------------
def plain_features(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    runs = words + [" ".join(words[i : i + 2]) for i in range(len(words) - 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def plain_resample(rows, target):
    found = [(i, *plain_features(t)) for i, t in rows]
    s = collections.Counter(b for *_, f in found for b in f)
    t = collections.Counter(b for x in target for b in plain_features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, n, f in found:
        gain = sum(
            math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
            for b in f
        )
        weight = gain // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((n >= 20, i, len(f), weight, weight + noise))
    fit = sorted((x for x in out if x[0]), key=lambda x: (-x[4], x[1] is None, x[1] or 0, x[2]))
    ranks = {id(x): k + 1 for k, x in enumerate(fit[: 25 * len(fit) // 100])}
    return sorted(((*x[1:], ranks.get(id(x))) for x in out), key=str)


def test_resample_equals_plain(spark):
    rng = random.Random(4)
    words = "the The of in ünder Straße x1 éa a-b 12 it's".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(300)]
    rows += [(7, rows[7][1])] * 40 + [(None, rows[9][1]), (None, None), (400, ""), (401, "\0x" * 9)]
    rows += [(402, "Long " * 100_000 + "end")]
    target = ["of the ünder", None, "the it's it's", ""]
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, rank int")
    df = docs(spark, rows, clash=True).repartition(5)
    got = resampling.resample(df, aim, "doc_id", "text", "text").collect()
    assert sorted(map(tuple, got), key=str) == plain_resample(rows, target)


def test_resample_edges(spark):
    aim = spark.createDataFrame([("a b",)], "text string")
    none = docs(spark, [])
    assert resampling.resample(none, aim, "doc_id", "text", "text").count() == 0
    few = docs(spark, [(i, "w " * 20) for i in range(3)])
    got = resampling.resample(few, aim.where("false"), "doc_id", "text", "text").collect()
    assert [r["rank"] for r in got] == [None] * 3
    got = resampling.resample(few, aim, "doc_id", "text", "text", percent=100).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3]


@pytest.mark.parametrize("probes", [1, 3, 15])
def test_threshold_counts_ties(spark, probes):
    values = [5] * 70 + [-3, 0, 9, 9, 10**12, -(10**12), None]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    ordered = sorted(v for v in values if v is not None)
    for n in (1, 2, 3, 4, 40, 73, 74, 75, 76):
        assert resampling.threshold(df, F.col("v"), n, probes) == ordered[n - 1]


def test_drawn_takes_ties_by_key(spark):
    rows = [(i, 7) for i in range(50)] + [(None, 7), (None, 7), (99, 8), (98, 6)]
    df = spark.createDataFrame(rows, "k bigint, s bigint")
    for n, want in ((0, 0), (1, 1), (2, 2), (30, 30), (51, 51), (52, 53), (53, 53), (54, 54)):
        assert df.where(resampling.drawn(df, n, "s", "k")).count() == want


def test_features_over_blocks(monkeypatch):
    text = "a bb Ccc é 1 a bb " * 20
    for block in (1, 2, 3, 7, 1000):
        monkeypatch.setattr(resampling, "_WORDS", block)
        for longest in (1, 2, 3):
            blocks = list(resampling.features(text.encode(), longest))
            words = text.lower().split()
            runs = [
                zlib.crc32(" ".join(words[i : i + k + 1]).encode())
                for k in range(longest)
                for i in range(len(words) - k)
            ]
            assert sum(n for n, _ in blocks) == len(words)
            assert sorted(np.concatenate([c for _, c in blocks]).tolist()) == sorted(runs)


# -- spelling ---------------------------------------------------------------
def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, factor=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= factor * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        n_form = counts[form[w]] if form[w] else None
        out.append((w, form[w], root, counts[w], len(near[w]), n_form))
    return sorted(out)


@pytest.mark.parametrize("block", [3, 1 << 14])
def test_neighbours_equal_plain(spark, block):
    rng = random.Random(block)
    words = set()
    while len(words) < 700:
        n = rng.randint(6, 9)
        words.add("".join(rng.choices("ab", k=n)) if rng.random() < 0.7 else "a" * n + "éb"[rng.random() < 0.5])
    words |= {"b" * 500, "b" * 501, "b" * 250 + "a" + "b" * 250, "abc" * 2, "xyz" * 3}
    counts = {w: rng.choice((5, 6, 30, 31, 200, 2000)) for w in sorted(words)}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = {r["word"]: r for r in spelling.neighbours(df, block).collect()}
    for w, form, root, n, n_near, _ in plain_variants(counts):
        assert (got[w]["n_near"] if w in got else 0) == n_near, w
        if n_near:
            best = min((v for v in counts if one_edit(w, v)), key=lambda v: (-counts[v], v))
            assert (got[w]["near"], got[w]["near_n"]) == (best, counts[best])


def test_variants_equal_plain(spark):
    rng = random.Random(8)
    base = ["spelling", "variante", "Größen", "ÀÈÌÒÙß", "naïveté", "abcdef", "abcdeff"]
    rows = [(i, "; ".join(rng.choices(base, k=200))) for i in range(60)]
    rows += [(i, "speling varriante") for i in range(60, 90)] + [(1, None), (2, ""), (None, "spelling " * 9)]
    rows += [(500, "Zz" * 50_000 + " " + "spelling " * 50_000)] + [rows[0]] * 3
    counts = collections.Counter()
    for i, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 6
    counts = {w: n for w, n in counts.items() if n >= 5}
    df = docs(spark, rows, clash=True).repartition(4)
    got = spelling.variants(df, "doc_id", "text").collect()
    assert sorted(map(tuple, got)) == plain_variants(counts)
    assert any(r["form"] for r in got)
    assert spelling.variants(docs(spark, []), "doc_id", "text").count() == 0


def test_chains_end_at_the_root(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(23)] + [("x", "w5")]
    got = spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()
    assert {r["word"]: r["root"] for r in got} == {w: "w23" for w, _ in chain}


# -- toxicity ---------------------------------------------------------------
def toxic_rows(n, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    bad = ["idiotic", "scummy", "vilestuff", "vilething", "vilewords"]
    rows, labels = [], []
    for i in range(n):
        toxic = int(i % 5 == 0)
        words = rng.choices(plain, k=rng.randint(30, 120)) + rng.choices(bad, k=rng.randint(2, 6)) * toxic
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels


def test_toxicity_finds_held_out_labels(spark):
    rows, labels = toxic_rows(900)
    df, truth = docs(spark, rows, clash=True), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    held = toxicity.held_out("doc_id")
    model = toxicity.fit(df.where(~held), truth.where(~held), "doc_id", "text", "toxic")
    assert {"idiotic", "scummy"} <= set(model.lexicon.words) and "vile" in model.lexicon.stems
    got = toxicity.score(df.where(held), model, "doc_id", "text").collect()
    want = dict(labels)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in got) and len(got) > 200
    assert sum(r["predicted"] == want[r["doc_id"]] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_toxicity_query(spark, sf_dir):
    got = queries()["op13_toxicity"](spark, sf_dir)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    found = {r["doc_id"]: r for r in got.collect()}
    ids = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert set(found) == ids
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    clean = [found[r["doc_id"]]["predicted"] for r in labels if not r["toxic"] and r["doc_id"] in found]
    assert sum(clean) <= 0.03 * len(clean)


def test_toxicity_edges(spark):
    rows, labels = toxic_rows(60)
    odd = [(None, "x"), (1000, None), (1001, ""), (1002, "idiotic " * 200_000), rows[0]]
    df = docs(spark, rows + odd, clash=True)
    truth = spark.createDataFrame([*labels, (None, 1), (3, None), (1000, 1), (5, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit(df, truth, "doc_id", "text", "toxic")
    got = toxicity.score(df, model, "doc_id", "text")
    assert got.count() == len(rows) + 5 and got.where("score is null").count() == 0
    one = truth.where("toxic = 0")
    assert toxicity.fit(df, one, "doc_id", "text", "toxic") is None
    assert toxicity.fit(df.where("false"), truth, "doc_id", "text", "toxic") is None
    assert toxicity.score(df, None, "doc_id", "text").where("score = 0").count() == len(rows) + 5
    assert toxicity.score(df.where("false"), model, "doc_id", "text").count() == 0


def test_label_model_recovers_voters():
    """Accuracies of independent voters, and a smaller share for voters that repeat another."""
    rng = np.random.default_rng(3)
    n, rates = 20_000, (0.9, 0.8, 0.7)
    truth = rng.random(n) < 0.2
    votes = [np.where(truth, rng.random(n) < r, rng.random(n) < 0.05) * 2 for r in rates]
    votes += [votes[0], votes[0], np.where(truth, rng.random(n) < 0.75, rng.random(n) < 0.05) * 2]
    patterns, counts = np.unique(np.array(votes, int).T, axis=0, return_counts=True)
    model = toxicity.fit_label_model(patterns, counts.astype(float), np.full(len(counts), -1))
    assert abs(model.prior - 0.2) < 0.05
    for j, rate in enumerate(rates):
        assert abs(model.votes[1, j, 2] - rate) < 0.08
    assert model.shares[0] < 0.5 < model.shares[1] and model.correlations[0, 3] > 0.9
    assert model.correlations[1, 2] < 0.2
