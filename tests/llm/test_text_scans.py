"""Language, secrets, personal data and page text, against plain definitions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from hushframe.llm import html_text, language_id, pii, secret_scan
from hushframe.llm.queries import queries
from hushframe.llm.spans import Taken

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, *texts):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


# -- spans ------------------------------------------------------------------
def plain_secrets(text):
    kinds = (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )
    out = []
    for k, p, ok in kinds:
        flags = re.I | re.A if k == "assign" else 0
        out += [(k, *m.span()) for m in re.finditer(p, text, flags) if ok(m)]
    return sorted(out)


def luhn(digits):
    pairs = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(p // 10 + p % 10 for p in pairs) % 10 == 0


def plain_personal(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return sorted(
        (k, *m.span()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m)
    )


PARTS = (
    "password token: api_key=apikey = \"secret' : AKIA deadbeef0123456789abcdef0123 ABCDEFGHIJKLMNOP "
    "a@b.co x.y+z@a-b.example.com @ a@b @c.d .. 1.2.3.4 256.1.1.1 1.2.3.4.5 001.02.3.255 4111 1111-1111 "
    "4111111111111111 +1 (555) 123-4567 +49.30.1234 +1+2 é ſecret token=K 0 -- 12345678901234567890"
).split(" ")


@pytest.mark.parametrize("plain, found", [(plain_secrets, secret_scan), (plain_personal, pii)])
def test_base_spans_equal_the_patterns(plain, found):
    rng = random.Random(4)
    for _ in range(3000):
        text = rng.choice(["", " ", "-"]).join(rng.choices(PARTS, k=rng.randint(1, 12)))
        assert sorted(found.base_spans(text)) == plain(text), text


def test_base_spans_of_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1.1." * 80_000, "f" * 300_000):
        pii.base_spans(text), secret_scan.base_spans(text)


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")


def test_account_number_ends_before_following_words():
    text = "IBAN DE89 3704 0044 0532 0130 00 OK THEN"
    (span,) = pii.further_spans(text)
    assert text[span[1] : span[2]] == "DE89 3704 0044 0532 0130 00"


def test_personal_data_rows(spark):
    texts = ("my iban DE89 3704 0044 0532 0130 00", "ssn 123-45-6789", "code 123-45-6789", None, "",
             "x " * 200_000 + "a@b.co")
    df = docs(spark, *texts, "ssn 123-45-6789").withColumn("spans", F.lit(1))
    got = pii.find_personal_data(df, "doc_id", "text").orderBy("doc_id").collect()
    kinds = [[s["kind"] for s in r["spans"]] for r in got]
    assert kinds == [["iban"], ["ssn"], [], [], [], ["email"], ["ssn"]]
    assert got[5]["spans"][0]["start"] == 400_000


def test_context_raises_the_score():
    assert pii.score("call +1 555 123 4567", "phone", 5) > pii.score("xxxx +1 555 123 4567", "phone", 5)


def test_taken():
    taken = Taken([("a", 3, 6), ("b", 5, 9), ("c", 20, 21)])
    assert [taken.free(s, e) for s, e in ((0, 3), (2, 4), (8, 9), (9, 20), (20, 30), (21, 22))] == [
        True, False, False, True, False, True,
    ]


def test_secret_models_tell_random_from_ordinary(spark):
    rng = random.Random(1)
    words = "user account manager total price order item list value name index count".split()
    random_ = ["".join(rng.choices(secret_scan.ALPHABET[:62], k=32)) for _ in range(300)]
    plain = ["_".join(rng.choices(words, k=5)) for _ in range(300)]
    rows = [(v, True) for v in random_[:200]] + [(v, False) for v in plain[:200]]
    rows += [(None, True), ("abc", None), ("é", True)]
    model = secret_scan.fit(
        spark.createDataFrame(rows, "v string, random boolean"), "v", "random"
    )
    held = docs(spark, *random_[200:], *plain[200:], None, "")
    got = secret_scan.scan(held, model, "doc_id", "text").orderBy("doc_id").collect()
    found = [[s["kind"] for s in r["spans"]] for r in got]
    assert found[:100].count(["markov"]) >= 98
    assert found[100:] == [[]] * 102


def test_secret_scan_without_samples_or_rows(spark):
    empty = docs(spark).where("false")
    samples = secret_scan.labelled_strings(empty, "doc_id", "text")
    model = secret_scan.fit(samples, "value", "random")
    assert secret_scan.scan(empty, model, "doc_id", "text").count() == 0
    (row,) = secret_scan.scan(docs(spark, "token = abcdefgh"), model, "doc_id", "text").collect()
    assert [s["kind"] for s in row["spans"]] == ["assign"]


@pytest.mark.parametrize(
    "name, plain", [("op2_secrets", plain_secrets), ("op6_personal_data", plain_personal)]
)
def test_span_queries_report_the_base_spans(spark, sf_dir, name, plain):
    order = {"op2_secrets": ["assign", "access", "hex"],
             "op6_personal_data": ["email", "ip", "card", "phone"]}[name]
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = queries()[name](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        spans = sorted(plain(texts[r["doc_id"]] or ""), key=lambda s: (s[1], order.index(s[0])))
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in order] == [sum(s[0] == k for s in spans) for k in order]
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))


# -- language ---------------------------------------------------------------
def test_language_held_out_accuracy(spark, sf_dir):
    got = queries()["op1_language"](spark, sf_dir)
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    held = [r for r in rows if r["held_out"]]
    assert held and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.93


def test_language_edges(spark):
    rows = [(i, "the cat and the dog " * 9, "en", "s", 0) for i in range(9)]
    rows += [(i, "der hund und die katze " * 9, "de", "s", 0) for i in range(9, 18)]
    rows += [(None, "le chat et le chien", "fr", "s", 0), (50, None, "de", "s", 0), (51, "x y", None, "s", 0)]
    df = spark.createDataFrame(rows, DOC).withColumn("margin", F.lit("clash"))
    learned = language_id.language_dictionaries(df, "text", "lang", "doc_id")
    assert sorted(learned) == ["de", "en"]
    texts = ["the dog and the cat", "die katze und der hund", None, "", "123 !!", "the cat " * 100_000]
    got = language_id.identify(docs(spark, *texts, "the dog and the cat"), learned, "doc_id", "text")
    got = got.orderBy("doc_id").collect()
    assert [r["lang_best"] for r in got] == ["en", "de", "und", "und", "und", "en", "en"]
    assert got[0][1:] == got[6][1:]
    strict = language_id.identify(docs(spark, "the"), learned, "doc_id", "text", min_margin=1.0).first()
    assert strict["lang_pred"] is None and strict["lang_best"] in learned


def test_language_letters_and_labels(spark, monkeypatch):
    """Numbers of any script are no letters, marks are part of words, all labels count."""
    monkeypatch.setattr(language_id, "LANGUAGES", 3)
    rows = [(i, "the cat and the dog " * 9, "en", "s", 0) for i in range(9)]
    rows += [(i, "हिन्दी में कुछ शब्द " * 9, "hi", "s", 0) for i in range(9, 15)]
    rows += [(i, t, "xx", "s", 0) for i, t in enumerate(["½", None, "", "12", "éé"] * 60, 20)]
    rows += [(900, "q", "yy", "s", 0)]
    df = spark.createDataFrame(rows, DOC)
    learned = language_id.language_dictionaries(df, "text", "lang", "doc_id", docs=2)
    assert list(learned) == ["xx", "en", "hi"] and learned["xx"].decode().split() == ["éé"] * 2
    monkeypatch.setattr(language_id, "LANGUAGES", 500)
    learned = language_id.language_dictionaries(df, "text", "lang", "doc_id")
    assert len(learned["yy"]) >= 8 and set(learned["yy"]) == {ord("q")}
    texts = ["½ ² ① Ⅷ ٣", "\u0301", "कुछ हिन्दी शब्द"]
    got = language_id.identify(docs(spark, *texts), learned, "doc_id", "text").orderBy("doc_id").collect()
    assert [r["lang_best"] for r in got] == ["und", "und", "hi"]
    assert language_id.letters_only("हिन्दी, में").decode() == "हिन्दी में"
    assert language_id.language_dictionaries(df.where("false"), "text", "lang", "doc_id") == {}
    assert language_id.identify(docs(spark, "the"), {}, "doc_id", "text").first()["lang_best"] == "und"


# -- pages ------------------------------------------------------------------
ARTICLE = "<h1>Title &amp; more</h1><p>First   part,\n of it.<br>Second <b>bold</b>.<p>Next &lt;one&gt;."
TEXT = "Title & more\n\nFirst part, of it. Second bold.\n\nNext <one>."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<html><body><nav>Menu</nav></body></html>", ""),
        (f"<body><nav><a href=x>Menu</a></nav><article>{ARTICLE}</article><footer>c</footer>", TEXT),
        (f"<header>Site</header><main>{ARTICLE}</main><aside>More</aside>", TEXT),
        (f"<article>{ARTICLE}<div class='ad'>Buy</div><form>Name</form></article>", TEXT),
        (f"<article>{ARTICLE}<section id=comments><p>I think, so.</p></section></article>", TEXT),
        (f"<article><script>var x='<p>no</p>';</script><style>p{{}}</style>{ARTICLE}</article>", TEXT),
        (f"<article><!-- <p>no</p> -->{ARTICLE}<p hidden>no</p></article>", TEXT),
        (f"<div class=cookie-notice>We use cookies, yes.</div><article>{ARTICLE}</article>", TEXT),
        (f"<form id=page><article>{ARTICLE}</article></form>", TEXT),
        (f"<div id=menu><ul><li><a href=1>One</a></ul></div><div class=story>{ARTICLE}</div>", TEXT),
        ("<article><p>a < b</p></article", "a < b"),
        ("<p>plain text, only.", "plain text, only."),
        ("no markup at all", "no markup at all"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_hostile_pages_take_little_time():
    for part in ("<div>", "<a ", '<a "', "<!--", "</p>", "<b>x", "<script>", "&", "<", "<p>x</p></div>"):
        html_text.main_text(part * 60_000)
    html_text.main_text("<div>" * 30_000 + "text</p>" * 30_000)


def test_pages_keep_every_row_and_whole_texts(spark):
    long = "<article>" + "<p>some words, here.</p>" * 20_000 + "</article>"
    rows = [(1, "u", long), (1, "u", long), (None, None, None), (2, "v", "<article><p>x</article>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    df = df.withColumn("n_chars", F.lit(1)).withColumn("text", F.lit("t"))
    got = html_text.extract_text(df, "page_id", "html", carry=("url",)).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 1, *[20_000 * 17 + 2 * 19_999] * 2]
    assert html_text.extract_text(df.where("false"), "page_id", "html").count() == 0


def test_page_query_takes_the_article(spark, sf_dir):
    import html as h

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries()["op5_main_text"](spark, sf_dir).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        parts = re.split(r"</?(?:p|h1|article)[^>]*>", inner)
        lines = [" ".join(h.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in parts]
        assert r["text"] == "\n\n".join(filter(None, lines))
