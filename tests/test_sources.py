import pytest
from pyspark.sql import functions as F

from hushframe.operators.policy import Settings
from hushframe.operators.routing import attribute_sites
from hushframe.plans.analyze import analyze
from hushframe.plans.send import send
from hushframe.sources.pages import visible_text
from hushframe.sources.tables import (
    as_messages,
    read_messages,
    spread,
    stage,
    stored_bytes,
    write_outcomes,
)


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc", "csv"])
def test_read_messages(spark, tmp_path, fmt):
    rows = spark.createDataFrame([("a", 1, "x@y.com"), ("b", 2, "z")], "sid string, n int, body string")
    rows.write.format(fmt).option("header", "true").save(str(tmp_path / "in"))
    options = {"header": "true"} if fmt == "csv" else {}
    df = read_messages(spark, str(tmp_path / "in"), fmt, "sid", "n", "body", **options)
    assert df.dtypes == [
        ("scope_id", "string"), ("seq", "bigint"), ("text", "string"), ("lang", "string"), ("url", "string"),
    ]
    assert sorted(tuple(r) for r in df.collect()) == [
        ("a", 1, "x@y.com", None, None), ("b", 2, "z", None, None),
    ]


def test_text_lines_as_messages(spark, tmp_path):
    spark.createDataFrame([("mail a@b.com",), ("none",)], "value string").coalesce(1).write.text(str(tmp_path / "t"))
    lines = as_messages(spark.read.text(str(tmp_path / "t")), F.lit("t"), F.xxhash64("value"), "value")
    assert {r.decision for r in analyze(lines).collect()} == {"block", "allow"}


def test_spread_only_small_tables(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(100).coalesce(1).write.parquet(path)
    assert stored_bytes(spark, path) > 0
    small = spread(spark.read.parquet(path), path, "id")
    assert small.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = str(tmp_path / "many")
    spark.range(100).repartition(8).write.parquet(many)
    plan = spread(spark.read.parquet(many), many, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_stage_uses_the_shared_folder(spark):
    df = stage(spark.range(5).withColumn("p", F.col("id") % 2), "p")
    assert sorted(r.id for r in df.collect()) == [0, 1, 2, 3, 4]
    assert all(spark.conf.get("spark.checkpoint.dir") in f for f in df.inputFiles())


def test_held_rows_never_reach_the_sent_sink(spark, messages, tmp_path):
    df = send(analyze(messages("hello", "a@b.com", "  ")))
    write_outcomes(df, str(tmp_path / "sent"), str(tmp_path / "held"))
    assert [r.seq for r in spark.read.parquet(str(tmp_path / "sent")).orderBy("seq").collect()] == [0, 2]
    assert [r.seq for r in spark.read.parquet(str(tmp_path / "held")).collect()] == [1]


def test_sent_sink_holds_no_detected_value(spark, messages, tmp_path):
    texts = ("mail a@b.com", "10.0.0.1 and c@d.com", "hello", None, "x@y.com " + "z" * 99)
    df = send(analyze(messages(*texts), Settings("permissive"), max_chars=80))
    write_outcomes(df, str(tmp_path / "sent"), str(tmp_path / "held"))
    sent = spark.read.parquet(str(tmp_path / "sent"))
    assert set(sent.columns) == {"scope_id", "seq", "delivered", "outcome"}
    got = {r.seq: r.delivered for r in sent.collect()}
    assert got == {0: "mail <EMAIL_ADDRESS_1>", 1: "<IP_ADDRESS_1> and <EMAIL_ADDRESS_2>", 2: "hello"}
    assert spark.read.parquet(str(tmp_path / "held")).count() == 2


def test_failed_scrubbing_is_held(spark):
    rows = [(None, 1, "mail a@b.com", "en"), ("s", 2, "c@d.com", "en"), ("s", 2, "10.0.0.1", "en")]
    df = spark.createDataFrame(rows, "scope_id string, seq bigint, text string, lang string")
    got = send(analyze(df, Settings("permissive"))).collect()
    assert [(r.outcome, r.delivered) for r in got] == [("held", None)] * 3


def test_visible_text(spark):
    html = (
        "<html><head><title>no@x.com</title></head><body><script>var a='b@x.com'</script>"
        "<style>p{}</style><!-- c@x.com --><p>Mail <b>joe</b>@x.com</p><p>a &lt; b &amp;amp;</p>"
        "<!-- open d@x.com"
    )
    got = spark.range(1).select(visible_text(F.lit(html))).first()[0]
    assert got.split() == ["Mail", "joe@x.com", "a", "<", "b", "&amp;"]
    hostile = spark.range(1).select(
        F.length(visible_text(F.lit("<!--" * 100000))), F.length(visible_text(F.lit("<a " * 100000)))
    )
    assert tuple(hostile.first()) == (0, 300000)


def test_sites(spark):
    cases = [
        ("https://chatgpt.com/c/1", "chatgpt", "chatgpt.com", True),
        ("https://www.chatgpt.com/", "chatgpt", "chatgpt.com", False),
        ("http://CHAT.openai.com:8080/x?y#z", "chatgpt", None, True),
        ("https://notclaude.ai/", "generic", "claude.ai", False),
        ("https://labs.perplexity.ai", "perplexity", "perplexity.ai", False),
        ("https://poe.com.example.org/", "generic", "poe.com", False),
        ("https://you.com", "you", None, True),
        ("https://thankyou.com", "generic", None, False),
        ("not a url", "generic", None, False),
        (None, "generic", None, False),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, url string")
    got = attribute_sites(df).orderBy("i").collect()
    assert [(r.url, r.site, r.popup_site, r.covered) for r in got] == cases


def test_a_run_that_is_tried_again_sends_nothing_twice(spark, tmp_path):
    rows = [("s", 0, "a", "sent_raw", "a"), ("s", 1, "b", "held", None), ("s", 2, "c", "sent_scrubbed", None)]
    df = spark.createDataFrame(rows, "scope_id string, seq bigint, text string, outcome string, delivered string")
    sent, held = str(tmp_path / "sent"), str(tmp_path / "held")
    for run, part in (("1", df), ("1", df), ("2", df.where("seq = 0")), ("3", df.where("false"))):
        write_outcomes(part, sent, held, run=run)
    got = [(r.run, r.seq) for r in spark.read.parquet(sent).orderBy("run", "seq").collect()]
    assert got == [(1, 0), (2, 0)]
    assert [r.seq for r in spark.read.parquet(f"{held}/run=1").orderBy("seq").collect()] == [1, 2]


def test_broken_rows_leave_no_sent_file(spark, tmp_path):
    df = spark.range(4).select(
        F.lit("s").alias("scope_id"), F.col("id").alias("seq"), F.lit("sent_raw").alias("outcome"),
        F.when(F.col("id") < 3, F.lit("x")).otherwise(F.raise_error(F.lit("broken"))).alias("delivered"),
    )
    with pytest.raises(Exception, match="broken"):
        write_outcomes(df, str(tmp_path / "sent"), str(tmp_path / "held"), run="1")
    assert not (tmp_path / "sent").exists() and not (tmp_path / "held").exists()
