import os
import time

from pyspark.sql import functions as F

from hushframe.operators.policy import Settings
from hushframe.plans.analyze import analyze
from hushframe.plans.queries import queries
from hushframe.plans.send import send
from hushframe.sources.tables import scratch, sink_rows, stage, write_outcomes


def staged(spark):
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/staged"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_messages_are_analysed_once(messages):
    """What passes and what is scrubbed are read from the staged messages."""
    df = messages("mail a@b.com", "hello", None, "DOB: 1990-01-02")
    sent = send(analyze(df, Settings("permissive")))
    plan = sent._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
    got = {r.seq: (r.outcome, r.delivered) for r in sent.collect()}
    assert got == {
        0: ("sent_scrubbed", "mail <EMAIL_ADDRESS_1>"), 1: ("sent_raw", "hello"), 2: ("held", None),
        3: ("sent_raw", "DOB: 1990-01-02"),
    }


def test_sinks_are_filled_from_one_copy(spark, messages, tmp_path):
    """Of staged rows no other copy is made; a copy that is made goes."""
    done = stage(send(analyze(messages("mail a@b.com", "hello", None), Settings("permissive"))))
    before = staged(spark)
    for df in (done, done.where("true")):
        write_outcomes(df, str(tmp_path / "sent"), str(tmp_path / "held"), run="1")
        assert staged(spark) == before
        assert {r.seq: r.delivered for r in spark.read.parquet(str(tmp_path / "sent")).collect()} == {
            0: "mail <EMAIL_ADDRESS_1>", 1: "hello"
        }
        held = spark.read.parquet(str(tmp_path / "held")).collect()
        assert [(r.seq, r.failed, r.top_tier) for r in held] == [(2, True, "high")]


def test_rows_for_the_sinks_hold_texts_of_held_messages_only(messages):
    rows = sink_rows(send(analyze(messages("mail a@b.com", "10.0.0.1"), Settings(overrides={"IP_ADDRESS": "allow"}))))
    assert {r.seq: (r.text, r.delivered) for r in rows.collect()} == {0: ("mail a@b.com", None), 1: (None, "10.0.0.1")}


def test_shuffle_files_go_with_the_write(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {blocks.getAllFiles().apply(i).getName() for i in range(blocks.getAllFiles().size())}
    before = files()
    df = stage(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count())
    for _ in range(50):  # they are removed in the background
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and df.count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_scratch_keeps_only_what_it_is_told(spark):
    before = staged(spark)
    with scratch(spark) as keep:
        with scratch(spark) as inner:
            stage(spark.range(3))
            a, b = inner(spark.range(4)), keep(spark.range(5))
        assert len(staged(spark) - before) == 2 and a.count() == 4
    assert len(staged(spark) - before) == 1 and b.count() == 5


def test_send_write_leaves_one_staged_copy(spark, sf_dir):
    before = staged(spark)
    assert queries()["send_write"](spark, sf_dir).count() > 0
    assert len(staged(spark) - before) == 1
