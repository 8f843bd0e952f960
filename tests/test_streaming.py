import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql.streaming import DataStreamWriter

from hushframe.operators import tokens as T
from hushframe.operators.detectors import explode_detections
from hushframe.operators.disposition import dispose
from hushframe.operators.policy import Settings
from hushframe.plans.analyze import analyze
from hushframe.streaming.jobs import (
    analyze_with_live_settings,
    drain,
    read_counter,
    run_available,
    scrub_counter,
)
from hushframe.streaming.sessions import session_events, session_processor, stream_session_tokens
from hushframe.streaming.tokens import (
    clear_events,
    read_vault,
    stream_to_vault,
    stream_tokens,
    token_events,
)

KEYS = ["scope_id", "seq"]
SCHEMA = "scope_id string, seq bigint, text string, lang string"


class Feed:
    """Messages arriving as files."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, str(folder)

    def add(self, rows, schema=SCHEMA):
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(self.folder)

    def stream(self, schema=SCHEMA):
        return self.spark.readStream.schema(schema).parquet(self.folder)


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path / "feed")


FIRST = [("a", 0, "a@b.com and c@d.com", "en"), ("a", 1, "10.0.0.1", "en"), ("b", 0, "c@d.com", "en")]
SECOND = [("a", 2, "e@f.com c@d.com", "en"), ("b", 1, "hello", "en"), ("b", 2, None, "en")]


def test_stream_equals_table(spark, feed):
    feed.add(FIRST)
    feed.add(SECOND)
    streamed = drain(analyze(feed.stream()))
    table = analyze(spark.createDataFrame(FIRST + SECOND, SCHEMA))
    assert sorted(map(str, streamed.collect())) == sorted(map(str, table.collect()))


def vault(df):
    return {(r.scope_id, r.entity_type, r.value): r.token for r in df.collect()}


def test_tokens_over_two_runs_equal_the_batch_vault(spark, feed, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for rows in (FIRST, SECOND):
        feed.add(rows)
        spans = explode_detections(analyze(feed.stream()), KEYS)
        run_available(stream_tokens(token_events(spans)), out, checkpoint)
    batch = analyze(spark.createDataFrame(FIRST + SECOND, SCHEMA))
    assert vault(spark.read.parquet(out)) == vault(T.token_vault(explode_detections(batch, KEYS)))


def test_vault_table_over_two_runs_equals_the_batch_vault(spark, feed, tmp_path):
    out, checkpoint = str(tmp_path / "vault"), str(tmp_path / "cp")
    for rows in (FIRST, SECOND):
        feed.add(rows)
        stream_to_vault(explode_detections(analyze(feed.stream()), KEYS), out, checkpoint)
    batch = analyze(spark.createDataFrame(FIRST + SECOND, SCHEMA))
    assert vault(read_vault(spark, out)) == vault(T.token_vault(explode_detections(batch, KEYS)))


def test_another_stream_adds_to_the_vault_and_destroys_nothing(spark, tmp_path):
    out = str(tmp_path / "vault")
    for name, text in (("one", "a@b.com"), ("two", "z@y.com a@b.com")):
        feed = Feed(spark, tmp_path / name)
        feed.add([("a", 1, text, "en")])
        spans = explode_detections(analyze(feed.stream()), KEYS)
        stream_to_vault(spans, out, str(tmp_path / f"cp-{name}"))
    assert vault(read_vault(spark, out)) == {
        ("a", "EMAIL_ADDRESS", "a@b.com"): "<EMAIL_ADDRESS_1>",
        ("a", "EMAIL_ADDRESS", "z@y.com"): "<EMAIL_ADDRESS_2>",
    }


def test_clear_restarts_numbering(spark, feed):
    rows = [("a", 0, "E", "span", 0, "x"), ("a", 1, "E", "span", 0, "y"), ("a", 2, "E", "span", 0, "y")]
    schema = "scope_id string, seq bigint, entity_type string, kind string, start int, value string"
    clears = clear_events(spark.createDataFrame([("a", 1)], "scope_id string, seq bigint"), ["E"])
    order = [part.split()[0] for part in schema.split(", ")]
    feed.add(rows, schema)
    clears.select(*order).coalesce(1).write.mode("append").parquet(feed.folder)
    # all in one micro-batch: the state sorts by seq, a clear behind the spans of its seq
    got = drain(stream_tokens(feed.stream(schema).select(*order)))
    assert sorted((r.epoch, r.value, r.token) for r in got.collect()) == [
        (0, "x", "<E_1>"), (0, "y", "<E_2>"), (1, "y", "<E_1>"),
    ]


def test_counter_is_exact_over_runs_and_reset(spark, feed, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for rows in (FIRST, SECOND):
        feed.add(rows)
        scrub_counter(dispose(analyze(feed.stream(), Settings("permissive")), None), out, checkpoint)
    counts = {r.scope_id: r.scrub_count for r in read_counter(spark, out).collect()}
    assert counts == {"a": 5, "b": 1}
    later = {r.scope_id: r.scrub_count for r in read_counter(spark, out, since_batch=1).collect()}
    assert later == {"a": 2, "b": 0}


def test_settings_change_between_batches(spark, feed, tmp_path):
    stored = {"mode": "strict"}
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for mode, rows in (("strict", FIRST), ("permissive", SECOND)):
        stored["mode"] = mode
        feed.add(rows)
        analyze_with_live_settings(feed.stream(), lambda: stored, out, checkpoint)
    got = {(r.scope_id, r.seq): r.decision for r in spark.read.parquet(out).collect()}
    assert got[("a", 0)] == "block" and got[("a", 2)] == "auto_scrub"


# -- tokens from a known vault, spread by value -------------------------------
EVENT = "scope_id string, seq bigint, entity_type string, kind string, start int, value string"


def events(*rows):
    return [(scope, seq, "E", "span", start, value) for scope, seq, start, value in rows]


def test_a_stream_goes_on_from_a_vault(spark, feed, tmp_path):
    """A restart from a batch vault keeps all tokens; a clear forgets it."""
    known = [("a", "E", f"v{i}", i + 1, f"<E_{i + 1}>") for i in range(40)]
    known = spark.createDataFrame(known, "scope_id string, entity_type string, value string, idx bigint, token string")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    clear = ("a", 20, "E", "~clear", None, None)
    batches = [
        events(("a", 1, 0, "v3"), ("a", 1, 9, "new"), ("a", 2, 0, "v39"), ("b", 1, 0, "v3")),
        events(("a", 10, 0, "later"), ("a", 11, 0, "new")),
        [*events(("a", 19, 0, "last"), ("a", 21, 0, "v3"), ("a", 22, 0, "new"), ("a", 22, 4, "v3")), clear],
        events(("a", 30, 0, "v3"), ("a", 30, 5, "other")),
    ]
    for rows in batches:
        feed.add(rows, EVENT)
        run_available(stream_tokens(feed.stream(EVENT), vault=known, parts=5), out, checkpoint)
    got = sorted((r.scope_id, r.epoch, r.idx, r.value, r.token) for r in spark.read.parquet(out).collect())
    assert got == [
        ("a", 0, 41, "new", "<E_41>"), ("a", 0, 42, "later", "<E_42>"), ("a", 0, 43, "last", "<E_43>"),
        ("a", 1, 1, "v3", "<E_1>"), ("a", 1, 2, "new", "<E_2>"), ("a", 1, 3, "other", "<E_3>"),
        ("b", 0, 1, "v3", "<E_1>"),
    ]


# -- sessions -----------------------------------------------------------------
SPAN = "scope_id string, ts timestamp, seq bigint, start int, entity_type string, value string"


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def test_sessions_end_by_event_time(spark, feed, tmp_path):
    """A gap ends a session, a late row has one of its own, the open one goes on."""
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    batches = [
        [("a", at(0), 1, 0, "E", "x"), ("a", at(5), 2, 0, "E", "y"), ("a", at(30), 3, 0, "E", "x"),
         ("b", at(0), 1, 0, "E", "x"), ("a", None, 9, 0, "E", "lost")],
        [("a", at(38), 4, 0, "E", "z"), ("a", at(39), 5, 0, "F", "x"), ("a", at(2), 6, 0, "E", "late")],
        [("a", at(45), 7, 0, "E", "z"), ("a", at(45), 7, 3, "E", "w"), ("a", at(80), 8, 0, "E", "z")],
    ]
    for rows in batches:
        feed.add(rows, SPAN)
        tokens = stream_session_tokens(session_events(feed.stream(SPAN), "ts"), 600, 3_600_000)
        run_available(tokens, out, checkpoint)
    got = sorted((r.scope_id, r.session_seq, r.value, r.token) for r in spark.read.parquet(out).collect())
    assert got == [
        ("a", 1, "x", "<E_1>"), ("a", 1, "y", "<E_2>"),
        ("a", 3, "w", "<E_3>"), ("a", 3, "x", "<E_1>"), ("a", 3, "x", "<F_1>"), ("a", 3, "z", "<E_2>"),
        ("a", 6, "late", "<E_1>"), ("a", 8, "z", "<E_1>"), ("b", 1, "x", "<E_1>"),
    ]


def test_idle_sessions_are_dropped(spark, feed, tmp_path):
    """After the idle time a timer drops the state; what comes then is a new session."""
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    batches = [[("a", at(0), 1, 0, "E", "x")], [("b", at(1), 1, 0, "E", "x")], [("a", at(1), 2, 0, "E", "y")]]
    for rows in batches:
        feed.add(rows, SPAN)
        tokens = stream_session_tokens(session_events(feed.stream(SPAN), "ts"), 600, 1)
        run_available(tokens, out, checkpoint)
    got = sorted((r.scope_id, r.session_seq, r.value, r.token) for r in spark.read.parquet(out).collect())
    assert got == [("a", 1, "x", "<E_1>"), ("a", 2, "y", "<E_1>"), ("b", 1, "x", "<E_1>")]


class FakeState(dict):
    """A map or value state in memory, that counts the calls."""

    calls = 0

    def __getattr__(self, name):
        def call(*args):
            FakeState.calls += 1
            key = args[0] if len(args) > 0 and name in ("containsKey", "getValue", "updateValue") else ""
            if name in ("update", "updateValue"):
                self[key] = args[-1]
            elif name == "containsKey":
                return key in self
            elif name in ("get", "getValue"):
                return dict.get(self, key)
            elif name == "clear":
                dict.clear(self)
            elif name == "exists":
                return bool(self)

        return call

    def get(self, *args):
        return self.__getattr__("get")(*args)

    def clear(self):
        self.__getattr__("clear")()

    def update(self, *args):
        self.__getattr__("update")(*args)


def test_closed_sessions_cost_no_state_calls():
    """Of one micro-batch only the session that stays open is written to the state."""
    states = [FakeState(), FakeState(), FakeState()]
    handle = SimpleNamespace(
        getValueState=lambda *_: states[0], getMapState=lambda name, *_: states[1 if name == "known" else 2],
        registerTimer=lambda _: None,
    )
    processor, times = session_processor(600, 1000), SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 5)
    processor.init(handle)
    row = Row("at", "seq", "start", "entity_type", "value")
    rows = [row(i // 4 * 1000, i, 0, "E", f"v{i % 4}") for i in range(4000)]
    FakeState.calls = 0
    got = list(processor.handleInputRows(("a",), iter(rows), times))
    assert len(got) == 4000 and {r.token for r in got} == {"<E_1>", "<E_2>", "<E_3>", "<E_4>"}
    assert FakeState.calls < 20 and len(states[1]) == 4
    more = [row(999_100, 4001, 0, "E", "v2"), row(999_100, 4000, 0, "E", "new"), row(5, 1, 0, "E", "late")]
    got = list(processor.handleInputRows(("a",), iter(more), times))
    assert [(r.session_start, r.value, r.token) for r in got] == [(5, "late", "<E_1>"), (999_000, "new", "<E_5>")]


def test_a_run_makes_no_empty_batches_whatever_session_is_active(spark, feed, tmp_path, monkeypatch):
    """The setting belongs to the stream's session; otherwise its timers ask for batches without end."""
    feed.add([("a", at(0), 1, 0, "E", "x")], SPAN)
    stream = stream_session_tokens(session_events(feed.stream(SPAN), "ts"), 600, 3_600_000)
    other = spark.newSession()
    monkeypatch.setattr("pyspark.sql.SparkSession.active", classmethod(lambda cls: other))
    seen, start = [], DataStreamWriter.start

    def started(self, *args, **kwargs):
        seen.append(spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled"))
        if seen != ["false"]:
            raise AssertionError("the run would not end")
        return start(self, *args, **kwargs)

    monkeypatch.setattr(DataStreamWriter, "start", started)
    run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1 and seen == ["false"]
