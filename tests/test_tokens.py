import random

import pytest
from pyspark.sql import functions as F

from hushframe.operators import audit, ordering
from hushframe.operators import tokens as T
from hushframe.operators.detectors import explode_detections
from hushframe.operators.policy import Settings
from hushframe.plans.analyze import analyze

KEYS = ["scope_id", "seq"]


def spans_of(df):
    return explode_detections(analyze(df), KEYS)


def vault_rows(vault):
    return {(r.scope_id, r.entity_type, r.value): r.token for r in vault.collect()}


def random_spans(n):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        scope = "hot" if rng.random() < 0.4 else f"s{rng.randrange(5)}"
        rows.append((scope, i * 37, rng.choice(["A", "B"]), rng.randrange(50), f"v{rng.randrange(n // 3)}"))
    return rows


def brute_vault(rows):
    counters, known = {}, {}
    for scope, _, kind, _, value in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        if (scope, kind, value) not in known:
            counters[scope, kind] = counters.get((scope, kind), 0) + 1
            known[scope, kind, value] = f"<{kind}_{counters[scope, kind]}>"
    return known


SPAN = "scope_id string, seq bigint, entity_type string, start int, value string"


@pytest.mark.parametrize("partitions", [1, 40])
def test_vault_equals_brute_force(spark, partitions):
    rows = random_spans(900)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame(rows, SPAN).repartition(7)
        assert vault_rows(T.token_vault(df)) == brute_vault(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_places_beyond_small_numbers(spark):
    rows = [("s", 2**62, "A", 2**31 - 1, "late"), ("s", 2**62, "A", 7, "mid"), ("s", -5, "A", 9, "early")]
    vault = T.token_vault(spark.createDataFrame(rows, SPAN))
    got = sorted((r.idx, r.value, r.first_seq, r.first_start) for r in vault.collect())
    assert got == [
        (1, "early", -5, 9), (2, "mid", 2**62, 7), (3, "late", 2**62, 2**31 - 1),
    ]
    plan = T.first_seen(spark.createDataFrame(rows, SPAN))._jdf.queryExecution().executedPlan()
    assert "SortAggregate" not in plan.toString()


def test_append_continues_counters(spark):
    rows = random_spans(600)
    first, later = rows[:300], rows[200:]
    vault = T.token_vault(spark.createDataFrame(first, SPAN))
    more = T.vault_append(vault, spark.createDataFrame(later, SPAN))
    both = {**vault_rows(vault), **vault_rows(more)}
    assert both == brute_vault(rows)
    assert not set(vault_rows(vault)) & set(vault_rows(more))


def test_scrub_and_restore_in_a_session(messages):
    df = analyze(
        messages(
            "my email is alice@example.com ok", "nothing here",
            "bob@x.org then alice@example.com", "a@b.com and c@d.com",
        )
    )
    done = {r.seq: r.scrubbed for r in T.scrub_session(df).collect()}
    assert done == {
        0: "my email is <EMAIL_ADDRESS_1> ok",
        2: "<EMAIL_ADDRESS_2> then <EMAIL_ADDRESS_1>",
        3: "<EMAIL_ADDRESS_3> and <EMAIL_ADDRESS_4>",
    }
    vault = T.token_vault(explode_detections(df, KEYS))
    back = T.restore_text(T.scrub_session(df), vault)
    assert back.where("restored <> text").count() == 0
    assert T.vault_size(vault).first().vault_size == 4


def test_restore_keeps_unknown_tokens_and_does_not_search_again(spark):
    vault = spark.createDataFrame(
        [("s", "EMAIL_ADDRESS", "x@y.com", 1, "<EMAIL_ADDRESS_1>"), ("s", "A", "<EMAIL_ADDRESS_1>", 1, "<A_1>")],
        "scope_id string, entity_type string, value string, idx bigint, token string",
    )
    texts = [
        "<EMAIL_ADDRESS_1> and <EMAIL_ADDRESS_1>", "keep <UNKNOWN_TOKEN_99> as-is",
        "<EMAIL_ADDRESS_01> <email_1>", "<A_1>", "",
    ]
    df = spark.createDataFrame(
        [("s", i, t) for i, t in enumerate(texts)], "scope_id string, seq bigint, scrubbed string"
    )
    got = [r.restored for r in T.restore_text(df, vault).orderBy("seq").collect()]
    assert got == [
        "x@y.com and x@y.com", "keep <UNKNOWN_TOKEN_99> as-is",
        "<EMAIL_ADDRESS_01> <email_1>", "<EMAIL_ADDRESS_1>", "",
    ]


def test_document_scope_round_trip_and_audits(messages):
    df = messages(
        "email: alice@example.com", "SSN is 123-45-6789 here", "card 4111 1111 1111 1111 thanks",
        "email alice@x.com, phone (555) 123-4567", "what is the capital of France?", "",
        "dup@e.com x dup@e.com y other@e.com", "💥 a@b.com é 10.0.0.1",
    )
    scrubbed = T.scrub_document(analyze(df))
    rows = {r.seq: r.scrubbed for r in scrubbed.collect()}
    assert rows[1] == "SSN is <SSN_1> here"
    assert rows[4] == "what is the capital of France?" and rows[5] == ""
    assert rows[6] == "<EMAIL_ADDRESS_1> x <EMAIL_ADDRESS_1> y <EMAIL_ADDRESS_2>"
    assert rows[7] == "💥 <EMAIL_ADDRESS_1> é <IP_ADDRESS_1>"
    for check in (audit.audit_round_trip, audit.audit_no_leak, audit.audit_span_integrity, audit.audit_preserve):
        assert check(scrubbed).first().violations == 0
    assert audit.audit_overlap(explode_detections(analyze(df), KEYS), KEYS).first().violations == 0


def test_audits_see_violations(messages):
    scrubbed = T.scrub_document(analyze(messages("mail a@b.com to a@b.com")))
    leaky = scrubbed.withColumn("scrubbed", F.lit("mail a@b.com"))
    assert audit.audit_no_leak(leaky).first().violations == 2
    assert audit.audit_round_trip(leaky).first().violations == 1
    assert audit.audit_preserve(leaky).first().violations == 1


def test_document_scope_equals_session_scope_per_message(messages):
    text = " ".join(f"u{i % 70}@example.com 10.0.0.{i % 90}" for i in range(300))
    df = analyze(messages(text))
    assert T.scrub_document(df).first().scrubbed == T.scrub_session(df).first().scrubbed


def test_epochs(spark):
    messages = spark.createDataFrame(
        [("a", i) for i in range(6)] + [("b", 3)], "scope_id string, seq bigint"
    )
    clears = spark.createDataFrame(
        [("a", 1), ("a", 1), ("a", 4), ("c", 0)], "scope_id string, seq bigint"
    )
    for bits in (0, 16):
        got = {(r.scope_id, r.seq): r.epoch for r in T.epochs(messages, clears, bits).collect()}
        assert got == {
            ("a", 0): 0, ("a", 1): 0, ("a", 2): 2, ("a", 3): 2, ("a", 4): 2, ("a", 5): 3, ("b", 3): 0,
        }


def test_numbering_starts_again_after_a_clear(spark, messages):
    df = messages("a@b.com", "c@d.com", "a@b.com")
    clears = spark.createDataFrame([("s", 1)], "scope_id string, seq bigint")
    spans = T.epoch_scope(spans_of(df), T.epochs(df, clears))
    assert vault_rows(T.token_vault(spans)) == {
        ("s#0", "EMAIL_ADDRESS", "a@b.com"): "<EMAIL_ADDRESS_1>",
        ("s#0", "EMAIL_ADDRESS", "c@d.com"): "<EMAIL_ADDRESS_2>",
        ("s#1", "EMAIL_ADDRESS", "a@b.com"): "<EMAIL_ADDRESS_1>",
    }


def test_literal_tokens_are_reported(messages):
    df = messages("a@b.com", "reply to <EMAIL_ADDRESS_1> or <EMAIL_ADDRESS_7>")
    got = T.literal_token_collisions(df, T.token_vault(spans_of(df))).collect()
    assert [(r.seq, r.start, r.token, r.vault_value) for r in got] == [
        (1, 9, "<EMAIL_ADDRESS_1>", "a@b.com")
    ]


def test_allowed_types_are_scrubbed_too(messages):
    from hushframe.operators.policy import Settings

    settings = Settings(overrides={"EMAIL_ADDRESS": "allow"})
    done = T.scrub_document(analyze(messages("a@b.com 10.0.0.1"), settings)).first()
    assert done.scrubbed == "<EMAIL_ADDRESS_1> <IP_ADDRESS_1>"


# -- scrubbing fails closed -------------------------------------------------
MESSAGE = "scope_id string, seq bigint, text string, lang string"


def test_missing_and_shared_keys_give_no_text(spark):
    rows = [
        (None, 1, "mail a@b.com", "en"), ("s", None, "mail c@d.com", "en"),
        ("s", 5, "mail e@f.com", "en"), ("s", 5, "10.0.0.1 is up", "en"), ("s", 6, "e@f.com g@h.com", "en"),
    ]
    got = T.scrub_session(analyze(spark.createDataFrame(rows, MESSAGE))).collect()
    by_text = {r.text: r.scrubbed for r in got}
    assert by_text.pop("e@f.com g@h.com") == "<EMAIL_ADDRESS_1> <EMAIL_ADDRESS_2>"
    assert set(by_text.values()) == {None} and len(by_text) == 4


def test_a_stale_vault_mints_what_it_lacks(spark, messages):
    vault = T.token_vault(spans_of(messages("old@x.com")))
    df = analyze(messages("mail old@x.com and new@x.com"))
    assert T.scrub_session(df, vault).first().scrubbed == "mail <EMAIL_ADDRESS_1> and <EMAIL_ADDRESS_2>"
    more = T.vault_append(vault, explode_detections(df, KEYS)).collect()
    assert [(r.value, r.token) for r in more] == [("new@x.com", "<EMAIL_ADDRESS_2>")]


def test_preserve_reads_by_position(spark, messages):
    df = T.scrub_document(analyze(messages("see <SSN_1> mail a@b.com", "10.0.0.1 x a@b.com", "none")))
    assert tuple(audit.audit_preserve(df).first()) == (3, 0)
    bad = df.withColumn("scrubbed", F.regexp_replace("scrubbed", " x ", " y "))
    assert tuple(audit.audit_preserve(bad).first()) == (3, 1)
    lost = df.withColumn("scrubbed", F.regexp_replace("scrubbed", "<EMAIL_ADDRESS_1>", ""))
    assert tuple(audit.audit_preserve(lost).first()) == (3, 2)


def test_allowed_types_are_left_out_on_request(messages):
    settings = Settings(overrides={"EMAIL_ADDRESS": "allow"})
    df = analyze(messages("a@b.com 10.0.0.1"), settings)
    for skip, want in ((False, "<EMAIL_ADDRESS_1> <IP_ADDRESS_1>"), (True, "a@b.com <IP_ADDRESS_1>")):
        spans = T.scrubbed_spans(F.col("detections"), settings, skip_allowed=skip)
        assert T.scrub_session(df.withColumn("detections", spans)).first().scrubbed == want


@pytest.mark.parametrize("bits", [0, 3, 16])
def test_running_sums_equal_a_plain_loop(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.choice(["hot", "hot", "a", None]), i * i - 50, rng.choice([0, 0, 1, 5])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, seq bigint, v int").repartition(5)
    got = {(r.k, r.seq): r.s for r in ordering.prefix_sum(df, ["k"], ["seq"], F.col("v"), "s", bits).collect()}
    sums, want = {}, {}
    for k, seq, v in sorted(rows, key=lambda r: r[1]):
        if k is not None:
            sums[k] = want[k, seq] = sums.get(k, 0) + v
    assert got == want
    assert ordering.prefix_sum(df.where("false"), ["k"], ["seq"], F.col("v"), "s").count() == 0


def test_parts_stay_even_whatever_the_numbers(spark):
    """One place far away from all others, one key for all rows: no part over three times the mean."""
    far = F.when(F.col("id") == 7, F.lit(2**60)).otherwise(F.col("id"))
    rows = spark.range(200_000).select(F.lit("s").alias("k"), far.alias("seq"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = ordering.sorted_parts(rows, "k", "seq")
        sizes = [r["count"] for r in parts.groupBy("__part").count().collect()]
        assert len(sizes) >= 7 and max(sizes) <= 3 * 200_000 / len(sizes)
        got = ordering.number_rows(rows, ["k"], ["seq"], "n").orderBy("seq")
        assert [r.n for r in got.collect()] == list(range(1, 200_001))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_restore_keeps_messages_apart(spark):
    replies = [
        ("s", 1, "mail <EMAIL_ADDRESS_1> now"), ("s", 1, "x <EMAIL_ADDRESS_2>"), ("s", 1, "x <EMAIL_ADDRESS_2>"),
        ("s", None, "<EMAIL_ADDRESS_1>, <EMAIL_ADDRESS_3>"), (None, 1, "<EMAIL_ADDRESS_1>"), ("s", 2, None),
        ("s", 2, "<EMAIL_ADDRESS_01> <EMAIL_ADDRESS_1>"), ("t", 1, "<EMAIL_ADDRESS_1>"), ("s", 3, "plain"),
    ]
    vault = [("s", "<EMAIL_ADDRESS_1>", "a@b.com"), ("s", "<EMAIL_ADDRESS_1>", "a@b.com"),
             ("s", "<EMAIL_ADDRESS_2>", "zz@y.com"), ("s", "<EMAIL_ADDRESS_3>", "one"),
             ("s", "<EMAIL_ADDRESS_3>", "two"), (None, "<EMAIL_ADDRESS_1>", "nobody")]
    df = spark.createDataFrame(replies, "scope_id string, seq bigint, scrubbed string")
    vault = spark.createDataFrame(vault, "scope_id string, token string, value string")
    got = sorted((str(r.scope_id), str(r.seq), str(r.restored)) for r in T.restore_text(df, vault).collect())
    assert got == sorted([
        ("s", "1", "mail a@b.com now"), ("s", "1", "x zz@y.com"), ("s", "1", "x zz@y.com"),
        ("s", "None", "a@b.com, <EMAIL_ADDRESS_3>"), ("None", "1", "<EMAIL_ADDRESS_1>"), ("s", "2", "None"),
        ("s", "2", "<EMAIL_ADDRESS_01> a@b.com"), ("t", "1", "<EMAIL_ADDRESS_1>"), ("s", "3", "plain"),
    ])

@pytest.mark.parametrize("n", [3, 100, 101, 3000])
def test_numbers_in_a_long_message(messages, n):
    rng = random.Random(n)
    made = [rng.choice([f"u{rng.randrange(n)}@b.com", f"10.0.{rng.randrange(9)}.{rng.randrange(99)}"]) for _ in range(n)]
    known, want = {}, []
    for value in made:
        kind = "EMAIL_ADDRESS" if "@" in value else "IP_ADDRESS"
        number = known.setdefault((kind, value), 1 + sum(k == kind for k, _ in known))
        want.append(f"<{kind}_{number}>")
    row = T.scrub_document(analyze(messages(" ".join(made)))).first()
    assert row.scrubbed == " ".join(want)


@pytest.mark.parametrize("chars", [10_000, 12])
def test_scope_leaks_are_found_in_other_messages(spark, messages, chars):
    df = analyze(messages("mail a@b.com", "ip 10.0.0.1 to c@d.com", "xa@b.comx", "a@b.com", None))
    vault = T.token_vault(explode_detections(df, KEYS))
    done = T.scrub_session(df).select(*KEYS, "scrubbed")
    assert audit.scope_leaks(done, vault, chars=chars).count() == 0
    other = [("s", 7, "then a@b.comc@d.com10.0.0.1"), ("t", 7, "a@b.com"), ("s", 8, None), (None, 9, "a@b.com")]
    sent = done.unionByName(spark.createDataFrame(other, done.schema))
    got = audit.scope_leaks(sent, vault, chars=chars).collect()
    assert sorted((r.scope_id, r.seq, r.token) for r in got) == [
        ("s", 7, "<EMAIL_ADDRESS_1>"), ("s", 7, "<EMAIL_ADDRESS_2>"), ("s", 7, "<IP_ADDRESS_1>"),
    ]


def test_round_trip_over_a_session(spark, messages):
    df = analyze(messages("mail a@b.com", "c@d.com and a@b.com", "no value"))
    vault = T.token_vault(explode_detections(df, KEYS))
    sent = T.scrub_session(df, vault)
    assert tuple(audit.audit_round_trip_session(sent, vault).first()) == (2, 0)
    wrong = vault.withColumn("value", F.concat("value", F.lit("!")))
    assert tuple(audit.audit_round_trip_session(sent, wrong).first()) == (2, 2)


def test_restore_moves_the_edits_once(spark, messages):
    """Tokens, vault, edits and texts are shuffled once each, and no text hash but a digest."""
    df = analyze(messages("mail a@b.com", "c@d.com and a@b.com"))
    vault = T.token_vault(explode_detections(df, KEYS)).select("scope_id", "token", "value")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = spark.createDataFrame([("s", 0, "<EMAIL_ADDRESS_1>")], "scope_id string, seq bigint, scrubbed string")
        local = spark.createDataFrame(vault.collect(), vault.schema)
        plan = T.restore_text(sent, local)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 4


def test_messages_are_told_apart_by_scope_number_and_text(spark):
    """Scopes and texts that hold the separator, and a missing scope, share no edits."""
    z = "\u0000"
    rows = [("a", 1, f"b{z}<X_1>"), (f"a{z}b", 1, "<X_1>"), (None, 1, f"1{z}a{z}<X_1>"), ("a", 1, "<X_1>"),
            (None, 1, "<X_1>"), ("a", None, "<X_1>"), ("", 1, "<X_1>")]
    df = spark.createDataFrame(rows, "scope_id string, seq bigint, scrubbed string")
    vault = spark.createDataFrame([("a", "<X_1>", "x"), ("", "<X_1>", "y")], "scope_id string, token string, value string")
    got = {(r.scope_id, r.seq, r.scrubbed): r.restored for r in T.restore_text(df, vault).collect()}
    want = {"a": "x", "": "y"}
    assert got == {r: r[2].replace("<X_1>", want.get(r[0], "<X_1>")) for r in rows}


def test_a_few_keys_are_numbered_without_a_shuffle_by_key(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = ordering.number_rows(rows, ["k"], ["id"], "n")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
