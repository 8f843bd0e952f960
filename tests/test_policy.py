import pytest
from pyspark.sql import functions as F

from hushframe.functions.text import is_blank
from hushframe.operators import policy as P
from hushframe.operators.disposition import (
    dispose,
    entity_counts,
    entity_summary,
    offered_actions,
    outcome,
)
from hushframe.plans.analyze import analyze


def decide(spark, entities, settings=P.DEFAULT_SETTINGS):
    types = F.array(*(F.struct(F.lit(e).alias("entity_type")) for e in entities))
    column = types if entities else F.array().cast("array<struct<entity_type:string>>")
    row = spark.range(1).select(P.message_decision(column, settings), P.top_tier(column)).first()
    return tuple(row)


PERMISSIVE = P.Settings("permissive")


@pytest.mark.parametrize(
    ("entities", "settings", "want"),
    [
        ([], P.DEFAULT_SETTINGS, ("allow", None)),
        (["EMAIL_ADDRESS"], P.DEFAULT_SETTINGS, ("block", "high")),
        (["PERSON"], P.DEFAULT_SETTINGS, ("auto_scrub", "medium")),
        (["LOCATION"], P.DEFAULT_SETTINGS, ("auto_scrub", "medium")),
        (["DATE_OF_BIRTH"], P.DEFAULT_SETTINGS, ("warn", "low")),
        (["PERSON", "DATE_OF_BIRTH"], P.DEFAULT_SETTINGS, ("auto_scrub", "medium")),
        (["DATE_OF_BIRTH", "SSN"], P.DEFAULT_SETTINGS, ("block", "high")),
        (["UNKNOWN_THING"], P.DEFAULT_SETTINGS, ("auto_scrub", "medium")),
        (["EMAIL_ADDRESS"], PERMISSIVE, ("auto_scrub", "high")),
        (["PERSON"], PERMISSIVE, ("warn", "medium")),
        (["DATE_OF_BIRTH"], PERMISSIVE, ("notify", "low")),
        (["EMAIL_ADDRESS"], P.Settings(overrides={"EMAIL_ADDRESS": "warn"}), ("warn", "high")),
        (["EMAIL_ADDRESS"], P.Settings(overrides={"EMAIL_ADDRESS": "allow"}), ("allow", "high")),
        (["PHONE_NUMBER"], P.Settings(overrides={"EMAIL_ADDRESS": "allow"}), ("block", "high")),
        (
            ["EMAIL_ADDRESS", "PERSON"],
            P.Settings(overrides={"EMAIL_ADDRESS": "warn"}),
            ("auto_scrub", "high"),
        ),
        (["SSN"], P.Settings(overrides={"SSN": "nonsense"}), ("block", "high")),
        (["NEW_KIND"], P.Settings(overrides={"NEW_KIND": "notify"}), ("notify", "medium")),
    ],
)
def test_decisions(spark, entities, settings, want):
    assert decide(spark, entities, settings) == want


def test_settings_are_values():
    base = P.load_settings({"overrides": {"SSN": "warn"}})
    assert base == P.Settings("strict", {"SSN": "warn"})
    assert P.apply_settings(base, mode="permissive").overrides == {"SSN": "warn"}
    # overrides are replaced as a whole, not merged
    assert P.apply_settings(base, overrides={"ORG": "allow"}).overrides == {"ORG": "allow"}
    more = P.set_override(base, "ORG", "allow")
    assert more.overrides == {"SSN": "warn", "ORG": "allow"}
    assert P.set_override(more, "SSN", "").overrides == {"ORG": "allow"}
    assert base.overrides == {"SSN": "warn"}
    assert P.load_settings(None) == P.DEFAULT_SETTINGS
    assert P.apply_settings(base, **vars(P.DEFAULT_SETTINGS)) == P.DEFAULT_SETTINGS


def test_policy_table_has_no_values(spark):
    table = P.policy_table(spark, P.Settings("permissive", {"SSN": "allow"}))
    assert "value" not in table.columns and table.count() == 12
    row = table.where("entity_type = 'SSN'").first()
    assert (row.default_action, row.override_action, row.effective_action) == (
        "auto_scrub", "allow", "allow",
    )


def test_analyze(messages):
    df = messages(
        "What is the capital of France?", "", "my email is alice@example.com",
        "email alice@x.com born DOB: 01/15/1985", None,
    )
    rows = analyze(df).orderBy("seq").collect()
    assert [(r.top_tier, r.decision, r.failed) for r in rows] == [
        (None, "allow", False), (None, "allow", False), ("high", "block", False),
        ("high", "block", False), ("high", "block", True),
    ]
    open_to_email = P.Settings(overrides={"EMAIL_ADDRESS": "allow"})
    third = analyze(df, open_to_email).where("seq = 2").first()
    assert (third.top_tier, third.decision) == ("high", "allow")


def test_fail_closed_in_both_modes(messages):
    for mode in P.MODES:
        rows = analyze(messages(None, "x" * 20, "ok"), P.Settings(mode), max_chars=10).collect()
        assert [(r.failed, r.decision, len(r.detections)) for r in rows] == [
            (True, "block", 0), (True, "block", 0), (False, "allow", 0),
        ]


@pytest.mark.parametrize(
    ("decision", "action", "text", "want"),
    [
        ("allow", None, "t", "sent_raw"), ("notify", None, "t", "sent_raw"),
        ("auto_scrub", None, "t", "sent_scrubbed"), ("warn", "scrub", "t", "sent_scrubbed"),
        ("warn", "send", "t", "sent_raw"), ("warn", "edit", "t", "held"),
        ("warn", None, "t", "held"), ("block", "scrub", "t", "sent_scrubbed"),
        ("block", "send", "t", "held"), ("block", None, "t", "held"),
        ("block", None, "  ", "sent_raw"), ("block", None, None, "held"),
    ],
)
def test_outcome(spark, decision, action, text, want):
    got = spark.range(1).select(
        outcome(
            F.lit(decision),
            F.lit(action).cast("string"),
            is_blank(F.lit(text).cast("string")),
        )
    )
    assert got.first()[0] == want


def test_failed_messages_are_held_whatever_the_action(spark, messages):
    analysed = analyze(messages("mail a@b.com " + "x" * 90, "a@b.com", None), max_chars=50)
    actions = spark.createDataFrame(
        [("s", i, "scrub") for i in range(3)], "scope_id string, seq bigint, action string"
    )
    got = {r.seq: r.outcome for r in dispose(analysed, actions).collect()}
    assert got == {0: "held", 1: "sent_scrubbed", 2: "held"}


def test_several_actions_neither_multiply_nor_release(spark, messages):
    actions = spark.createDataFrame(
        [("s", 0, "edit"), ("s", 0, "scrub"), ("s", 1, "scrub"), ("s", 1, "scrub")],
        "scope_id string, seq bigint, action string",
    )
    got = dispose(analyze(messages("a@b.com", "c@d.com")), actions).orderBy("seq").collect()
    assert [(r.seq, r.outcome) for r in got] == [(0, "held"), (1, "sent_scrubbed")]


def test_summaries(spark, messages):
    row = analyze(messages("a@b.com c@d.com DOB: 1990-01-01 and 10.0.0.1")).withColumn(
        "entities", entity_summary(F.col("detections"))
    )
    assert row.first().entities == "IP_ADDRESS, EMAIL_ADDRESS, DATE_OF_BIRTH"
    spans = row.select("scope_id", "seq", F.explode("detections").alias("d")).select(
        "scope_id", "seq", "d.entity_type"
    )
    labels = {r.label: r.notice for r in entity_counts(spans, ["scope_id", "seq"]).collect()}
    assert labels == {
        "EMAIL_ADDRESS ×2": "2 items scrubbed",
        "IP_ADDRESS": "1 item scrubbed",
        "DATE_OF_BIRTH": "1 item scrubbed",
    }
    offers = spark.range(1).select(
        offered_actions(F.lit("block"), F.lit("high")),
        offered_actions(F.lit("warn"), F.lit("low")),
        offered_actions(F.lit("notify"), F.lit("low")),
    )
    assert tuple(offers.first()) == ("scrub,edit", "scrub,edit,send", "")


def test_sql_functions_equal_column_functions(spark):
    from hushframe.functions import text
    from hushframe.operators import routing
    from hushframe.plans import sql

    settings = P.Settings("permissive", {"PERSON": "block", "IT'S": "allow"})
    sql.register(spark, settings)
    rows = [(v,) for v in ("EMAIL_ADDRESS", "PERSON", "IT'S", "NEW", "DATE_OF_BIRTH", None)]
    rows += [(v,) for v in ("4111 1111 1111 1111", "4111-1111-1111-1112", "", "none", "poe.com", "x.poe.com", "notpoe.com")]
    df = spark.createDataFrame(rows, "v string")
    v = F.col("v")
    pairs = {
        "tier_of(v)": P.entity_tier(v), "decision_of(v)": P.entity_decision(v, settings),
        "luhn_valid(v)": text.luhn_valid(v), "site_of(v)": routing.site_of(v),
        "host_of(concat('https://', v, '/a'))": routing.url_host(F.concat(F.lit("https://"), v, F.lit("/a"))),
        "token_of(v, 3)": text.format_token(v, F.lit(3)),
    }
    for name, column in pairs.items():
        for row in df.select("v", F.expr(name).alias("a"), column.alias("b")).where("v is not null").collect():
            assert row.a == row.b, (name, row)
