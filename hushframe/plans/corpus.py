"""Messages for the registered queries, read or derived from the given tables.

Documents hold emails, phones, cards, addresses and secrets.  The entity types
that they lack are derived from keys and dates of other tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions.text import format_token
from hushframe.sources.tables import as_messages, spread


_NAME = "[A-Z][a-z]+"


def table(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    return spread(df, path, *keys) if keys else df


def _digits(value: Column, width: int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def _join(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id")
    return as_messages(docs, "source", "doc_id", "text", "lang")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations; their language is not known."""
    scope = _join("conv-", F.col("conv_id").cast("string"))
    return as_messages(table(spark, sf_dir, "conversations", "conv_id", "turn"), scope, "turn")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SSN, IPv6, Ethereum and Bitcoin addresses, and emails inside passwords."""
    key = F.col("c_custkey")
    sha = F.sha2(key.cast("string"), 256)
    text = _join(
        "SSN ", _digits(key % 1000, 3), "-", _digits(key % 100, 2), "-",
        _digits(key % 10000, 4), " on host 2001:db8:", F.substring(sha, 1, 4),
        ":1 up, to 0x", F.substring(sha, 1, 40), " or pay 1",
        F.translate(F.substring(sha, 1, 30), "0", "z"), " now, password: user",
        (key % 50).cast("string"), "@corp", (key % 7).cast("string"),
        ".example.com#", key.cast("string"), " end",
    )
    rows = table(spark, sf_dir, "customer", "c_custkey").select(
        _join("seg-", F.col("c_mktsegment")).alias("scope_id"),
        key.alias("seq"),
        text.alias("text"),
    )
    return as_messages(rows, "scope_id", "seq", "text", F.lit("en"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts, birth dates and US phone numbers."""
    key = F.col("o_orderkey")
    text = _join(
        "acct DE", _digits(key % 100, 2), _digits(key, 18), " paid. DOB: ",
        F.date_format("o_orderdate", "yyyy-MM-dd"), ", tel (555) ",
        _digits(F.col("o_custkey") % 1000, 3), "-",
        _digits(F.col("o_custkey") % 10000, 4), ".",
    )
    rows = table(spark, sf_dir, "orders", "o_orderkey").select(
        _join("prio-", F.substring("o_orderpriority", 1, 1)).alias("scope_id"),
        key.alias("seq"),
        text.alias("text"),
    )
    return as_messages(rows, "scope_id", "seq", "text", F.lit("en"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        documents(spark, sf_dir)
        .unionByName(customers(spark, sf_dir))
        .unionByName(orders(spark, sf_dir))
    )


def one_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as a single scope with one message number over all tables."""
    parts = (documents, customers, orders)
    numbered = [
        part(spark, sf_dir)
        .withColumn("seq", F.col("seq") * len(parts) + i)
        .withColumn("scope_id", F.lit("corpus"))
        for i, part in enumerate(parts)
    ]
    return numbered[0].unionByName(numbered[1]).unionByName(numbered[2])


def national_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One national phone number per order, in turn for each language."""
    key = F.col("o_orderkey")
    eight = _digits((key * 7919) % 100000000, 8)
    pair = [F.substring(eight, i, 2) for i in (1, 3, 5, 7)]
    three = F.substring(eight, 1, 3), F.substring(eight, 4, 3)
    four = F.substring(eight, 5, 4)
    forms = (
        ("fr", _join("06 ", pair[0], " ", pair[1], ".", pair[2], "-", pair[3])),
        ("de", _join("0176 ", eight)),
        ("gb", _join("07", three[0], " ", F.substring(eight, 3, 6))),
        ("es", _join("6", pair[0], " ", three[0], "-", three[1])),
        ("it", _join("3", pair[0], " ", three[0], " ", four)),
        ("pt", _join("9", pair[0], ".", three[0], ".", three[1])),
        ("nl", _join("06 ", eight)),
        ("pl", _join("5", pair[0], " ", three[0], " ", three[1])),
    )
    lang, number = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (code, form) in enumerate(forms):
        lang = F.when(key % len(forms) == i, F.lit(code)).otherwise(lang)
        number = F.when(key % len(forms) == i, form).otherwise(number)
    rows = table(spark, sf_dir, "orders", "o_orderkey").select(
        key, _join("tel ", number, " fin ", eight, "; ", number).alias("text"), lang.alias("lang")
    )
    return as_messages(rows, F.lit("orders"), "o_orderkey", "text", "lang")


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All capitalised words and two-word phrases of English documents, typed by length.

    Pairs of which the first word begins with the second are left out, as their
    occurrences could overlap, which the SQL does not follow.
    """
    word, pair = (F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (_NAME, f"{_NAME} {_NAME}"))
    parts = F.split("phrase", " ")
    overlaps = (F.size(parts) > 1) & F.get(parts, 0).startswith(F.get(parts, 1))
    kind = F.length("phrase") % 3
    return (
        table(spark, sf_dir, "documents", "doc_id")
        .where(F.col("lang") == "en")
        .select(F.explode(F.array_distinct(F.concat(word, pair))).alias("phrase"))
        .distinct()
        .where(~F.coalesce(overlaps, F.lit(False)))
        .select(
            "phrase",
            F.when(kind == 0, "PERSON").when(kind == 1, "LOCATION").otherwise("ORG").alias(
                "entity_type"
            ),
        )
    )


def clears(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clear events: errors in the event log, spread over the document scopes."""
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type") == "error")
        .select(
            _join("src", (F.col("user_id") % 20).cast("string")).alias("scope_id"),
            F.floor(F.col("event_id") / 10).cast("bigint").alias("seq"),
        )
    )


#: Seconds of silence that end a session of a user's events.
SESSION_GAP = 12 * 3600


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans with a time: the type of the event and its properties as value."""
    return table(spark, sf_dir, "events").select(
        _join("user", F.col("user_id").cast("string")).alias("scope_id"),
        "ts",
        F.col("event_id").alias("seq"),
        F.lit(0).alias("start"),
        F.upper("event_type").alias("entity_type"),
        F.col("props").alias("value"),
    )


def actions(messages: DataFrame) -> DataFrame:
    """User actions: scrub, edit, send or none, in turn."""
    turn = F.col("seq") % 4
    return messages.select(
        "scope_id",
        "seq",
        F.when(turn == 0, "scrub").when(turn == 1, "edit").when(turn == 2, "send").alias(
            "action"
        ),
    )


def quoted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that quote a token, as a reply to scrubbed text would."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer", "c_custkey").select(
        _join("seg-", F.col("c_mktsegment")).alias("scope_id"),
        key.alias("seq"),
        _join(
            "about ", format_token(F.lit("SSN"), key % 500), " and ",
            format_token(F.lit("PERSON"), key), " please",
        ).alias("text"),
    )
    return as_messages(rows, "scope_id", "seq", "text", F.lit("en"))


def visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of pages, and of customers who visit chat sites."""
    hosts = (
        "chatgpt.com", "www.chatgpt.com", "chat.openai.com", "claude.ai",
        "notclaude.ai", "gemini.google.com", "copilot.microsoft.com",
        "labs.perplexity.ai", "poe.com", "POE.com", "beta.character.ai",
        "chat.mistral.ai", "huggingface.co", "you.com", "thankyou.com",
        "poe.com.example.org",
    )
    key = F.col("c_custkey")
    host = F.get(F.array(*(F.lit(h) for h in hosts)), (key % len(hosts)).cast("int"))
    chats = table(spark, sf_dir, "customer").select(
        _join("c", key.cast("string")).alias("visit_id"),
        _join("https://", host, "/c/", key.cast("string"), "?q=1").alias("url"),
    )
    pages = table(spark, sf_dir, "pages").select(
        _join("p", F.col("page_id").cast("string")).alias("visit_id"), "url"
    )
    return pages.unionByName(chats)
