"""Reversible tokens: numbering, vaults, scrub and restore.

A vault is a table ``(scope_id, entity_type, value, first_seq, first_start, idx,
token)``.  It holds raw values; it is written only where the caller asks for it.
Within a scope the same (type, exact value) has one token, and a type's values
are numbered from 1 in the order (seq, start) in which they first appear.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.patterns import TOKEN, java_pattern
from hushframe.functions.spans import FEW_EDITS, find_spans, let, running, splice
from hushframe.functions.text import format_token
from hushframe.operators.detectors import hits_only
from hushframe.operators.ordering import BLOCK_BITS, number_rows, prefix_sum
from hushframe.operators.overlap import by_start
from hushframe.operators.policy import DEFAULT_SETTINGS, Settings, entity_decision

TOKEN_PATTERN = java_pattern(TOKEN)
MAX_START = 2**31  # more than any offset in a string


def first_seen(spans: DataFrame) -> DataFrame:
    """Distinct values of a scope with the place of their first occurrence.

    Aggregated before the shuffle, so a value repeated a billion times in one
    scope costs one row per task.  The place is one decimal, as a minimum of
    structs could not be aggregated by hashing and would sort all spans first.
    """
    place = F.col("seq").cast("decimal(20,0)") * F.lit(MAX_START).cast("decimal(10,0)") + F.col("start")
    start = F.pmod(F.col("__first"), F.lit(MAX_START).cast("decimal(10,0)"))
    return (
        spans.groupBy("scope_id", "entity_type", "value")
        .agg(F.min(place).alias("__first"))
        .withColumn("first_start", start.cast("int"))
        .withColumn(
            "first_seq",
            ((F.col("__first") - F.col("first_start")) / F.lit(MAX_START).cast("decimal(10,0)")).cast("bigint"),
        )
        .select("scope_id", "entity_type", "value", "first_seq", "first_start")
    )


def number_values(values: DataFrame) -> DataFrame:
    """Number first-seen values per (scope, type) and format their tokens."""
    order = ["first_seq", "first_start", "value"]
    numbered = number_rows(values, ["scope_id", "entity_type"], order, "idx")
    return numbered.withColumn("token", format_token(F.col("entity_type"), F.col("idx")))


def token_vault(spans: DataFrame) -> DataFrame:
    """The vault of a table of spans ``(scope_id, seq, entity_type, start, value)``.

    ``scope_id`` decides how far a token reaches: a document, a session, an epoch
    of a session, or one constant for a whole corpus.  Spans without scope or number
    have no place in an order and get no token; scrubbing fails their messages.
    The spans are read once: numbering writes the distinct values, sorted, to the shared
    folder.
    """
    placed = spans.where(F.col("scope_id").isNotNull() & F.col("seq").isNotNull())
    return number_values(first_seen(placed))


def vault_append(vault: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows to append to a vault for spans that come later.

    Known values keep their tokens; new ones continue their counter.
    """
    key = ["scope_id", "entity_type", "value"]
    spans = spans.where(F.col("scope_id").isNotNull() & F.col("seq").isNotNull())
    fresh = first_seen(spans).join(vault.select(*key), key, "left_anti")
    last = vault.groupBy("scope_id", "entity_type").agg(F.max("idx").alias("__last"))
    return (
        number_values(fresh)
        .join(last, ["scope_id", "entity_type"], "left")
        .withColumn("idx", F.col("idx") + F.coalesce("__last", F.lit(0)))
        .withColumn("token", format_token(F.col("entity_type"), F.col("idx")))
        .drop("__last")
    )


def vault_size(vault: DataFrame) -> DataFrame:
    """Number of tokens per scope."""
    return vault.groupBy("scope_id").agg(F.count(F.lit(1)).alias("vault_size"))


def epochs(messages: DataFrame, clears: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """``(scope_id, seq, epoch)``: the clears in the scope before each message.

    Numbering starts again, and old tokens are unknown, after a clear; so a scope
    for tokens is (scope, epoch).  A clear takes effect for messages after its
    ``seq``.  Only keys are shuffled.
    """
    marked = (
        messages.select("scope_id", "seq", F.lit(0).alias("__clear"))
        .unionByName(
            clears.groupBy("scope_id", "seq")
            .count()
            .select("scope_id", "seq", F.col("count").cast("int").alias("__clear"))
        )
    )
    return (
        prefix_sum(marked, ["scope_id"], ["seq", "__clear"], F.col("__clear"), "epoch", bits)
        .where(F.col("__clear") == 0)
        .select("scope_id", "seq", "epoch")
    )


def epoch_scope(spans: DataFrame, message_epochs: DataFrame) -> DataFrame:
    """Put the epoch into the scope: ``scope#epoch``."""
    return (
        spans.join(message_epochs, ["scope_id", "seq"])
        .withColumn(
            "scope_id", F.concat("scope_id", F.lit("#"), F.col("epoch").cast("string"))
        )
        .drop("epoch")
    )


def _value_numbers(ordered: Column) -> Column:
    """The number of each span's value within its type, by first place, via sorting.

    Equal values are neighbours once sorted; the first of each run passes its place on,
    and the runs' first places, sorted by type, give the numbers.
    """

    def carried(marks: Column) -> Column:
        """Each element, or the last one before it that is not -1."""
        return running(marks, lambda a, b: F.when(b >= 0, b).otherwise(a), start=-1)

    def opens(items: Column, same) -> Column:
        """Where an element differs from the one before."""
        return F.transform(
            items, lambda x, i: F.when((i > 0) & same(x, F.get(items, i - 1)), -1).otherwise(i)
        )

    def by_value(items: Column) -> Column:
        """Of each span in order, the place of the first one with its value."""
        same = opens(items, lambda x, y: (x["t"] == y["t"]) & (x["v"] == y["v"]))
        first = F.transform(same, lambda at: F.when(at >= 0, F.get(items, at)["i"]).otherwise(-1))
        pairs = F.zip_with(
            items, carried(first), lambda x, f: F.struct(x["i"].alias("i"), f.alias("f"))
        )
        return F.transform(F.array_sort(pairs), lambda p: p["f"])

    def numbers(first: Column) -> Column:
        """Numbers by place, given each span's first place."""
        is_first = F.transform(first, lambda f, i: F.when(f == i, 1).otherwise(0))
        count = running(is_first, lambda a, b: a + b)
        firsts = F.filter(
            F.transform(
                ordered,
                lambda s, i: F.when(
                    F.get(first, i) == i, F.struct(s["entity_type"].alias("t"), i.alias("i"))
                ),
            ),
            lambda x: x.isNotNull(),
        )

        def ranked(by_type: Column) -> Column:
            begins = carried(opens(by_type, lambda x, y: x["t"] == y["t"]))
            pairs = F.zip_with(
                by_type, begins, lambda x, k: F.struct(x["i"].alias("i"), k.alias("k"))
            )
            placed = F.transform(
                pairs, lambda p, k: F.struct(p["i"].alias("i"), (k - p["k"] + 1).alias("n"))
            )
            return F.transform(F.array_sort(placed), lambda p: p["n"])

        return let(
            count,
            lambda c: let(
                let(F.array_sort(firsts), ranked),
                lambda n: F.transform(first, lambda f: F.get(n, F.get(c, f) - 1)),
            ),
        )

    items = F.transform(
        ordered,
        lambda s, i: F.struct(
            s["entity_type"].alias("t"), s["value"].alias("v"), i.alias("i")
        ),
    )
    return let(let(F.array_sort(items), by_value), numbers)


def document_edits(detections: Column) -> Column:
    """Edits that replace every span by its token, numbered within one message."""

    def named(s: Column) -> Column:
        return F.struct(s["entity_type"].alias("entity_type"), s["value"].alias("value"))

    def edit(s: Column, idx: Column) -> Column:
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            format_token(s["entity_type"], idx).alias("put"),
        )

    def searched(ordered: Column, known: Column) -> Column:
        def one(s: Column) -> Column:
            same_type = F.filter(known, lambda k: k["entity_type"] == s["entity_type"])
            return edit(s, F.array_position(same_type["value"], s["value"]))

        return F.transform(ordered, one)

    def numbered(ordered: Column) -> Column:
        few = let(
            F.array_distinct(F.transform(ordered, named)), lambda known: searched(ordered, known)
        )
        many = let(_value_numbers(ordered), lambda n: F.zip_with(ordered, n, edit))
        return F.when(F.size(ordered) <= FEW_EDITS, few).otherwise(many)

    return let(by_start(detections), numbered)


def scrubbed_spans(
    detections: Column, settings: Settings | None = None, skip_allowed: bool = False
) -> Column:
    """The spans to scrub: all, or with ``skip_allowed`` those that settings do not allow.

    An override changes a type's decision but does not take it out of scrubbing, unless
    this is asked for.
    """
    if not skip_allowed:
        return detections
    settings = settings or DEFAULT_SETTINGS
    return F.filter(
        detections, lambda d: entity_decision(d["entity_type"], settings) != "allow"
    )


def scrub_document(
    df: DataFrame, text: str = "text", detections: str = "detections", out: str = "scrubbed"
) -> DataFrame:
    """Scrub with one scope per message: inside the row, no shuffle.

    Also gives ``vault``, the tokens and values of the message.
    """
    edits = df.withColumn(
        "__edits",
        F.when(F.size(detections) > 0, document_edits(F.col(detections))).otherwise(
            F.array().cast("array<struct<start:int,end:int,put:string>>")
        ),
    )
    pairs = F.zip_with(
        "__edits",
        by_start(F.col(detections)),
        lambda e, d: F.struct(e["put"].alias("token"), d["value"].alias("value")),
    )

    def once(sorted_: Column) -> Column:
        """Distinct neighbours; comparing all with all would take their square."""
        keep = F.transform(
            sorted_,
            lambda p, i: F.when((i == 0) | (p["token"] != F.get(sorted_, i - 1)["token"]), p),
        )
        return F.filter(keep, lambda p: p.isNotNull())

    distinct = F.when(F.size("__edits") <= FEW_EDITS, F.array_distinct(pairs)).otherwise(
        let(F.array_sort(pairs), once)
    )
    return (
        edits.withColumn(out, splice(F.col(text), F.col("__edits")))
        .withColumn("vault", distinct)
        .drop("__edits")
    )


def restore_document(
    df: DataFrame, text: str = "scrubbed", vault: str = "vault", out: str = "restored"
) -> DataFrame:
    """Put values back from the vault array of the row; unknown tokens stay."""

    def put(s: Column) -> Column:
        known = F.filter(F.col(vault), lambda v: v["token"] == s["value"])
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.coalesce(F.get(known, F.lit(0))["value"], s["value"]).alias("put"),
        )

    return (
        df.withColumn("__tokens", find_spans(F.col(text), TOKEN_PATTERN))
        .withColumn("__edits", F.transform("__tokens", put))
        .withColumn(out, splice(F.col(text), F.col("__edits")))
        .drop("__tokens", "__edits")
    )


def _collected(edits: DataFrame, keys: Sequence[str], collect=F.collect_list) -> DataFrame:
    """The edits of each message as ``__edits``.

    They move as plain rows, once: lists made before the shuffle are no shorter, and each
    task would have to sort them.
    """
    rows = edits.select(*keys, "start", "end", "put").repartition(*keys)
    return rows.groupBy(*keys).agg(collect(F.struct("start", "end", "put")).alias("__edits"))


def _ranges(spans: str) -> Column:
    """Start and end of each span as one sorted array of numbers."""
    at = F.transform(spans, lambda s: F.shiftleft(s["start"].cast("bigint"), 32) + s["end"])
    return F.array_sort(at)


def complete_vault(vault: DataFrame, spans: DataFrame) -> DataFrame:
    """The vault with tokens for all values of ``spans``: known ones stay, new ones follow."""
    columns = ["scope_id", "entity_type", "value", "token"]
    return vault.select(*columns).unionByName(vault_append(vault, spans).select(*columns))


def scrub_session(
    df: DataFrame,
    vault: DataFrame | None = None,
    text: str = "text",
    detections: str = "detections",
    out: str = "scrubbed",
) -> DataFrame:
    """Scrub messages that have spans, with tokens shared across their scope.

    Returns the messages with at least one span; all others are sent as they are
    and need not be shuffled.  Tokens are looked up on keys only, one row per
    span; each text moves once, to meet the edits of its message.  A value found
    in very many messages is a skewed join key with one vault row: adaptive
    execution splits it.  Give a staged ``df`` where detection is costly, as the
    spans are read for the vault, for the lookup and with the text.

    Values that a given vault lacks get the tokens that ``vault_append`` gives them;
    append those to the vault to restore them later.  Scrubbing fails closed: a message
    whose edits are not exactly its spans has a NULL ``scrubbed``, never its text.  That
    is so for messages without scope or number, and for all that share both with
    another message with spans.
    """
    hits = hits_only(df, detections).withColumn("__wanted", _ranges(detections))
    spans = hits.select(
        "scope_id", "seq", F.explode(detections).alias("__d")
    ).select("scope_id", "seq", "__d.*")
    vault = token_vault(spans) if vault is None else complete_vault(vault, spans)
    edits = spans.where(F.col("seq").isNotNull()).join(
        vault.select("scope_id", "entity_type", "value", F.col("token").alias("put")),
        ["scope_id", "entity_type", "value"],
    )
    keys = ["scope_id", "seq"]
    exact = _ranges("__edits") == F.col("__wanted")
    return (
        hits.join(_collected(edits, keys), keys, "left")
        .withColumn(out, F.when(exact, splice(F.col(text), F.col("__edits"))))
        .drop("__edits", "__wanted")
    )


def _known_tokens(vault: DataFrame) -> DataFrame:
    """``scope_id, token, put``: the tokens of a vault that stand for one value only.

    Values move once: a least and a greatest one worked out before the shuffle would be two.
    """
    rows = vault.select("scope_id", "token", "value").repartition("scope_id", "token")
    known = rows.groupBy("scope_id", "token").agg(
        F.min("value").alias("put"), F.max("value").alias("__other")
    )
    return known.where(F.col("put") == F.col("__other")).drop("__other")


def _message_digest(text: str) -> Column:
    """128 bits of the SHA-256 of scope, number and text, NULL without a scope.

    The number and the length of the scope come first, so no two messages are written alike.
    """
    number = F.coalesce(F.col("seq").cast("string"), F.lit("-"))
    size = F.length("scope_id").cast("string")
    named = F.concat_ws("\u0000", number, size, F.col("scope_id"), F.col(text))
    digest = F.unhex(F.substring(F.sha2(named.cast("binary"), 256), 1, 32))
    return F.when(F.col("scope_id").isNotNull(), digest)


def restore_text(
    df: DataFrame, vault: DataFrame, text: str = "scrubbed", out: str = "restored"
) -> DataFrame:
    """Replace the tokens of each message by the values of its scope's vault.

    A token is taken whole, tokens that the scope does not know stay as they are, and
    so do those that the vault gives several values; restored text is not searched again.
    Messages may share their scope and number, or lack a number: edits belong to the digest
    of scope, number and text, so each message gets its own, and nothing else of a message
    moves with its tokens.  Without a scope nothing is known.  Only messages with a token are
    joined; give a staged ``df`` where it is costly, as those and the others are read apart.
    """
    has_token = F.coalesce(F.col(text).rlike(TOKEN_PATTERN), F.lit(False))
    marked = df.where(has_token).withColumn("__of", _message_digest(text))
    found = marked.where(F.col("__of").isNotNull()).select(
        "scope_id", "__of", F.explode(find_spans(F.col(text), TOKEN_PATTERN)).alias("__t")
    )
    found = found.select("scope_id", "__of", "__t.start", F.col("__t.value").alias("token"))
    edits = found.join(_known_tokens(vault), ["scope_id", "token"]).withColumn(
        "end", F.col("start") + F.length("token")
    )
    restored = F.when(F.col("__edits").isNull(), F.col(text)).otherwise(
        splice(F.col(text), F.col("__edits"))
    )
    done = marked.join(_collected(edits, ["__of"], F.collect_set), "__of", "left")
    done = done.withColumn(out, restored).drop("__edits", "__of")
    return done.unionByName(df.where(~has_token).withColumn(out, F.col(text)))


def literal_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """Tokens that stand in the source text: ``(scope_id, seq, start, token)``."""
    return (
        df.where(F.col(text).rlike(TOKEN_PATTERN))
        .select(
            "scope_id",
            "seq",
            F.explode(find_spans(F.col(text), TOKEN_PATTERN)).alias("__t"),
        )
        .select(
            "scope_id",
            "seq",
            F.col("__t.start").alias("start"),
            F.col("__t.value").alias("token"),
        )
    )


def literal_token_collisions(df: DataFrame, vault: DataFrame, text: str = "text") -> DataFrame:
    """Literal tokens that restore would take for tokens of the vault."""
    return literal_tokens(df, text).join(
        vault.select("scope_id", "token", F.col("value").alias("vault_value")),
        ["scope_id", "token"],
    )
