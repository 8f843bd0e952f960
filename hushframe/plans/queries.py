"""The registered queries: every operator on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions.spans import find_spans
from hushframe.functions.text import luhn_valid
from hushframe.operators import audit, disposition, overlap, policy, routing, tokens
from hushframe.operators.detectors import (
    DETECTORS,
    detect,
    explode_detections,
    hits_only,
)
from hushframe.operators.dictionary import dictionary_matches
from hushframe.operators.language import (
    identify_language,
    language_profiles,
    normalise_lang,
)
from hushframe.plans import corpus as C
from hushframe.plans.analyze import analyze
from hushframe.plans.send import send
from hushframe.plans.sql import register
from hushframe.sources.pages import visible_text
from hushframe.sources.session import shared_dir
from hushframe.sources.tables import as_messages, scratch, sink_rows, stage, write_outcomes
from hushframe.streaming.jobs import drain

Query = Callable[[SparkSession, str], DataFrame]

KEYS = ["scope_id", "seq"]
SPAN = ["entity_type", "start", "end", "score", "value", "source", "det_ord"]
OVERRIDES = policy.Settings(
    mode="permissive",
    overrides={"EMAIL_ADDRESS": "allow", "IBAN_CODE": "warn", "SSN": "notify"},
)

_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# -- shared steps -----------------------------------------------------------
def _analysed(spark, sf_dir, **options) -> DataFrame:
    return analyze(C.corpus(spark, sf_dir), **options)


def _kept(spark, sf_dir) -> DataFrame:
    return explode_detections(_analysed(spark, sf_dir), KEYS)


def _raw(spark, sf_dir) -> DataFrame:
    return explode_detections(detect(C.corpus(spark, sf_dir)), KEYS)


def _hits(spark, sf_dir) -> DataFrame:
    """Messages with spans, written once: several steps below read them."""
    return stage(hits_only(_analysed(spark, sf_dir)))


# -- sources ----------------------------------------------------------------
@query
def messages(spark, sf_dir):
    docs = C.documents(spark, sf_dir)
    talk = as_messages(
        C.table(spark, sf_dir, "conversations"),
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")),
        "turn",
    )
    return docs.unionByName(talk).select(*KEYS, "lang", "text")


@query
def page_exposure(spark, sf_dir):
    pages = C.table(spark, sf_dir, "pages", "page_id")
    seen = as_messages(
        pages.withColumn("visible", visible_text(F.col("html"))),
        F.coalesce(routing.url_host(F.col("url")), F.lit("")),
        "page_id", "visible", F.lit("en"),
    )
    spans = explode_detections(overlap.resolve_overlaps(detect(seen)), KEYS)
    return spans.groupBy(F.col("scope_id").alias("host"), "entity_type").agg(
        F.count(F.lit(1)).alias("n_spans"), F.count_distinct("seq").alias("n_pages")
    )


# -- detectors --------------------------------------------------------------
def _detector_query(name: str) -> Query:
    def run(spark, sf_dir):
        found = detect(C.corpus(spark, sf_dir), [name], lang=None)
        return explode_detections(found, KEYS)

    return run


for _name in DETECTORS:
    _QUERIES[f"detect_{_name}"] = _detector_query(_name)


@query
def detect_phone_locale(spark, sf_dir):
    texts = C.documents(spark, sf_dir).unionByName(C.national_phones(spark, sf_dir))
    return explode_detections(detect(texts, ["phone_locale"]), [*KEYS, "lang"])


@query
def detect_all(spark, sf_dir):
    return _raw(spark, sf_dir)


@query
def luhn_check(spark, sf_dir):
    number = F.lpad((F.col("o_orderkey") * 7919 + F.col("o_custkey")).cast("string"), 16, "4")
    return C.table(spark, sf_dir, "orders").select(
        "o_orderkey", number.alias("number"), luhn_valid(number).alias("valid")
    )


_QUERIES["luhn_valid"] = _QUERIES.pop("luhn_check")


# -- dictionary -------------------------------------------------------------
def _named(spark, sf_dir) -> DataFrame:
    found = dictionary_matches(
        C.documents(spark, sf_dir), C.dictionary(spark, sf_dir)
    )
    return explode_detections(found, KEYS, "dictionary_spans")


@query
def dictionary_occurrences(spark, sf_dir):
    return _named(spark, sf_dir)


@query
def dictionary_joined(spark, sf_dir):
    """The same by the join that dictionaries too large for a worker take."""
    docs, entries = C.documents(spark, sf_dir), C.dictionary(spark, sf_dir)
    found = dictionary_matches(docs, entries, inline_phrases=0, automaton_chars=0)
    return explode_detections(found, KEYS, "dictionary_spans")


def _entity_query(entity: str) -> Query:
    return lambda spark, sf_dir: _named(spark, sf_dir).where(F.col("entity_type") == entity)


for _name, _entity in (("person", "PERSON"), ("location", "LOCATION"), ("org", "ORG")):
    _QUERIES[f"detect_{_name}"] = _entity_query(_entity)


# -- language ---------------------------------------------------------------
@query
def language_profiles_query(spark, sf_dir):
    return language_profiles(C.documents(spark, sf_dir)).select("lang", "trigram", "n", "rank")


_QUERIES["language_profiles"] = _QUERIES.pop("language_profiles_query")


@query
def identify_language_query(spark, sf_dir):
    docs = C.documents(spark, sf_dir)
    profiles = language_profiles(docs)
    return identify_language(docs, profiles).select(*KEYS, "detected_lang")


_QUERIES["identify_language"] = _QUERIES.pop("identify_language_query")


@query
def normalise_lang_query(spark, sf_dir):
    code = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("(?<![a-z])[a-z]{3}(?![a-z])"), F.lit(0)))
    codes = C.table(spark, sf_dir, "documents", "doc_id").select(code.alias("code"))
    return (
        codes.groupBy("code")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("code", "n", normalise_lang(F.col("code")).alias("lang"))
    )


_QUERIES["normalise_lang"] = _QUERIES.pop("normalise_lang_query")


# -- spans ------------------------------------------------------------------
@query
def find_spans_query(spark, sf_dir):
    return (
        C.documents(spark, sf_dir)
        .select(*KEYS, F.explode(find_spans(F.col("text"), "[A-Za-z]*[0-9]+")).alias("s"))
        .select(*KEYS, "s.*")
    )


_QUERIES["find_spans"] = _QUERIES.pop("find_spans_query")


@query
def resolve_overlaps(spark, sf_dir):
    return _kept(spark, sf_dir)


@query
def resolve_overlaps_exploded(spark, sf_dir):
    return overlap.resolve_exploded(_raw(spark, sf_dir), KEYS)


@query
def overlap_pairs(spark, sf_dir):
    return overlap.overlap_pairs(_raw(spark, sf_dir), KEYS)


@query
def shadowed_spans(spark, sf_dir):
    both = _analysed(spark, sf_dir, keep_raw=True)
    return both.select(
        *KEYS, F.explode(overlap.shadowed("raw", "detections")).alias("m")
    ).select(
        *KEYS,
        F.col("m.span.entity_type").alias("entity_type"),
        F.col("m.span.start").alias("start"),
        F.col("m.span.end").alias("end"),
        F.col("m.clear_chars").alias("clear_chars"),
    )


# -- policy -----------------------------------------------------------------
@query
def policy_table(spark, sf_dir):
    counts = _kept(spark, sf_dir).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n_spans"))
    return (
        policy.policy_table(spark, OVERRIDES)
        .join(counts, "entity_type", "left")
        .select(
            "entity_type", "label", "tier", "default_action", "override_action",
            "effective_action", F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        )
    )


@query
def entity_tier(spark, sf_dir):
    # Event types stand in for entity types outside the catalogue.
    kinds = (
        _kept(spark, sf_dir)
        .select("entity_type")
        .unionAll(
            C.table(spark, sf_dir, "events").select(F.upper("event_type").alias("entity_type"))
        )
    )
    return (
        kinds.groupBy("entity_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("tier", policy.entity_tier(F.col("entity_type")))
    )


@query
def top_tier(spark, sf_dir):
    return _analysed(spark, sf_dir).select(*KEYS, "top_tier")


@query
def decision_matrix(spark, sf_dir):
    kind = F.col("entity_type")
    return (
        _kept(spark, sf_dir)
        .groupBy("entity_type")
        .agg(F.count(F.lit(1)).alias("n_spans"))
        .select(
            "entity_type",
            policy.entity_tier(kind).alias("tier"),
            policy.entity_decision(kind, policy.Settings("strict")).alias("strict"),
            policy.entity_decision(kind, policy.Settings("permissive")).alias("permissive"),
            "n_spans",
        )
    )


def _decisions(settings: policy.Settings) -> Query:
    return lambda spark, sf_dir: _analysed(spark, sf_dir, settings=settings).select(
        *KEYS, "decision"
    )


_QUERIES["message_decision_strict"] = _decisions(policy.Settings("strict"))
_QUERIES["message_decision_permissive"] = _decisions(policy.Settings("permissive"))
_QUERIES["message_decision_override"] = _decisions(OVERRIDES)


# -- tokens -----------------------------------------------------------------
VAULT = ["scope_id", "entity_type", "value", "first_seq", "first_start", "idx", "token"]


@query
def token_vault_session(spark, sf_dir):
    return tokens.token_vault(_kept(spark, sf_dir)).select(*VAULT)


@query
def token_vault_corpus(spark, sf_dir):
    found = explode_detections(analyze(C.one_scope(spark, sf_dir)), KEYS)
    return tokens.token_vault(found).select(*VAULT)


@query
def vault_append(spark, sf_dir):
    spans = stage(
        explode_detections(analyze(C.one_scope(spark, sf_dir)), KEYS).select(
            *KEYS, "entity_type", "start", "value"
        )
    )
    # Documents and customers came before; then all three tables are seen.
    vault = stage(tokens.token_vault(spans.where(F.col("seq") % 3 != 2)))
    return tokens.vault_append(vault, spans).select(*VAULT)


@query
def vault_size(spark, sf_dir):
    return tokens.vault_size(tokens.token_vault(_kept(spark, sf_dir)))


@query
def token_vault_epochs(spark, sf_dir):
    numbers = tokens.epochs(C.corpus(spark, sf_dir), C.clears(spark, sf_dir))
    spans = tokens.epoch_scope(_kept(spark, sf_dir), numbers)
    return tokens.token_vault(spans).select(*VAULT)


@query
def scrub_document(spark, sf_dir):
    return tokens.scrub_document(_analysed(spark, sf_dir)).select(*KEYS, "scrubbed")


@query
def scrub_session(spark, sf_dir):
    return tokens.scrub_session(_hits(spark, sf_dir)).select(*KEYS, "scrubbed")


@query
def restore_text(spark, sf_dir):
    reply = F.concat("scrubbed", F.lit(" see <PHONE_NUMBER_1> or <PERSON_99>"))
    with scratch(spark) as keep:
        hits = _hits(spark, sf_dir)
        with scratch(spark):  # what the numbering writes
            vault = keep(tokens.token_vault(explode_detections(hits, KEYS)))
        replies = keep(tokens.scrub_session(hits, vault).select(*KEYS, reply.alias("scrubbed")))
    return tokens.restore_text(replies, vault).select(*KEYS, "restored")


@query
def restore_text_hard(spark, sf_dir):
    """Messages that share or lack keys; a vault with doubled and contradicting rows."""
    hits, n = _hits(spark, sf_dir), F.col("seq")
    vault = stage(tokens.token_vault(explode_detections(hits, KEYS)))
    replies = tokens.scrub_session(hits, vault).select(
        F.when(n % 11 != 0, F.col("scope_id")).alias("scope_id"),
        F.when(n % 13 != 0, F.floor(n / 3)).cast("bigint").alias("seq"),
        n.alias("row"),
        F.concat("scrubbed", F.lit(" see <PHONE_NUMBER_1>")).alias("scrubbed"),
    )
    other = vault.where(F.col("idx") % 5 == 0).withColumn("value", F.lit("other"))
    doubled = vault.unionByName(vault).unionByName(other)
    return tokens.restore_text(stage(replies), doubled).select(*KEYS, "row", "restored")


@query
def literal_token_collisions(spark, sf_dir):
    vault = tokens.token_vault(_kept(spark, sf_dir))
    texts = C.documents(spark, sf_dir).unionByName(C.quoted_tokens(spark, sf_dir))
    return tokens.literal_token_collisions(texts, vault).select(
        *KEYS, "start", "token", "vault_value"
    )


# -- pipeline ---------------------------------------------------------------
@query
def analyze_query(spark, sf_dir):
    return _analysed(spark, sf_dir).select(
        *KEYS, "failed", F.size("detections").alias("n_detections"), "top_tier", "decision"
    )


_QUERIES["analyze"] = _QUERIES.pop("analyze_query")


@query
def analyze_with_dictionary(spark, sf_dir):
    result = _analysed(spark, sf_dir, dictionary=C.dictionary(spark, sf_dir))
    return explode_detections(result, KEYS)


def _disposed(spark, sf_dir) -> DataFrame:
    # Permissive with overrides, so that all five decisions occur.
    analysed = _analysed(spark, sf_dir, settings=OVERRIDES)
    return disposition.dispose(analysed, C.actions(C.corpus(spark, sf_dir)))


@query
def disposition_query(spark, sf_dir):
    return _disposed(spark, sf_dir).select(*KEYS, "decision", "action", "outcome")


_QUERIES["disposition"] = _QUERIES.pop("disposition_query")


@query
def send_pipeline(spark, sf_dir):
    analysed = _analysed(spark, sf_dir, settings=OVERRIDES)
    sent = send(analysed, C.actions(C.corpus(spark, sf_dir)))
    return sent.select(*KEYS, "outcome", "delivered")


@query
def send_write(spark, sf_dir):
    """What both sinks hold after a run that was tried twice."""
    import uuid

    base = f"{shared_dir(spark)}/sinks/{uuid.uuid4().hex}"
    with scratch(spark) as keep:
        analysed = _analysed(spark, sf_dir, settings=OVERRIDES)
        sent = keep(sink_rows(send(analysed, C.actions(C.corpus(spark, sf_dir)))))
    for _ in range(2):
        write_outcomes(sent, f"{base}/sent", f"{base}/held", run="first")
    columns = [*KEYS, "outcome", "delivered"]
    onward = spark.read.parquet(f"{base}/sent/run=first").select(*columns)
    held = spark.read.parquet(f"{base}/held/run=first").withColumn("delivered", F.lit(None).cast("string"))
    return onward.unionByName(held.select(*columns))


@query
def scrub_session_hard(spark, sf_dir):
    """Keys that are missing or shared, and a vault that knows half of the values."""
    n = F.col("seq")
    hits = _hits(spark, sf_dir).select(
        F.when(n % 11 != 0, F.col("scope_id")).alias("scope_id"),
        F.when(n % 13 == 0, None).when(n % 17 == 0, n + 1).otherwise(n).alias("seq"),
        n.alias("row"),
        "text",
        "detections",
    )
    hits = stage(hits)
    old = explode_detections(hits, KEYS).where(F.col("seq") % 2 == 0)
    vault = stage(tokens.token_vault(old))
    return tokens.scrub_session(hits, vault).select(*KEYS, "row", "scrubbed")


@query
def fail_closed(spark, sf_dir):
    # German texts are taken as unreadable, texts over 5,000 characters as too long.
    readable = F.when(F.col("lang") != "de", F.col("text"))
    docs = C.documents(spark, sf_dir).withColumn("text", readable)
    return analyze(docs, policy.Settings("permissive"), max_chars=5000).select(
        *KEYS, "failed", F.size("detections").alias("n_detections"), "top_tier", "decision"
    )


@query
def analyze_with_language(spark, sf_dir):
    """All languages identified: those of documents are taken away, turns have none."""
    docs = C.documents(spark, sf_dir)
    profiles = language_profiles(docs)
    turns = C.conversations(spark, sf_dir)
    texts = docs.withColumn("lang", F.lit(None).cast("string")).unionByName(turns)
    return analyze(texts, profiles=profiles).select(
        *KEYS, "lang", F.size("detections").alias("n_detections"), "top_tier", "decision"
    )


@query
def fragment_scan(spark, sf_dir):
    lines = C.documents(spark, sf_dir).select(
        *KEYS, "lang", F.posexplode(F.split("text", "\n")).alias("part", "text")
    )
    result = analyze(
        lines, dictionary=C.dictionary(spark, sf_dir), keys=[*KEYS, "part"]
    )
    offered = disposition.offered_actions(F.col("decision"), F.col("top_tier"))
    return result.select(
        *KEYS, "part", "top_tier", "decision",
        disposition.entity_summary(F.col("detections")).alias("entities"),
        offered.alias("offered"),
    )


@query
def entity_summary(spark, sf_dir):
    return _analysed(spark, sf_dir).select(
        *KEYS, disposition.entity_summary(F.col("detections")).alias("entities")
    )


@query
def entity_counts(spark, sf_dir):
    return disposition.entity_counts(_kept(spark, sf_dir), KEYS)


@query
def scrub_count(spark, sf_dir):
    return disposition.scrub_count(_disposed(spark, sf_dir), ["scope_id"])


@query
def scrub_count_epochs(spark, sf_dir):
    numbers = tokens.epochs(C.corpus(spark, sf_dir), C.clears(spark, sf_dir))
    counted = _disposed(spark, sf_dir).select(*KEYS, "n_detections", "outcome")
    return disposition.scrub_count(counted.join(numbers, KEYS), ["scope_id", "epoch"])


@query
def exposure_rollup(spark, sf_dir):
    spans = explode_detections(_analysed(spark, sf_dir), [*KEYS, "lang"]).withColumn(
        "tier", policy.entity_tier(F.col("entity_type"))
    )
    return disposition.exposure_rollup(spans, ["entity_type", "tier", "source", "lang"])


# -- SQL --------------------------------------------------------------------
@query
def sql_surface(spark, sf_dir):
    """Written as SQL: sites of visits, tiers and decisions of events, Luhn of order numbers."""
    register(spark, OVERRIDES)
    for name in ("pages", "events", "orders"):
        C.table(spark, sf_dir, name).createOrReplaceTempView(f"surface_{name}")
    return spark.sql("""
        SELECT 'site' AS part, site_of(host_of(url)) AS name, host_of(url) AS detail, count(*) AS n
        FROM surface_pages GROUP BY ALL
        UNION ALL
        SELECT 'tier', tier_of(entity), concat(decision_of(entity), ' ', token_of(entity, 1)), count(*)
        FROM (SELECT CASE WHEN user_id % 3 = 0 THEN 'EMAIL_ADDRESS' WHEN user_id % 3 = 1 THEN 'LOCATION'
              ELSE upper(event_type) END AS entity FROM surface_events) GROUP BY ALL
        UNION ALL
        SELECT 'luhn', cast(luhn_valid(concat('no. ', lpad(o_orderkey * 7919 + o_custkey, 16, '4'))) AS STRING),
               o_orderstatus, count(*)
        FROM surface_orders GROUP BY ALL""")


# -- sites ------------------------------------------------------------------
@query
def site_attribution(spark, sf_dir):
    return routing.attribute_sites(C.visited(spark, sf_dir)).select("visit_id", "host", "site")


@query
def site_popup_match(spark, sf_dir):
    return routing.attribute_sites(C.visited(spark, sf_dir)).select(
        "visit_id", "host", "popup_site"
    )


@query
def site_coverage(spark, sf_dir):
    return (
        routing.attribute_sites(C.visited(spark, sf_dir))
        .groupBy("host", "site", "covered")
        .agg(F.count(F.lit(1)).alias("n_visits"))
        .withColumn("disagrees", (F.col("site") != routing.GENERIC) != F.col("covered"))
    )


# -- audits -----------------------------------------------------------------
@query
def audit_no_leak(spark, sf_dir):
    return audit.audit_no_leak(tokens.scrub_document(_analysed(spark, sf_dir)))


@query
def audit_span_integrity(spark, sf_dir):
    return audit.audit_span_integrity(_analysed(spark, sf_dir))


@query
def audit_overlap(spark, sf_dir):
    return audit.audit_overlap(_kept(spark, sf_dir), KEYS)


@query
def audit_round_trip(spark, sf_dir):
    return audit.audit_round_trip(tokens.scrub_document(_analysed(spark, sf_dir)))


@query
def audit_preserve(spark, sf_dir):
    return audit.audit_preserve(tokens.scrub_document(_analysed(spark, sf_dir)))


@query
def audit_session(spark, sf_dir):
    """Session scrubbing with a fault in every fiftieth message, which sends its text."""
    done = stage(tokens.scrub_session(_hits(spark, sf_dir)))
    fault = F.when(F.col("seq") % 50 == 0, F.col("text")).otherwise(F.col("scrubbed"))
    sent = done.withColumn("scrubbed", fault)
    audits = {"no_leak": audit.audit_no_leak(sent), "preserve": audit.audit_preserve(sent)}
    named = [a.select(F.lit(n).alias("audit"), *a.columns) for n, a in audits.items()]
    return named[0].unionByName(named[1])


@query
def audit_round_trip_session(spark, sf_dir):
    """Scrub and restore by one vault; every fiftieth message loses its end on the way."""
    hits = _hits(spark, sf_dir)
    vault = stage(tokens.token_vault(explode_detections(hits, KEYS)))
    done = tokens.scrub_session(hits, vault).select(*KEYS, "text", "scrubbed")
    cut = F.expr("substring(scrubbed, 1, length(scrubbed) - 1)")
    sent = stage(done.withColumn("scrubbed", F.when(F.col("seq") % 50 == 0, cut).otherwise(F.col("scrubbed"))))
    return audit.audit_round_trip_session(sent, vault)


@query
def audit_scope_leak(spark, sf_dir):
    """Documents and customers, of which every fiftieth sends its text unscrubbed."""
    messages = C.documents(spark, sf_dir).unionByName(C.customers(spark, sf_dir))
    analysed = stage(analyze(messages))
    hits = hits_only(analysed)
    vault = stage(tokens.token_vault(explode_detections(hits, KEYS)))
    done = tokens.scrub_session(hits, vault).select(*KEYS, "scrubbed")
    plain = analysed.where(F.size("detections") == 0).select(*KEYS, F.col("text").alias("scrubbed"))
    raw = analysed.where(F.col("seq") % 50 == 0).select(*KEYS, F.col("text").alias("scrubbed"))
    sent = stage(done.where(F.col("seq") % 50 != 0).unionByName(plain.where(F.col("seq") % 50 != 0)).unionByName(raw))
    return audit.scope_leaks(sent, vault)


@query
def scrub_skip_allowed(spark, sf_dir):
    analysed = _analysed(spark, sf_dir, settings=OVERRIDES)
    spans = tokens.scrubbed_spans(F.col("detections"), OVERRIDES, skip_allowed=True)
    hits = stage(hits_only(analysed.withColumn("detections", spans)))
    return tokens.scrub_session(hits).select(*KEYS, "scrubbed")


# -- streams ----------------------------------------------------------------
def _stream(spark, sf_dir) -> DataFrame:
    from pyspark.sql import types as T

    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("lang", T.StringType()),
            T.StructField("source", T.StringType()),
        ]
    )
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = spark.readStream.schema(schema)
    if store.getFileStatus(path).isDirectory():
        files = files.parquet(f"{sf_dir}/documents.parquet")
    else:  # a stream's path has to be a folder
        files = files.option("pathGlobFilter", "documents.parquet").parquet(sf_dir)
    return as_messages(files, "source", "doc_id", "text", "lang")


@query
def stream_analyze(spark, sf_dir):
    result = analyze(_stream(spark, sf_dir)).select(
        *KEYS, "failed", F.size("detections").alias("n_detections"), "top_tier", "decision"
    )
    return drain(result)


@query
def stream_tokenise(spark, sf_dir):
    from hushframe.streaming.tokens import stream_tokens, token_events

    spans = explode_detections(analyze(_stream(spark, sf_dir)), KEYS)
    return drain(stream_tokens(token_events(spans))).select(*VAULT)


@query
def stream_vault(spark, sf_dir):
    import uuid

    from hushframe.streaming.tokens import read_vault, stream_to_vault

    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    spans = explode_detections(analyze(_stream(spark, sf_dir)), KEYS)
    stream_to_vault(spans, f"{base}/vault", f"{base}/checkpoint")
    return read_vault(spark, f"{base}/vault").select(*VAULT)


@query
def stream_sessions(spark, sf_dir):
    """Tokens per session of each user's events, which arrive in three micro-batches."""
    import uuid

    from hushframe.streaming.jobs import run_available
    from hushframe.streaming.sessions import session_events, stream_session_tokens

    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    spans = C.event_spans(spark, sf_dir)
    low, high = spans.agg(*(f(F.col("ts").cast("timestamp").cast("double")) for f in (F.min, F.max))).first()
    third = (F.col("ts").cast("timestamp").cast("double") - (low or 0)) * 3 / ((high or 0) - (low or 0) + 1)
    out = f"{base}/out"
    for part in range(3):
        spans.where(F.coalesce(F.floor(third), F.lit(0)) == part).write.mode("append").parquet(f"{base}/in")
        arriving = spark.readStream.schema(spans.schema).parquet(f"{base}/in")
        found = stream_session_tokens(session_events(arriving, "ts"), C.SESSION_GAP, 3_600_000)
        run_available(found, out, f"{base}/checkpoint")
    columns = ["scope_id", "session_seq", "entity_type", "value", "first_seq", "idx", "token"]
    return spark.read.parquet(out).select(*columns)


@query
def stream_known_vault(spark, sf_dir):
    """The stream starts from a vault of the first half of the documents."""
    from hushframe.streaming.tokens import stream_tokens, token_events

    docs = C.documents(spark, sf_dir)
    half = (docs.agg(F.max("seq")).first()[0] or 0) // 2
    first = explode_detections(analyze(docs.where(F.col("seq") <= half)), KEYS)
    vault = stage(tokens.token_vault(first))
    spans = explode_detections(analyze(_stream(spark, sf_dir)), KEYS)
    fresh = drain(stream_tokens(token_events(spans), vault=vault)).select(*VAULT)
    return vault.select(*VAULT).unionByName(fresh)


@query
def stream_scrub(spark, sf_dir):
    """Documents that arrive in three parts, by number, one micro-batch each."""
    import uuid

    from hushframe.streaming.tokens import stream_scrub as scrub

    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    docs = C.documents(spark, sf_dir)
    last = docs.agg(F.max("seq")).first()[0] or 0
    third = F.floor(F.col("seq") * 3 / (F.lit(max(last, 0)) + 1))
    third = F.greatest(F.lit(0), F.coalesce(third, F.lit(0)))  # of null and negative numbers too
    for part in range(3):
        docs.where(third == part).write.mode("append").parquet(f"{base}/in")
        # a run takes all new files, however many, as one micro-batch
        scrub(
            spark.readStream.schema(docs.schema).parquet(f"{base}/in"),
            f"{base}/vault", f"{base}/out", f"{base}/checkpoint",
            policy.Settings("permissive"),
        )
    return spark.read.parquet(f"{base}/out").select(*KEYS, "outcome", "delivered")


@query
def stream_scrub_count(spark, sf_dir):
    import uuid

    from hushframe.streaming.jobs import read_counter, scrub_counter

    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    analysed = analyze(_stream(spark, sf_dir), policy.Settings("permissive"))
    scrub_counter(disposition.dispose(analysed, None), f"{base}/out", f"{base}/checkpoint")
    return read_counter(spark, f"{base}/out")
