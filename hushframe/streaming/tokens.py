"""Session tokens on a stream.

Two chained state operators.  The first, per (scope, entity type, part of the values by
hash), lets a value pass when it is new, so a hot type is spread over many tasks; the
second, per (scope, entity type), numbers what is new and keeps one counter.  Within a
micro-batch new values are numbered by (seq, start), across batches in the order of
arrival; so the result equals the batch vault where the input arrives in the order of
``seq``.  A CLEAR event drops the state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hushframe.operators.detectors import explode_detections
from hushframe.operators.disposition import dispose
from hushframe.operators.policy import DEFAULT_SETTINGS, Settings
from hushframe.operators.tokens import vault_append
from hushframe.plans.analyze import analyze
from hushframe.plans.send import deliver
from hushframe.sources.session import STATE_STORE
from hushframe.sources.tables import stage
from hushframe.streaming.jobs import AVAILABLE_NOW, for_each_batch

OUTPUT = (
    "scope_id string, entity_type string, value string, first_seq bigint, "
    "first_start int, epoch int, idx bigint, token string"
)


#: Tasks over which the values of one (scope, entity type) are spread.
PARTS = 32
_EVENT = (
    "scope_id string, entity_type string, seq bigint, kind string, start int, value string"
)


def new_values_processor(ttl_ms: int | None = None) -> StatefulProcessor:
    """Pass on spans of values not seen since the last clear, and one copy of each clear.

    The class is local so that it is shipped to the workers as a whole.
    """
    columns = [part.split()[0] for part in _EVENT.split(", ")]

    class NewValues(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self._seen = handle.getMapState(
                "seen", "value string", "yes boolean", ttlDurationMs=ttl_ms
            )

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            scope_id, entity_type, part = key
            batch = pd.concat(list(rows), ignore_index=True)
            batch = batch.sort_values(["seq", "kind", "start"], kind="stable")
            # one look at the state per value between two clears
            turn = (batch["kind"] == "~clear").cumsum()
            same = pd.DataFrame({"p": turn, "k": batch["kind"], "v": batch["value"]})
            batch = batch[~same.duplicated()]
            fresh = []
            for row in batch.itertuples(index=False):
                if row.kind == "~clear":
                    self._seen.clear()
                    if part:
                        continue
                else:
                    known = self._seen.containsKey((row.value,))
                    if not known or ttl_ms:  # an entry's time counts from its last write
                        self._seen.updateValue((row.value,), (True,))
                    if known:
                        continue
                fresh.append((scope_id, entity_type, row.seq, row.kind, row.start, row.value))
            yield pd.DataFrame(fresh, columns=columns).astype({"start": "Int32"})

        def handleInitialState(self, key, initialState, timerValues) -> None:
            for value in initialState["value"]:
                self._seen.updateValue((value,), (True,))

        def close(self) -> None:
            pass

    return NewValues()


def token_processor(ttl_ms: int | None = None) -> StatefulProcessor:
    """Number the new values of a (scope, entity type); one token row per value."""
    columns = [part.split()[0] for part in OUTPUT.split(", ")]

    class TokenState(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self._last = handle.getValueState(
                "last", "idx bigint, epoch int", ttlDurationMs=ttl_ms
            )

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            scope_id, entity_type = key
            last, epoch = self._last.get() if self._last.exists() else (0, 0)
            batch = pd.concat(list(rows), ignore_index=True)
            batch = batch.sort_values(["seq", "kind", "start", "value"], kind="stable")
            turn = (batch["kind"] == "~clear").cumsum().reset_index(drop=True)
            batch = batch.reset_index(drop=True)
            spans = batch[batch["kind"] != "~clear"]
            turn_of = turn[spans.index]
            place = spans.groupby(turn_of).cumcount() + 1
            # before the first clear the counter goes on, after each it starts again
            idx = place + (turn_of == 0) * last
            after = place[turn_of == turn.iloc[-1]]
            base = last if turn.iloc[-1] == 0 else 0
            out = pd.DataFrame(
                {
                    "scope_id": scope_id,
                    "entity_type": entity_type,
                    "value": spans["value"],
                    "first_seq": spans["seq"],
                    "first_start": spans["start"].astype("int32"),
                    "epoch": epoch + turn_of,
                    "idx": idx,
                    "token": [f"<{entity_type}_{i}>" for i in idx],
                },
                columns=columns,
            )
            self._last.update((base + len(after), epoch + int(turn.iloc[-1])))
            yield out

        def handleInitialState(self, key, initialState, timerValues) -> None:
            self._last.update((int(initialState["idx"].max()), 0))

        def close(self) -> None:
            pass

    return TokenState()


VAULT = (
    "scope_id string, entity_type string, value string, first_seq bigint, "
    "first_start int, idx bigint, token string"
)


def _stream_id(checkpoint: str) -> str:
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def _known(spans: DataFrame, vault_path: str, stream: str, batch_id: int) -> DataFrame:
    """The vault's rows of the batch's scopes, but for those of this batch itself."""
    own = (F.col("stream") == stream) & (F.col("batch") >= batch_id)
    scopes = spans.select("scope_id").distinct()
    vault = read_vault(spans.sparkSession, vault_path).where(~own)
    return vault.select(*_COLUMNS).join(scopes, "scope_id", "left_semi")


_COLUMNS = [part.split()[0] for part in VAULT.split(", ")]


def stream_to_vault(
    spans: DataFrame, vault_path: str, checkpoint: str, trigger: dict = AVAILABLE_NOW
):
    """Keep a vault table up to date with a stream of spans.

    The same numbering as ``stream_tokens``, with the vault on shared storage in
    place of state: each micro-batch appends its new values by joins and block-wise
    numbering, so one very large scope is spread over many tasks.  Values that the
    vault knows from other streams or earlier runs keep their tokens.  Files are kept
    by stream (its checkpoint) and batch, so a batch that runs again replaces its own rows
    and no others.  Only the scopes of the batch are looked up.  One stream at a time may
    write to a scope.
    """
    stream = _stream_id(checkpoint)

    def work(batch: DataFrame, batch_id: int) -> None:
        fresh = vault_append(_known(batch, vault_path, stream, batch_id), batch)
        fresh.select(*_COLUMNS).write.mode("overwrite").parquet(
            f"{vault_path}/stream={stream}/batch={batch_id}"
        )

    return for_each_batch(spans, work, checkpoint, trigger)


def stream_scrub(
    messages: DataFrame,
    vault_path: str,
    out_path: str,
    checkpoint: str,
    settings: Settings = DEFAULT_SETTINGS,
    trigger: dict = AVAILABLE_NOW,
):
    """Send a stream of messages on: ``scope_id, seq, outcome, delivered`` under ``out_path``.

    Each micro-batch is analysed once, mints tokens for what it sends scrubbed, appends
    them to the vault table and only then writes its texts.  Known values keep their
    tokens, as in ``stream_to_vault``; a batch that runs again writes the same again.
    """
    stream = _stream_id(checkpoint)

    def work(batch: DataFrame, batch_id: int) -> None:
        disposed = stage(dispose(analyze(batch, settings), None))
        sent = disposed.where(F.col("outcome") == "sent_scrubbed")
        spans = explode_detections(sent, ["scope_id", "seq"])
        known = _known(spans, vault_path, stream, batch_id)
        place = f"{vault_path}/stream={stream}/batch={batch_id}"
        vault_append(known, spans).select(*_COLUMNS).write.mode("overwrite").parquet(place)
        fresh = batch.sparkSession.read.schema(VAULT).parquet(place)
        delivered = deliver(disposed, known.unionByName(fresh))
        delivered.select("scope_id", "seq", "outcome", "delivered").write.mode(
            "overwrite"
        ).parquet(f"{out_path}/batch={batch_id}")

    return for_each_batch(messages, work, checkpoint, trigger)


def read_vault(spark: SparkSession, vault_path: str) -> DataFrame:
    """The vault that ``stream_to_vault`` keeps; empty where none is yet."""
    schema = f"{VAULT}, stream string, batch bigint"
    try:
        return spark.read.schema(schema).parquet(vault_path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def use_state_store(spark: SparkSession) -> None:
    """The state operators need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def token_events(spans: DataFrame) -> DataFrame:
    """Span rows as state input."""
    return spans.select(
        "scope_id", "entity_type", "seq", F.lit("span").alias("kind"), "start", "value"
    )


def clear_events(clears: DataFrame, entity_types: list[str]) -> DataFrame:
    """A clear reaches the state of every entity type of its scope.

    Its kind sorts behind the spans of the message with the same ``seq``.
    """
    return clears.select(
        "scope_id",
        F.explode(F.array(*(F.lit(t) for t in entity_types))).alias("entity_type"),
        "seq",
        F.lit("~clear").alias("kind"),
        F.lit(None).cast("int").alias("start"),
        F.lit(None).cast("string").alias("value"),
    )


def stream_tokens(
    events: DataFrame,
    ttl_ms: int | None = None,
    vault: DataFrame | None = None,
    parts: int = PARTS,
) -> DataFrame:
    """Tokens of a stream of ``token_events`` (and ``clear_events``).

    ``vault``, where given, is what the stream starts from: its values keep their tokens
    and are not given out again, its counters go on.  It is read when the query first
    starts, not when it goes on from its checkpoint.  Time to live, where given, ends a
    value's state some time after its last use; it then gets a token anew, and a type's
    counter starts again from 1 if nothing new came for as long.
    """
    use_state_store(events.sparkSession)
    part = F.pmod(F.xxhash64("value"), F.lit(parts)).cast("int")
    all_parts = F.sequence(F.lit(0), F.lit(parts - 1))
    dealt = events.withColumn(
        "part", F.explode(F.when(F.col("kind") == "~clear", all_parts).otherwise(F.array(part)))
    )
    keys = ["scope_id", "entity_type"]
    known = last = None
    if vault is not None:
        known = vault.select(*keys, part.alias("part"), "value").groupBy(*keys, "part")
        last = vault.groupBy(*keys).agg(F.max("idx").alias("idx")).groupBy(*keys)
    mode = "ProcessingTime" if ttl_ms else "None"
    fresh = dealt.groupBy(*keys, "part").transformWithStateInPandas(
        statefulProcessor=new_values_processor(ttl_ms),
        outputStructType=_EVENT,
        outputMode="Append",
        timeMode=mode,
        initialState=known,
    )
    return fresh.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=token_processor(ttl_ms),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode=mode,
        initialState=last,
    )
