"""Sessions on a stream: tokens that last until a scope falls silent.

A session of a scope goes on while its events are at most ``gap`` apart in event time.
When it ends, its known values and counters are dropped and numbering starts again, so
its tokens mean nothing later.  State of one scope is in one task, as a session is an
order of events; only distinct values are kept, and only those of the session that is
open when a micro-batch ends: sessions that begin and end within one never reach the
state, whose calls cost more than all else.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hushframe.streaming.tokens import use_state_store

OUTPUT = (
    "scope_id string, session_start bigint, session_seq bigint, entity_type string, "
    "value string, first_seq bigint, first_start int, idx bigint, token string"
)


def session_processor(gap: int, idle_ms: int) -> StatefulProcessor:
    """One row per new value of a session; times in microseconds.

    The class is local so that it is shipped to the workers as a whole.
    """
    output = Row(*(part.split()[0] for part in OUTPUT.split(", ")))

    def place(r: Row) -> tuple:
        """By time, number, start and value, missing ones last."""
        seq, start, value = r.seq, r.start, r.value
        return r.at, seq is None, seq or 0, start is None, start or 0, value is None, value or ""

    def islands(rows: list[Row]) -> Iterator[list[Row]]:
        """Sorted rows, parted where they are more than ``gap`` apart."""
        begin = 0
        for i in range(1, len(rows)):
            if rows[i].at - rows[i - 1].at > gap:
                yield rows[begin:i]
                begin = i
        yield rows[begin:]

    class SessionState(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self._handle = handle
            self._open = handle.getValueState(
                "open", "start bigint, seq bigint, last bigint, until bigint"
            )
            self._known = handle.getMapState(
                "known", "entity_type string, value string", "idx bigint"
            )
            self._counts = handle.getMapState("counts", "entity_type string", "n bigint")

        def _number(self, scope, rows: list[Row], start, seq, known, counts, stored) -> Iterator[Row]:
            """Tokens of values that neither ``known`` nor, with ``stored``, the state has."""
            looked = set()
            for r in rows:
                value = r.entity_type, r.value
                if value in known or value in looked:
                    continue
                if stored and self._known.containsKey(value):
                    looked.add(value)
                    continue
                kind = r.entity_type
                if kind not in counts:
                    old = stored and self._counts.containsKey((kind,))
                    counts[kind] = self._counts.getValue((kind,))[0] if old else 0
                idx = known[value] = counts[kind] = counts[kind] + 1
                token = f"<{kind}_{idx}>"
                yield output(scope, start, seq, kind, r.value, r.seq, int(r.start), idx, token)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            (scope,) = key
            held = self._open.get()
            held = held and tuple(held[:3])
            # of the session that is open: its new values and counters, and whether the
            # state has the ones before
            known, counts, stored = {}, {}, held is not None
            was = stored
            for island in islands(sorted(rows, key=place)):
                first, last, seq = island[0].at, island[-1].at, island[0].seq
                if held and last < held[0] - gap:
                    # late: its own session is over, and the open one goes on untouched
                    yield from self._number(scope, island, first, seq, {}, {}, False)
                    continue
                if held and first <= held[2] + gap:
                    held = (held[0], held[1], max(held[2], last))
                else:
                    known, counts, stored, held = {}, {}, False, (first, seq, last)
                yield from self._number(scope, island, held[0], held[1], known, counts, stored)
            if was and not stored:
                self._known.clear()
                self._counts.clear()
            for value, idx in known.items():
                self._known.updateValue(value, (idx,))
            for kind, n in counts.items():
                self._counts.updateValue((kind,), (n,))
            until = timerValues.getCurrentProcessingTimeInMs() + idle_ms
            self._open.update((*held, until))
            self._handle.registerTimer(until)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            # an earlier timer of a session that went on has nothing to end
            if self._open.exists() and self._open.get()[3] <= expiredTimerInfo.getExpiryTimeInMs():
                self._open.clear()
                self._known.clear()
                self._counts.clear()
            return iter(())

        def close(self) -> None:
            pass

    return SessionState()


def session_events(spans: DataFrame, at: str | Column) -> DataFrame:
    """Span rows with their event time as state input; rows without a time are left out.

    Those have no place in a session; a scrubbing job has to hold their messages.
    """
    time = F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp"))
    rows = spans.select("scope_id", time.alias("at"), "seq", "start", "entity_type", "value")
    return rows.where(F.col("at").isNotNull() & F.col("scope_id").isNotNull())


def stream_session_tokens(events: DataFrame, gap_seconds: float, idle_ms: int) -> DataFrame:
    """Tokens of a stream of ``session_events``, one row per new value of a session.

    A session is named by its first event (``session_start`` in microseconds and
    ``session_seq``).  It ends by event time, when an event comes more than
    ``gap_seconds`` after its last one; a late event, more than that before its first
    one, makes a session of its own and leaves the open one alone.  The state of a scope
    that nothing comes for is dropped ``idle_ms`` of processing time after its last
    events, by a timer.  That is no watermark on purpose: behind a watermark Spark drops
    rows before any operator sees them, and a message must not get lost.
    """
    use_state_store(events.sparkSession)
    return events.groupBy("scope_id").transformWithState(
        statefulProcessor=session_processor(int(gap_seconds * 1_000_000), idle_ms),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="ProcessingTime",
    )
