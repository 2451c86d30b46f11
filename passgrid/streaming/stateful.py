"""Rules with state and timers (``transformWithState``): recidivism, idle sweep and wipe of raw fields.

They need the RocksDB state store (``use_state_store``).  Event-time rules hold what arrives until
the watermark has passed it and then take it in order, so a stream answers as its batch form does,
whatever the order of arrival within the watermark; timers give up state that has grown old.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from passgrid.streaming.jobs import NEXT, RECIDIVISM

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A row's event time in microseconds, which no session time zone moves.
MICROS = "__micros"


def use_state_store(spark: SparkSession) -> None:
    """Set the state store that these rules need, for streams started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _InOrder(StatefulProcessor):
    """Rows wait (by event time in microseconds and id) until the watermark is past them, then are taken in order.

    A key holds what arrived within the watermark's delay; a timer stands at each waiting time, and
    the first to fire takes all that the watermark has passed.
    """

    waiting_schema: str
    ident: str
    fields: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, ident long", self.waiting_schema)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        times = set()
        for r in rows:
            self.waiting.updateValue((r[MICROS], r[self.ident]), tuple(r[f] for f in self.fields))
            times.add(-(-r[MICROS] // 1000))
        for ms in times:
            self.handle.registerTimer(ms)
        return iter([])

    def due(self, timerValues: TimerValues) -> list[tuple[int, int, Any]]:
        """What the watermark has passed, in order; it waits no longer."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready = sorted(((k[0], k[1], v) for k, v in self.waiting.iterator() if k[0] <= passed), key=lambda x: x[:2])
        for at, ident, _ in ready:
            self.waiting.removeKey((at, ident))
        return ready

    def close(self) -> None:
        pass


class Recidivism(_InOrder):
    """A report against the latest earlier one of its identifier at each other checkpoint; a checkpoint not seen for ``keep`` is forgotten."""

    waiting_schema, ident, fields = "checkpoint string", "id", ["checkpoint"]

    def __init__(self, keep: int):
        self.keep = keep * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.seen = handle.getMapState("seen", "checkpoint string", "id long, at long")

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        seen = {k[0]: (v[0], v[1]) for k, v in self.seen.iterator()}
        changed = set()
        for at, ident, (checkpoint,) in self.due(timerValues):
            for place, (prior, last) in seen.items():
                if place != checkpoint and at - last <= self.keep:
                    yield Row(identifier_hash=key[0], id=ident, prior_id=prior, prior_checkpoint=place, checkpoint=checkpoint)
            seen[checkpoint] = (ident, at)
            changed.add(checkpoint)
        for place in changed:
            self.seen.updateValue((place,), seen[place])
            self.handle.registerTimer((seen[place][1] + self.keep) // 1000 + 1)
        old = timerValues.getCurrentWatermarkInMs() * 1000 - self.keep
        for place, (_, last) in seen.items():
            if last < old:
                self.seen.removeKey((place,))


class LiveRecidivism(StatefulProcessor):
    """The same at once, in order of arrival; the store forgets a checkpoint ``keep`` minutes of clock time after its last report."""

    def __init__(self, keep: float):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "checkpoint string", "id long", ttlDurationMs=int(self.keep * 60_000))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        seen = {k[0]: v[0] for k, v in self.seen.iterator()}
        changed = set()
        for r in sorted(rows, key=lambda r: (r.created_at, r.id)):
            for place, prior in seen.items():
                if place != r.checkpoint:
                    yield Row(identifier_hash=key[0], id=r.id, prior_id=prior, prior_checkpoint=place, checkpoint=r.checkpoint)
            seen[r.checkpoint] = r.id
            changed.add(r.checkpoint)
        for place in changed:
            self.seen.updateValue((place,), (seen[place],))

    def close(self) -> None:
        pass


def recidivism(stream: DataFrame, keep_minutes: int = 60 * 24 * 30, late: str = "10 minutes") -> DataFrame:
    """Each report against the latest earlier one of its identifier at each other checkpoint, in event time.

    Rows come out once the watermark has passed them; partners older than ``keep_minutes`` are none.
    State is an identifier's last report per checkpoint and what waits; both are given up by timers.
    """
    keyed = stream.withColumn(MICROS, F.unix_micros("created_at")).withWatermark("created_at", late).groupBy("identifier_hash")
    return keyed.transformWithState(Recidivism(keep_minutes), RECIDIVISM, "Append", "EventTime")


def live_recidivism(stream: DataFrame, keep_minutes: float = 60 * 24 * 30) -> DataFrame:
    """The same in order of arrival, without delay; entries live ``keep_minutes`` of clock time (run it with a processing-time trigger)."""
    return stream.groupBy("identifier_hash").transformWithState(LiveRecidivism(keep_minutes), RECIDIVISM, "Append", "ProcessingTime")


RAW_FIELDS = "session_id long, at long, status string, events long, raw string, note string"
SWEPT = "raw fields removed after inactivity"


class RawFields(_InOrder):
    """A session's status, raw fields and note after each of its events; a timer sweeps an open one that is idle."""

    waiting_schema, ident, fields = "action string, raw string", "event_id", ["action", "raw"]

    def __init__(self, idle: int):
        self.idle = idle * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.session = handle.getValueState("session", "status string, events long, at long, raw string, note string")

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        before = tuple(self.session.get()) if self.session.exists() else ("open", 0, None, None, None)
        status, events, last, raw, note = before
        row = lambda at: Row(session_id=key[0], at=at, status=status, events=events, raw=raw, note=note)

        def swept(until: int) -> bool:
            return status == "open" and last is not None and until - last > self.idle and (raw is not None or note is None)

        for at, _, (action, new) in self.due(timerValues):
            if swept(at):
                raw, note = None, SWEPT
                yield row(last + self.idle)
            status, events, last = NEXT.get((status, action), status), events + 1, at
            raw = None if status != "open" else new if new is not None else raw
            yield row(at)
        if swept(timerValues.getCurrentWatermarkInMs() * 1000):
            raw, note = None, SWEPT
            yield row(last + self.idle)
        if (now := (status, events, last, raw, note)) != before:
            self.session.update(now)
            if status == "open" and raw is not None:
                self.handle.registerTimer((last + self.idle) // 1000 + 1)


def raw_fields(stream: DataFrame, idle_minutes: int = 240, late: str = "10 minutes") -> DataFrame:
    """Sessions of (session_id, ts, event_id, action, raw) with their raw fields for no longer than allowed: RAW_FIELDS.

    A row per event, as of its time; any status but open has no raw fields.  An open session without an event for more than
    ``idle_minutes`` gets one more row, without raw fields and with a note, from a timer of event time
    (or before the event that ends the stretch).  A null ``raw`` leaves what is there.
    """
    keyed = stream.withColumn(MICROS, F.unix_micros("ts")).withWatermark("ts", late).groupBy("session_id")
    return keyed.transformWithState(RawFields(idle_minutes), RAW_FIELDS, "Append", "EventTime").withColumn("at", F.timestamp_micros("at"))


def last_state(rows: DataFrame) -> DataFrame:
    """The state of every session after its rows: events counted, then the sweep that follows the last of them."""
    order = F.struct("events", F.col("note").isNotNull() & F.col("raw").isNull(), "at")
    return rows.groupBy("session_id").agg(F.max_by(F.struct("status", "events", "raw", "note"), order).alias("s")).select("session_id", "s.*")
