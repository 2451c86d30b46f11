"""Screening rules over arriving events, and the batch forms that say what they must come to.

Every stream function takes and returns a streaming DataFrame (watermarks bound its state); the
``*_batch`` functions give the whole answer over a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, StructField, StructType

from passgrid.operators.ledger import chained, monotone_close


# Idempotent intake -----------------------------------------------------------------------------------------------------
def kept_times(times: np.ndarray, last: float, seconds: int) -> list[int]:
    """Places of rising ``times`` that pass after one kept at ``last``: each more than ``seconds`` after the one kept before."""
    out, at = [], int(np.searchsorted(times, last + seconds, "right"))
    while at < len(times):
        out.append(at)
        at = int(np.searchsorted(times, times[at] + seconds, "right"))
    return out


def intake(stream: DataFrame, keys: list[str], ts: str, seconds: int = 60) -> DataFrame:
    """A key's first row passes and replays do not, until more than ``seconds`` after the row that passed last.

    State is one time a key, dropped when the watermark is past it.
    """
    schema = stream.schema

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else -np.inf
        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        times = rows[ts].to_numpy().astype("datetime64[s]").astype(np.int64)
        passed = kept_times(times, last, seconds)
        if passed:
            last = float(times[passed[-1]])
        state.update((last,))
        state.setTimeoutTimestamp(max(int(last + seconds + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        yield rows.iloc[passed]

    keyed = stream.withWatermark(ts, f"{seconds} seconds").groupBy(*keys)
    return keyed.applyInPandasWithState(update, schema, "last double", "append", GroupStateTimeout.EventTimeTimeout)


def stretches(rows: DataFrame, keys: list[str], seconds: int, width: int) -> DataFrame:
    """Rows (with ``__t``, seconds) with ``__stretch``: a key's rows until the first gap of more than ``seconds``.

    Gaps are found within stretches of ``width`` seconds of the clock, and from one to the next by their
    first and last times, so that no window holds more of a key than one of them, or a row for each.
    """
    cell = F.floor(F.col("__t") / width)
    celled = rows.withColumn("__cell", cell)
    within = W.partitionBy(*keys, "__cell").orderBy("__t")
    gap = lambda before: F.when(F.col("__t") - before > seconds, 1).otherwise(0)
    # All rows of a second are equals: the first one takes the gap, and sums are by time.
    marked = celled.withColumn("__gap", gap(F.lag("__t").over(within)))
    cells = marked.groupBy(*keys, "__cell").agg(F.min("__t").alias("__first"), F.max("__t").alias("__last"), F.sum("__gap").alias("__gaps"))
    by_cell = W.partitionBy(*keys).orderBy("__cell")
    cells = cells.withColumn("__new", F.when(F.col("__first") - F.lag("__last").over(by_cell) > seconds, 1).otherwise(0))
    before = F.sum(F.col("__gaps") + F.col("__new")).over(by_cell.rowsBetween(W.unboundedPreceding, 0)) - F.col("__gaps")
    started = cells.select(*keys, "__cell", before.alias("__before"))
    running = F.sum("__gap").over(within.rangeBetween(W.unboundedPreceding, 0))
    met = marked.withColumn("__sum", running).alias("m")
    return met.join(started.alias("s"), [F.col(f"m.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "__cell"]]).select("m.*", (F.col("__before") + F.col("__sum")).alias("__stretch")).drop("__gap", "__sum", "__cell")


def intake_batch(df: DataFrame, keys: list[str], ts: str, order: str, seconds: int = 60) -> DataFrame:
    """The same over a table.

    After a gap of more than ``seconds`` a key's next row passes whatever came before, so the stretches
    between gaps are told apart first and go through one by one, in time order: what one task has
    to take in order is a stretch, and none of it is gathered.  Rows without a time are left out.
    """
    timed = df.where(F.col(ts).isNotNull()).withColumn("__t", F.unix_timestamp(ts))
    rows = stretches(timed, keys, seconds, 64 * seconds).withColumn("__key", F.concat_ws("\x01", *[F.coalesce(F.col(k).cast("string"), F.lit("\x02")) for k in keys], F.col("__stretch").cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, -np.inf
        for batch in batches:
            if not batch.num_rows:
                continue
            keys_, times = np.array(batch.column("__key").to_pylist(), object), batch.column("__t").to_numpy()
            cuts = [0, *(np.nonzero(keys_[1:] != keys_[:-1])[0] + 1).tolist(), len(keys_)]
            passed = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if keys_[a] != key:
                    key, last = keys_[a], -np.inf
                own = kept_times(times[a:b], last, seconds)
                if own:
                    last = times[a + own[-1]]
                passed += [a + i for i in own]
            yield batch.take(pa.array(passed, pa.int64()))

    return rows.repartition("__key").sortWithinPartitions("__key", "__t", order).mapInArrow(run, rows.schema).drop("__t", "__stretch", "__key")


# Throughput, bursts, sessions of activity ---------------------------------------------------------------------------------
def throughput(events: DataFrame, ts: str, width: str = "60 minutes", slide: str = "60 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per window; works on streams and on tables."""
    kept = events.withWatermark(ts, late) if events.isStreaming else events
    return kept.groupBy(F.window(ts, width, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def bursts(events: DataFrame, ts: str, place: str, suspicious, least: int = 3, late: str = "10 minutes") -> DataFrame:
    """Windows of an hour, moved by ten minutes, in which a place has so many suspicious events."""
    kept = events.withWatermark(ts, late) if events.isStreaming else events
    counted = kept.where(suspicious).groupBy(F.window(ts, "60 minutes", "10 minutes").alias("w"), place).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least).select(F.col("w.start").alias("start"), place, "n")


def activity(events: DataFrame, ts: str, who: str, gap: str = "240 minutes", late: str = "10 minutes") -> DataFrame:
    """Stretches of a user's events with no longer gap than given."""
    kept = events.withWatermark(ts, late) if events.isStreaming else events
    return kept.groupBy(F.session_window(ts, gap).alias("w"), who).agg(F.count("*").alias("n")).select(who, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


# Watchlist and recidivism --------------------------------------------------------------------------------------------------
def watchlist_hits(stream: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Arriving identifiers on a static list (Spark broadcasts it if it is small enough)."""
    return stream.join(watchlist.select("identifier_hash", "category"), "identifier_hash")


RECIDIVISM = "identifier_hash string, id long, prior_id long, prior_checkpoint string, checkpoint string"


def recidivism(stream: DataFrame, keep_minutes: int = 60 * 24 * 30) -> DataFrame:
    """Each arriving report against the latest one of the same identifier at another checkpoint.

    State holds an identifier's last report per checkpoint, and is dropped when no report came for
    ``keep_minutes`` of event time.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen: dict[str, int] = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows, newest = [], 0
        for batch in batches:
            for r in batch.sort_values(["created_at", "id"]).itertuples():
                rows += [(key[0], r.id, prior, place, r.checkpoint) for place, prior in seen.items() if place != r.checkpoint]
                seen[r.checkpoint] = r.id
                newest = max(newest, int(r.created_at.timestamp() * 1000))
        state.update((list(seen), list(seen.values())))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs() + 1) + keep_minutes * 60_000)
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECIDIVISM.split(", ")])

    keyed = stream.withWatermark("created_at", "10 minutes").groupBy("identifier_hash")
    return keyed.applyInPandasWithState(update, RECIDIVISM, "places array<string>, ids array<long>", "append", GroupStateTimeout.EventTimeTimeout)


#: Priors that are held before they are passed on (those of one report at least).
PRIORS = 1 << 17


def _with_priors(keys: list[str], order: list[str], once: bool = False):
    """Sorted rows as they pass, each with the last id at every place among the earlier rows of its keys.

    Rows of equal order are not earlier than each other; ``once`` gives priors to the first of them only.
    Rows without an order are heads: what came before the others, given no priors.  All that is held of a
    key is an id for each place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, seen, fresh = None, None, {}, {}
        for batch in batches:
            places, ids, ends, start = [], [], [0], 0

            def passed(stop: int, batch=batch) -> pa.RecordBatch:
                own = pa.StructArray.from_arrays([pa.array(places, batch.schema.field("checkpoint").type), pa.array(ids, batch.schema.field("id").type)], names=["checkpoint", "id"])
                priors = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), own)
                return pa.RecordBatch.from_arrays([*batch.slice(start, stop - start).columns, priors], names=[*batch.schema.names, "priors"])

            column = {c: batch.column(c).to_pylist() for c in {*keys, *order, "checkpoint", "id"}}
            rows = zip(zip(*[column[c] for c in keys], strict=True), zip(*[column[c] for c in order], strict=True), column["checkpoint"], column["id"], strict=True)
            for n, (own, at, place, id_) in enumerate(rows, 1):
                if own != key:
                    key, now, seen, fresh = own, None, {}, {}
                first = at != now
                if first:
                    seen.update(fresh)
                    now, fresh = at, {}
                if at[0] is None:
                    seen[place] = id_
                else:
                    if first or not once:
                        places += seen
                        ids += seen.values()
                    if id_ is not None:
                        fresh[place] = id_
                ends.append(len(ids))
                if len(ids) >= PRIORS:
                    yield passed(n)
                    places, ids, ends, start = [], [], [0], n
            if len(ends) > 1:
                yield passed(batch.num_rows)

    return run


def _micros(df: DataFrame, ts: str) -> Column:
    """A time as microseconds; one without a zone as it stands, whatever the session's zone skips."""
    if df.schema[ts].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(F.col(ts).cast("timestamp"))
    since = F.col(ts) - F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return (since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")


def recidivism_batch(reports: DataFrame) -> DataFrame:
    """The same over a table: for each report, the latest earlier one of its identifier at each other checkpoint.

    No report meets another, and none is multiplied by the places before it is sorted: the last id at
    each place runs along as sorted partitions pass.  A partition is cut by days, each headed by the last
    of the days before, so that an identifier of very many reports is not one task.
    """
    rows = reports.where(F.col("identifier_hash").isNotNull() & F.col("checkpoint").isNotNull() & F.col("created_at").isNotNull())
    in_day = F.pmod("at", F.lit(86_400_000_000))
    rows = rows.select("identifier_hash", _micros(reports, "created_at").alias("at"), "id", "checkpoint").select("identifier_hash", (F.col("at") - in_day).alias("day"), "at", "id", "checkpoint")
    fields = {f.name: StructField(f.name, f.dataType) for f in rows.schema}  # heads have no time, though the reports' may be declared without nulls
    schema = StructType([*fields.values(), StructField("priors", ArrayType(StructType([fields["checkpoint"], fields["id"]])))])
    # Time of day and id as one number: a maximum by it needs no sort of the reports, as one by a struct does.
    last = in_day.cast("decimal(11,0)") * F.lit(Decimal(10**20)) + F.col("id")
    ends = rows.groupBy("identifier_hash", "day", "checkpoint").agg(F.max_by("id", last).alias("id"))
    by_day = ends.select("identifier_hash", "day", F.lit(None).cast("long").alias("at"), "id", "checkpoint").repartition("identifier_hash").sortWithinPartitions("identifier_hash", "day")
    heads = by_day.mapInArrow(_with_priors(["identifier_hash"], ["day"], once=True), schema).select("identifier_hash", "day", "at", F.explode("priors").alias("p")).select("identifier_hash", "day", "at", "p.id", "p.checkpoint")
    own = ["identifier_hash", "day"]
    met = rows.unionByName(heads).repartition(*own).sortWithinPartitions(*own, "at", "id").mapInArrow(_with_priors(own, ["at", "id"]), schema)
    found = met.select("identifier_hash", "id", "checkpoint", F.explode("priors").alias("p")).where(F.col("p.checkpoint") != F.col("checkpoint"))
    return found.select("identifier_hash", "id", "checkpoint", F.col("p.checkpoint").alias("prior_checkpoint"), F.col("p.id").alias("prior_id"))


# Session lifecycle ----------------------------------------------------------------------------------------------------------
LIFECYCLE = "session_id long, status string, events long"
NEXT = {("open", "approve"): "approved", ("open", "flag"): "flagged", ("open", "close"): "closed", ("flagged", "clear"): "approved", ("flagged", "reject"): "rejected"}


def lifecycle(stream: DataFrame, idle_minutes: int = 240) -> DataFrame:
    """State of each session after its events so far; an open one idle for too long is closed."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n = state.get if state.exists else ("open", 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], "closed" if status == "open" else status, n)], columns=["session_id", "status", "events"])
            return
        newest = 0
        for batch in batches:
            for r in batch.sort_values(["ts", "event_id"]).itertuples():
                status, n = NEXT.get((status, r.action), status), n + 1
                newest = max(newest, int(r.ts.timestamp() * 1000))
        state.update((status, n))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs() + 1) + idle_minutes * 60_000)
        yield pd.DataFrame([(key[0], status, n)], columns=["session_id", "status", "events"])

    keyed = stream.withWatermark("ts", "10 minutes").groupBy("session_id")
    return keyed.applyInPandasWithState(update, LIFECYCLE, "status string, n long", "update", GroupStateTimeout.EventTimeTimeout)


STATES = ["open", "approved", "flagged", "closed", "rejected"]


def _folded(keys: list[str], start: str, apply):
    """Sorted rows of each key folded into one, as they pass: (keys, to, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, n, done = None, None, 0, []
        schema = None
        for batch in batches:
            schema = batch.schema
            for *own, step, count in zip(*[batch.column(c).to_pylist() for c in [*keys, start, "n"]], strict=True):
                if own != key:
                    if key is not None:
                        done.append((*key, now, n))
                    key, now, n = own, list(range(len(STATES))), 0
                now, n = apply(now, step), n + count
            if done:
                yield _folds(done, keys, schema)
                done = []
        if key is not None:
            yield _folds([(*key, now, n)], keys, schema)

    return run


def _folds(rows: list[tuple], keys: list[str], schema: pa.Schema) -> pa.RecordBatch:
    types = [*[schema.field(k).type for k in keys], pa.list_(pa.int32()), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[*keys, "to", "n"])


def lifecycle_batch(events: DataFrame) -> DataFrame:
    """The state after all events in order.

    A day of a session is the function that takes each of the five states to the one its events lead
    to, and a session composes its days; both are folded row by row as sorted partitions pass, so
    nothing of a session is gathered.
    """
    moves = {action: [STATES.index(NEXT.get((s, action), s)) for s in STATES] for _, action in NEXT}
    coded = events.select("session_id", F.to_date("ts").alias("day"), "ts", "event_id", "action", F.lit(1).cast("long").alias("n"))
    own = ["session_id", "day"]
    step = lambda now, action: [moves[action][s] for s in now] if action in moves else now
    days = coded.repartition(*own).sortWithinPartitions(*own, "ts", "event_id").mapInArrow(_folded(own, "action", step), "session_id long, day date, to array<int>, n long")
    then = lambda now, to: [to[s] for s in now]
    whole = days.repartition("session_id").sortWithinPartitions(*own).mapInArrow(_folded(["session_id"], "to", then), "session_id long, to array<int>, n long")
    status = F.element_at(F.array(*[F.lit(s) for s in STATES]), F.get("to", F.lit(0)) + 1)
    return whole.select("session_id", status.alias("status"), F.col("n").alias("events"))


def idle_sweep(sessions: DataFrame, as_of, idle_minutes: int = 240) -> DataFrame:
    """Open sessions unchanged for too long lose their raw fields and get a note."""
    idle = (F.col("status") == "open") & (F.unix_timestamp("updated_at") < F.unix_timestamp(as_of) - idle_minutes * 60)
    return sessions.withColumn("raw", F.when(~idle, F.col("raw"))).withColumn("note", F.when(idle, "raw fields removed after inactivity"))


# Ledger ---------------------------------------------------------------------------------------------------------------------
def _complete(spark: SparkSession, folder: str) -> bool:
    """Whether a table was written to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def _heads_after(spark: SparkSession, path: str, number: int, chain: list[str], schema: StructType) -> DataFrame:
    """Every chain's last hash and time after the batch of this number.

    Where the batch's blocks were written and its heads were not (the writer died between the two), they
    are made from the blocks and the heads before.
    """
    if number < 0:
        return spark.createDataFrame([], schema)
    heads = f"{path}-heads/batch={number}"
    if _complete(spark, heads):
        return spark.read.schema(schema).parquet(heads)
    if not _complete(spark, f"{path}/batch={number}"):
        raise ValueError(f"{path} has no batch {number}: a stream with a new checkpoint goes on with first={number} or less, as batches there are")
    own = spark.read.parquet(f"{path}/batch={number}").groupBy(*chain).agg(F.max_by(F.struct(F.col("ledger_hash").alias("head"), F.col("closed_at").alias("last")), "closed_at").alias("new"))
    before = _heads_after(spark, path, number - 1, chain, schema)
    return before.join(own, chain, "full_outer").select(*chain, F.coalesce("new.head", "head").alias("head"), F.coalesce("new.last", "last").alias("last"))


def append_blocks(path: str, chain: list[str], order: list[str], ts: str, payload: Callable[[], Column], first: int = 0):
    """A foreachBatch sink: each batch's rows in order, closed and hashed behind the chains' heads.

    A head is a chain's last hash and last close time.  Rows close at ``ts``, or a second after the row
    before where they are not later (``closed_at``), late ones too; ``payload`` is made of the row with
    that time.  One writer per ledger.  A batch is written under its own number, first its blocks, then
    its heads, each complete or not there: a replayed batch replaces itself, and heads that a crash
    between the two left out are made up from the blocks.  Only the part of the batch before is read,
    however long the ledger is.  A stream with a new checkpoint numbers from 0 again: ``first`` is
    added to its numbers.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark, number = batch.sparkSession, number + first
        if number == 0 and _complete(spark, f"{path}/batch=1"):
            raise ValueError(f"{path} is the ledger of another stream: go on behind it with first=...")
        schema = batch.select(*chain, F.lit("").alias("head"), F.lit(None).cast("timestamp").alias("last")).schema
        heads = _heads_after(spark, path, number - 1, chain, schema)
        closed = monotone_close(batch.join(heads, chain, "left"), chain, order, ts, "last").withColumnRenamed("closed_monotone", "closed_at")
        rows = closed.withColumn("payload", payload()).select(*chain, *order, "closed_at", "payload", "head")
        chained(rows, chain, ["closed_at"], "head").select(*chain, *order, "closed_at", "payload", "previous_hash", "ledger_hash").write.mode("overwrite").parquet(f"{path}/batch={number}")
        written = spark.read.parquet(f"{path}/batch={number}").groupBy(*chain).agg(F.max_by(F.struct(F.col("ledger_hash").alias("head"), F.col("closed_at").alias("last")), "closed_at").alias("new"))
        after = heads.join(written, chain, "full_outer").select(*chain, F.coalesce("new.head", "head").alias("head"), F.coalesce("new.last", "last").alias("last"))
        after.write.mode("overwrite").parquet(f"{path}-heads/batch={number}")

    return sink
