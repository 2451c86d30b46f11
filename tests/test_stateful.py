"""Rules with state and timers, against their batch forms and hand-made cases."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from passgrid.sources import views
from passgrid.streaming import jobs, stateful

T0 = datetime.datetime(2024, 1, 1)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


@pytest.fixture(autouse=True)
def store(spark):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def files_of(spark, batches, schema, folder):
    """A stream that takes one batch of rows after the other."""
    for i, rows in enumerate(batches):
        df = rows if hasattr(rows, "schema") else spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
        time.sleep(0.02)  # files are taken by their time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def drained(df, name, folder):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", folder).trigger(availableNow=True).start()
    q.awaitTermination(150)
    return df.sparkSession.table(name)


REPORTS = "identifier_hash string, id long, checkpoint string, created_at timestamp"
SESSIONS = "session_id long, ts timestamp, event_id long, action string, raw string"


def test_recidivism_is_the_batch_answer(spark, small, tmp_path):
    e = views.event_reports(spark, small).where("id < 250").select("identifier_hash", "id", "checkpoint", "created_at")
    late = spark.createDataFrame([("end", 10**6, "x", datetime.datetime(2100, 1, 1))], REPORTS)  # moves the watermark past all others
    by_time = e.orderBy("created_at")
    cut = by_time.collect()[120].created_at
    batches = [by_time.where(F.col("created_at") < cut), by_time.where(F.col("created_at") >= cut), late]
    got = drained(stateful.recidivism(files_of(spark, batches, e.schema, str(tmp_path / "in")), 60 * 24 * 36500), "r_all", str(tmp_path / "ck"))
    cols = ["id", "prior_checkpoint", "prior_id"]
    want = {tuple(r) for r in jobs.recidivism_batch(e).select(*cols).collect()}
    assert {tuple(r) for r in got.select(*cols).collect()} == want and want


def test_late_rows_are_taken_in_order_and_old_ones_expire(spark, tmp_path):
    first = [("h", 1, "A", at(0)), ("h", 3, "B", at(8)), ("g", 9, "A", at(1))]
    second = [("h", 2, "C", at(4)), ("h", 4, "A", at(9))]  # 2 arrives late, within the watermark
    third = [("z", 5, "A", at(60))]
    fourth = [("h", 6, "D", at(100)), ("z", 7, "B", at(61))]  # at 100 only what is younger than 92 minutes counts: 4 (at 9), not 2 and 3
    batches = [first, second, third, fourth, [("end", 99, "x", at(10**5))]]
    got = drained(stateful.recidivism(files_of(spark, batches, REPORTS, str(tmp_path / "in")), 91), "r_old", str(tmp_path / "ck"))
    rows = {(r.id, r.prior_checkpoint, r.prior_id) for r in got.collect()}
    assert rows == {(2, "A", 1), (3, "A", 1), (3, "C", 2), (4, "B", 3), (4, "C", 2), (6, "A", 4), (7, "A", 5)}


def test_live_entries_expire_by_the_clock(spark, tmp_path):
    folder = str(tmp_path / "in")
    put = lambda rows, i: spark.createDataFrame(rows, REPORTS).coalesce(1).write.parquet(f"{folder}/{i}")
    put([("h", 1, "A", at(0))], 0)
    stream = spark.readStream.schema(REPORTS).option("recursiveFileLookup", "true").parquet(folder)
    q = stateful.live_recidivism(stream, 0.25).writeStream.format("memory").queryName("r_live").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    try:
        took = time.time()
        while not (q.lastProgress and q.lastProgress.batchId >= 0 and q.lastProgress.numInputRows == 0) and time.time() - took < 60:
            time.sleep(0.2)
        put([("h", 2, "B", at(1))], 1)
        while spark.table("r_live").count() < 1 and time.time() - took < 90:
            time.sleep(0.2)
        assert [(r.id, r.prior_id) for r in spark.table("r_live").collect()] == [(2, 1)]
        time.sleep(16)
        put([("h", 3, "C", at(2)), ("h", 4, "D", at(3))], 2)
        while spark.table("r_live").count() < 2 and time.time() - took < 150:
            time.sleep(0.2)
        assert sorted((r.id, r.prior_id) for r in spark.table("r_live").collect()) == [(2, 1), (4, 3)]
    finally:
        q.stop()


def brute(events, until, idle):
    """Every session's state at ``until``, from its events in order."""
    out = {}
    for session in {e[0] for e in events}:
        status, n, last, raw, note = "open", 0, None, None, None
        for _, ts, _, action, new in sorted((e for e in events if e[0] == session), key=lambda e: (e[1], e[2])):
            if last is not None and status == "open" and ts - last > datetime.timedelta(minutes=idle):
                raw, note = None, stateful.SWEPT
            status, n, last = jobs.NEXT.get((status, action), status), n + 1, ts
            raw = None if status != "open" else new or raw
        if status == "open" and until - last > datetime.timedelta(minutes=idle):
            raw, note = None, stateful.SWEPT
        out[session] = (status, n, raw, note)
    return out


def test_idle_sessions_are_swept_by_a_timer_and_ended_ones_wiped_at_once(spark, tmp_path):
    actions = ["scan", "scan", "approve", "flag", "clear", "reject", "close"]
    events = [(s, at(s * 3 + 11 * i * (1 + s % 40)), 100 * s + i, actions[(s * i + s) % 7 if i > 1 else 0], f"raw {s} {i}" if (s + i) % 3 else None) for s in range(40) for i in range(5)]
    events.sort(key=lambda e: e[1])
    end = [(-1, at(3000), 10**6, "scan", "x")]
    batches = [events[:70], events[70:71], events[71:], end]
    got = drained(stateful.raw_fields(files_of(spark, batches, SESSIONS, str(tmp_path / "in")), 240, "30 minutes"), "raw", str(tmp_path / "ck"))
    last = {r.session_id: (r.status, r.events, r.raw, r.note) for r in stateful.last_state(got).collect()}
    want = brute(events, at(3000 - 30), 240)
    assert {k: v for k, v in last.items() if k >= 0} == want
    assert {"open", "approved", "closed"} <= {v[0] for v in want.values()} and any(v[3] for v in want.values())
    # A second row for an old key comes from the timer: as many events, and no raw fields any more.
    some = got.where("note IS NOT NULL AND raw IS NULL").first()
    assert got.where((F.col("session_id") == some.session_id) & (F.col("events") == some.events)).count() >= 2
    assert got.where("status <> 'open' AND raw IS NOT NULL").count() == 0


def test_the_sweep_and_the_wipe_are_the_batch_ones(spark, tmp_path):
    """One event a session: the end state is that of idle_sweep, and of the wipe, over the table."""
    events = [(s, at(60 * s), s, "close" if s % 3 == 0 else "scan", f"raw {s}") for s in range(12)]
    batches = [events, [(-1, at(60 * 12), 99, "scan", None)]]
    got = stateful.last_state(drained(stateful.raw_fields(files_of(spark, batches, SESSIONS, str(tmp_path / "in")), 240, "0 minutes"), "swept", str(tmp_path / "ck"))).where("session_id >= 0")
    table = spark.createDataFrame([(e[0], "closed" if e[3] == "close" else "open", e[1], e[4]) for e in events], "session_id long, status string, updated_at timestamp, raw string")
    sweep = jobs.idle_sweep(table, F.lit(at(60 * 12)).cast("timestamp"), 240).withColumn("raw", F.when(F.col("status") == "open", F.col("raw")))
    assert {tuple(r) for r in got.select("session_id", "status", "raw", "note").collect()} == {tuple(r) for r in sweep.select("session_id", "status", "raw", "note").collect()}
