"""Streams over files, drained and held against their batch forms."""

import datetime
import hashlib
import shutil

import pytest
from pyspark.sql import functions as F

from passgrid.functions.seals import chain_hash, utc_text
from passgrid.operators import ledger
from passgrid.plans.streams import session_events
from passgrid.sources import views
from passgrid.streaming import jobs


def drained(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def as_stream(spark, df, folder, files=4):
    """The rows in time order as files of a stream."""
    df = df.persist()
    for i in range(files):
        df.where(F.pmod(F.floor(F.unix_timestamp(df.columns[1]) / 86400), F.lit(files)) == i).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def test_windows(spark, small, tmp_path):
    e = views.event_reports(spark, small).where("id < 400")
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    want = {tuple(r) for r in jobs.throughput(e, "created_at").collect()}
    assert {tuple(r) for r in drained(jobs.throughput(stream, "created_at"), "t2", "update").collect()} == want
    want = {tuple(r) for r in jobs.bursts(e, "created_at", "checkpoint", F.lit(True), 2).collect()}
    assert {tuple(r) for r in drained(jobs.bursts(stream, "created_at", "checkpoint", F.lit(True), 2), "t3", "update").collect()} == want and want


def test_intake_drops_replays(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t, "a"), (2, t + datetime.timedelta(seconds=5), "a"), (3, t, "b")], "id int, ts timestamp, k string")
    df.coalesce(1).write.parquet(str(tmp_path / "i"))
    got = drained(jobs.intake(spark.readStream.schema(df.schema).parquet(str(tmp_path / "i")), ["k"], "ts"), "t1")
    assert sorted(r.k for r in got.collect()) == ["a", "b"]
    assert sorted(r.id for r in jobs.intake_batch(df, ["k"], "ts", "id").collect()) == [1, 3]


def test_a_replay_of_a_replay_passes_in_time(spark, tmp_path):
    """At 0, 50 and 100 seconds: the third is more than a minute after the first, which is the last that passed."""
    t = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, t + datetime.timedelta(seconds=s), k) for i, (s, k) in enumerate([(0, "a"), (50, "a"), (100, "a"), (160, "a"), (161, "a"), (10, "b")])], "id int, ts timestamp, k string")
    df.coalesce(1).write.parquet(str(tmp_path / "i"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "i"))
    assert sorted(r.id for r in jobs.intake_batch(df, ["k"], "ts", "id").collect()) == [0, 2, 4, 5]
    assert sorted(r.id for r in drained(jobs.intake(stream, ["k"], "ts"), "t1_chain").collect()) == [0, 2, 4, 5]


def test_watchlist_and_recidivism(spark, small, tmp_path):
    e = views.event_reports(spark, small).where("id < 300")
    e.coalesce(1).write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "w"))
    wl = e.where("id % 50 = 0").select("identifier_hash", F.lit("x").alias("category")).distinct()
    assert drained(jobs.watchlist_hits(stream, wl), "t5").count() == jobs.watchlist_hits(e, wl).count() > 0
    cols = ["id", "prior_checkpoint", "prior_id"]
    want = {tuple(r) for r in jobs.recidivism_batch(e).select(*cols).collect()}
    assert {tuple(r) for r in drained(jobs.recidivism(stream), "t4").select(*cols).collect()} == want and want


def test_lifecycle(spark, small, tmp_path):
    e = session_events(spark, small)
    e.coalesce(1).write.parquet(str(tmp_path / "l"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "l"))
    want = {tuple(r) for r in jobs.lifecycle_batch(e).collect()}
    got = drained(jobs.lifecycle(stream), "t7", "update").groupBy("session_id").agg(F.max_by("status", "events").alias("status"), F.max("events").alias("events"))
    assert {r[0]: r[2] for r in got.collect()} == {r[0]: r[2] for r in want}
    assert {tuple(r) for r in got.collect() if r.status != "closed"} <= want


def payload():
    return F.concat_ws(":", "seq", utc_text(F.col("closed_at")))


def closed_chain(rows):
    """(seq, closed_at, hash) of rows (chain, time, seq) in the order they are given: by hand."""
    heads, out = {}, set()
    for chain, t, seq in rows:
        last, head = heads.get(chain, (None, "GENESIS"))
        t = t.replace(microsecond=0) if last is None or t > last else last + datetime.timedelta(seconds=1)
        head = hashlib.sha256(f"{head}:{seq}:{t:%Y-%m-%d %H:%M:%S} UTC".encode()).hexdigest()
        heads[chain] = t, head
        out.add((seq, t, head))
    return out


def test_ledger_append(spark, small, tmp_path):
    """Chains of two batches are those of all rows at once: monotone close times, then the build."""
    r = views.reports(spark, small).select("checkpoint", F.date_trunc("hour", "created_at").alias("created_at"), "seq")
    path = str(tmp_path / "ledger")
    sink = jobs.append_blocks(path, ["checkpoint"], ["created_at", "seq"], "created_at", payload)
    middle = r.agg(F.percentile(F.unix_timestamp("created_at"), F.lit(0.5))).first()[0]
    sink(r.where(F.unix_timestamp("created_at") < middle), 0)
    for _ in range(2):  # a replayed batch replaces itself
        sink(r.where(F.unix_timestamp("created_at") >= middle), 1)
    blocks = spark.read.parquet(path)
    assert blocks.count() == r.count() and blocks.where(chain_hash(F.col("previous_hash"), F.col("payload")) != F.col("ledger_hash")).count() == 0
    closed = ledger.monotone_close(r, ["checkpoint"], ["created_at", "seq"], "created_at").withColumnRenamed("closed_monotone", "closed_at")
    want = {(b.seq, b.ledger_hash) for b in ledger.build_chain(closed.withColumn("payload", payload()), ["checkpoint"], ["closed_at", "seq"], F.col("payload")).collect()}
    assert {(b.seq, b.ledger_hash) for b in blocks.collect()} == want
    assert {(b.seq, b.closed_at, b.ledger_hash) for b in blocks.collect()} == closed_chain([tuple(x) for x in r.orderBy("created_at", "seq").collect()])


def test_ledger_survives_a_crash_between_its_writes(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    at = lambda s: t + datetime.timedelta(seconds=s)
    batches = [[("a", at(10), 1), ("a", at(10), 2), ("b", at(50), 3)], [("a", at(5), 4), ("a", at(11), 5)], [("b", at(49), 6), ("a", at(100), 7), ("c", at(1), 8)]]
    schema, path = "chain string, at timestamp, seq long", str(tmp_path / "ledger")
    sink = jobs.append_blocks(path, ["chain"], ["at", "seq"], "at", payload)
    put = lambda n: sink(spark.createDataFrame(batches[n], schema), n)
    want = closed_chain([r for b in batches for r in sorted(b, key=lambda x: (x[1], x[2]))])
    put(0)
    put(1)
    shutil.rmtree(f"{path}-heads/batch=1")  # the writer died before the heads of batch 1
    put(2)
    read = lambda p: {(b.seq, b.closed_at, b.ledger_hash) for b in spark.read.parquet(p).collect()}
    assert read(path) == want
    put(2)
    assert read(path) == want
    with pytest.raises(ValueError, match="another stream"):
        put(0)
    again = jobs.append_blocks(path, ["chain"], ["at", "seq"], "at", payload, first=3)
    again(spark.createDataFrame([("a", at(7), 9)], schema), 0)
    assert read(path) == closed_chain([*[r for b in batches for r in sorted(b, key=lambda x: (x[1], x[2]))], ("a", at(7), 9)])
    with pytest.raises(ValueError, match="no batch 9"):
        jobs.append_blocks(path, ["chain"], ["at", "seq"], "at", payload, first=10)(spark.createDataFrame([("a", at(7), 10)], schema), 0)


def test_a_killed_stream_goes_on(spark, tmp_path):
    """The query dies between the blocks and the heads of a batch, and is started again from its checkpoint."""
    t = datetime.datetime(2024, 1, 1)
    rows = [("ab"[i % 2], t + datetime.timedelta(seconds=i // 3), i) for i in range(30)]
    schema, folder, path = "chain string, at timestamp, seq long", str(tmp_path / "in"), str(tmp_path / "ledger")
    for i in range(3):
        spark.createDataFrame(rows[10 * i : 10 * i + 10], schema).coalesce(1).write.parquet(f"{folder}/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    sink = jobs.append_blocks(path, ["chain"], ["at", "seq"], "at", payload)
    deaths = []

    def dying(batch, number):
        sink(batch, number)
        if number == 1 and not deaths:
            shutil.rmtree(f"{path}-heads/batch=1")
            deaths.append(number)
            raise RuntimeError("killed")

    run = lambda: stream.writeStream.foreachBatch(dying).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    with pytest.raises(Exception, match="killed"):
        run()
    run()
    assert {(b.seq, b.closed_at, b.ledger_hash) for b in spark.read.parquet(path).collect()} == closed_chain(rows) and deaths


def test_stretches_of_a_hot_key(spark):
    """One key holds nearly all rows: it is cut at its gaps, and the answer is that of one pass."""
    t = datetime.datetime(2024, 1, 1)
    times = [(i, t + datetime.timedelta(seconds=17 * i + 200 * (i // 40) + 7000 * (i // 900)), "hot") for i in range(3000)] + [(10_000 + i, t + datetime.timedelta(seconds=70 * i), None) for i in range(5)] + [(20_000, None, "hot")]
    df = spark.createDataFrame(times, "id int, ts timestamp, k string")
    last, want = None, []
    for i, s, k in times[:3000]:
        if last is None or (s - last).total_seconds() > 60:
            want.append(i)
            last = s
    assert sorted(r.id for r in jobs.intake_batch(df, ["k"], "ts", "id").collect()) == sorted(want + [10_000 + i for i in range(5)])
    cut = jobs.stretches(df.where("ts IS NOT NULL").withColumn("__t", F.unix_timestamp("ts")), ["k"], 60, 640)
    assert cut.where("k = 'hot'").groupBy("__stretch").count().agg(F.max("count")).first()[0] == 40
