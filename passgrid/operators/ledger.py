"""Hash-chained ledger: build, verify, Merkle roots, anchors, exports."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passgrid.functions.seals import chain_hash, csv_line, hmac_sha256, utc_text

LEAVES = 1024
EMPTY = "EMPTY_MERKLE_TREE"


def report_payload() -> Column:
    return F.concat_ws(":", "file_hash", "verdict", F.col("risk_score").cast("string"), utc_text(F.col("created_at")), F.coalesce("screener", F.lit("unknown")))


def session_payload(blocks: Column) -> Column:
    """Canonical text of a session: hashes, verdicts and times, never raw values."""
    c = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(""))
    return F.concat_ws("|", c("session_id"), c("checkpoint"), c("screener"), c("verdict"), F.coalesce("risk_score", F.lit(0)).cast("string"), F.array_join(F.array_sort(blocks), ":"), c("comparison_verdict"), utc_text(F.col("closed_at")))


def chained(rows: DataFrame, chain: list[str], order: list[str], head: str | None = None) -> DataFrame:
    """Rows (with ``payload``) of each chain in order, with ``position``, ``previous_hash`` and ``ledger_hash``.

    A chain is sequential by nature: its rows are sorted in one partition and hashed as they pass,
    nothing of it is held.  ``head`` is a column with the hash that a chain goes on from.
    """
    mark = F.concat_ws("\x01", *[F.col(c).cast("string") for c in chain]).alias("__chain")
    start = F.coalesce(F.col(head), F.lit("GENESIS")) if head else F.lit("GENESIS")
    sorted_ = rows.select(*[c for c in rows.columns if c != head], start.alias("__start"), mark).repartition(*chain).sortWithinPartitions(*chain, *order)
    schema = rows.select(*[c for c in rows.columns if c != head], F.lit(0).alias("position"), F.lit("").alias("previous_hash"), F.lit("").alias("ledger_hash")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place, last = None, 0, ""
        for batch in batches:
            places, before, after = [], [], []
            for mark, start, payload in zip(batch.column("__chain").to_pylist(), batch.column("__start").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if mark != now:
                    now, place, last = mark, 0, start
                before.append(last)
                last = hashlib.sha256(f"{last}:{payload or ''}".encode()).hexdigest()
                places.append(place)
                after.append(last)
                place += 1
            own = [batch.column(n) for n in schema.names[:-3]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(places, pa.int32()), pa.array(before, pa.string()), pa.array(after, pa.string())], names=schema.names)

    return sorted_.mapInArrow(run, schema)


def build_chain(df: DataFrame, chain: list[str], order: list[str], payload: Column) -> DataFrame:
    """Blocks of each chain in order, with ``previous_hash`` and ``ledger_hash``.

    Chains are kept to a stretch (a checkpoint's month), so that they spread over tasks, and are tied
    together by a Merkle root over their heads.
    """
    blocks = chained(df.select(*chain, *order, payload.alias("payload")), chain, order)
    return blocks.select(*chain, "position", *order, "payload", "previous_hash", "ledger_hash")


def verify_chain(blocks: DataFrame, chain: list[str]) -> DataFrame:
    """Per chain: blocks, position and reason of the first break, status.  Every block is checked on its own."""
    w = W.partitionBy(*chain).orderBy("position")
    expected = F.coalesce(F.lag("ledger_hash").over(w), F.lit("GENESIS"))
    reason = F.when(F.col("previous_hash") != expected, "PARENT_MISMATCH").when(F.col("ledger_hash") != chain_hash(F.col("previous_hash"), F.col("payload")), "PAYLOAD_MISMATCH")
    checked = blocks.withColumn("reason", reason)
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct("position", "reason")))
    out = checked.groupBy(*chain).agg(F.count("*").alias("blocks"), first.alias("first"), F.max_by("ledger_hash", "position").alias("head"))
    return out.select(*chain, "blocks", F.col("first.position").alias("broken_at"), F.col("first.reason").alias("reason"), F.when(F.col("first").isNull(), "INTACT").otherwise("BROKEN").alias("status"), "head")


def _level(nodes: Column) -> Column:
    """Pairs of neighbours hashed; an odd last node is paired with itself."""
    n = F.size(nodes)
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 2).cast("int")), lambda i: F.sha2(F.concat_ws(":", F.element_at(nodes, i * 2 + 1), F.coalesce(F.try_element_at(nodes, i * 2 + 2), F.element_at(nodes, i * 2 + 1))), 256))


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list[str]) -> DataFrame:
    """Rows with ``place`` (from 0) and ``total`` within their key, in order, the first of which the bucket rises with.

    Numbers run within a key's buckets and are moved by the buckets before, so a key may hold any part of the rows.
    """
    rows = df.withColumn("__bucket", bucket)
    sizes = rows.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    over = W.partitionBy(*keys)
    before = sizes.select(*keys, "__bucket", F.coalesce(F.sum("__n").over(over.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(over).alias("total"))
    run = F.row_number().over(W.partitionBy(*keys, "__bucket").orderBy(*order)) - 1
    return rows.withColumn("__run", run).join(before, [*keys, "__bucket"]).withColumn("place", F.col("__run") + F.col("__before")).drop("__run", "__before", "__bucket")


def merkle_roots(df: DataFrame, keys: list[str], leaf: str, order: list[str], bucket: Column | None = None) -> DataFrame:
    """The Merkle root over each key's leaves in order.

    Ten levels at a time: aligned stretches of 1,024 nodes are folded where they lie, so a tree of
    n leaves takes a shuffle per factor of 1,024 and no group is larger than that.  ``bucket`` (a day, say)
    cuts the numbering of a key's leaves; it must rise with the order.
    """
    leaves = numbered(df.where(F.col(leaf).isNotNull() & (F.col(leaf) != "")), keys, F.lit(0) if bucket is None else bucket, order)
    now = leaves.select(*keys, F.col("place").alias("i"), F.col(leaf).alias("h"), F.ceil(F.log2("total")).cast("int").alias("levels"))
    most = now.agg(F.max("levels")).first()[0] or 0
    for _ in range(max(1, -(-most // 10))):
        nodes = now.groupBy(*keys, "levels", F.floor(F.col("i") / LEAVES).alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]).alias("a"))
        for step in range(10):
            nodes = nodes.withColumn("a", F.when(F.col("levels") > step, _level(F.col("a"))).otherwise(F.col("a")))
        now = nodes.select(*keys, F.col("g").alias("i"), F.element_at("a", 1).alias("h"), F.greatest(F.col("levels") - 10, F.lit(0)).alias("levels"))
    return now.select(*keys, F.col("h").alias("root"))


def anchor(blocks: DataFrame, chain: list[str], key: bytes) -> DataFrame:
    """Head hash, number of blocks and seal of every chain."""
    head = blocks.groupBy(*chain).agg(F.max_by("ledger_hash", "position").alias("head"), F.count("*").alias("n_blocks"))
    return head.withColumn("seal", hmac_sha256(key, F.concat_ws("|", F.col("head"), F.col("n_blocks").cast("string"))))


def anchor_drift(now: DataFrame, anchored: DataFrame, chain: list[str]) -> DataFrame:
    """IN_SYNC, DRIFT_DETECTED or UNANCHORED per chain."""
    last = anchored.select(*chain, F.col("head").alias("anchored_head"))
    state = F.when(F.col("anchored_head").isNull(), "UNANCHORED").when(F.col("anchored_head") == F.col("head"), "IN_SYNC").otherwise("DRIFT_DETECTED")
    return now.join(last, chain, "left").withColumn("state", state)


def monotone_close(df: DataFrame, chain: list[str], order: list[str], ts: str, last: str | None = None) -> DataFrame:
    """Close times moved on to at least a second after the one before: max over (t - row) plus row.

    Numbers and maxima run within days and are moved by the days before, so a chain may hold any part of the rows.
    Days rise in ``order``.  ``last`` is a column with the close time that a chain goes on from (null: none).
    """
    day = F.to_date(F.col(ts))
    rows = numbered(df, chain, day, order).withColumn("__n", F.col("place") + 1).withColumn("__t", F.unix_timestamp(ts)).withColumn("__day", day)
    most = rows.groupBy(*chain, "__day").agg(F.max(F.col("__t") - F.col("__n")).alias("__most"))
    before = most.select(*chain, "__day", F.max("__most").over(W.partitionBy(*chain).orderBy("__day").rowsBetween(W.unboundedPreceding, -1)).alias("__before"))
    run = F.max(F.col("__t") - F.col("__n")).over(W.partitionBy(*chain, "__day").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    least = [F.unix_timestamp(last)] if last else []
    moved = rows.withColumn("__run", run).join(before, [*chain, "__day"]).withColumn("closed_monotone", F.timestamp_seconds(F.greatest("__run", "__before", *least) + F.col("__n")))
    return moved.select(*df.columns, "closed_monotone")


def running_index(df: DataFrame, bucket: str, order: list[str]) -> DataFrame:
    """A running number over all rows by (bucket, order): numbers within buckets, moved by the buckets before.

    Only the table of buckets (days) is summed in one place, the rows stay partitioned.
    """
    before = df.groupBy(bucket).agg(F.count("*").alias("n")).select(bucket, F.coalesce(F.sum("n").over(W.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    numbered = df.withColumn("__place", F.row_number().over(W.partitionBy(bucket).orderBy(*order)))
    return numbered.join(before, bucket).withColumn("index", F.col("__place") + F.col("__before")).drop("__place", "__before")


def export_digests(df: DataFrame, day: Column, columns: list[str], order: list[str]) -> DataFrame:
    """Per day the number of exported lines and the digest of their body, in order; lines are digested as they pass."""
    lines = df.select(day.alias("day"), *order, csv_line([F.col(c) for c in columns]).alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, body = None, 0, hashlib.sha256()
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([n], pa.int64()), pa.array([body.hexdigest()], pa.string())], names=["day", "n_lines", "digest"])
        for batch in batches:
            for day, line in zip(batch.column("day").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if day != now or not n:
                    if n:
                        yield row()
                    now, n, body = day, 0, hashlib.sha256()
                body.update((("\n" if n else "") + line).encode())
                n += 1
        if n:
            yield row()

    return lines.repartition("day").sortWithinPartitions("day", *order).mapInArrow(run, "day string, n_lines long, digest string")


def write_export(df: DataFrame, path: str, columns: list[str]) -> None:
    """The export's lines as text files, cells made safe."""
    df.select(csv_line([F.col(c) for c in columns]).alias("value")).write.mode("errorifexists").text(path)


def handover_packets(docs: DataFrame, keys: list[str], key: bytes) -> DataFrame:
    """Per session its sorted document hashes, as JSON with a seal."""
    packet = docs.groupBy(*keys).agg(F.array_sort(F.collect_list("file_hash")).alias("hashes"))
    sealed = packet.withColumn("seal", hmac_sha256(key, F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.array_join("hashes", ","))))
    return sealed.select(*keys, F.to_json("hashes").alias("hashes"), "seal")
