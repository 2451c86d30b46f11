"""Best-fit packing by minimum bin slack (operator 6).

Documents become token sequences' pieces once; what the packing needs is only how many pieces
there are of each length, a table of at most ``capacity`` rows however large the corpus.  Per
bin, a bitset subset-sum dynamic programme over the available lengths finds the fullest
combination that holds the longest piece left; it is removed as often as its lengths last.  The
plan (a run of equal bins per step, at most one step per exhausted length) is then joined to the
pieces, which are numbered within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passgrid.llm.common import col, staged
from passgrid.llm.wordpieces import word_tokenizer

PIECE_SCHEMA = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(tokenizer: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = word_tokenizer(tokenizer), end_id.to_bytes(4, "little")
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = own.ids(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (row, doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
                    row += 1
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to ``room``: length -> how often.

    Bit s of ``reach`` says that s can be summed; multiplicities enter as 1, 2, 4, ... copies.
    """
    reach, mask, layers = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in available if x <= room), reverse=True):
        left, copies = min(available[length], room // length), 1
        while left:
            copies = min(copies, left)
            layers.append((reach, length, copies))
            reach |= (reach << (length * copies)) & mask
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for before, length, copies in reversed(layers):
        if not before >> total & 1:
            total -= length * copies
            used[length] = used.get(length, 0) + copies
    return used


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Bins as (how many equal bins, {length: pieces of it in each})."""
    left, plan = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        bin_ = fullest({k: v for k, v in rest.items() if v}, capacity - longest)
        bin_[longest] = bin_.get(longest, 0) + 1
        times = min(left[k] // n for k, n in bin_.items())
        for k, n in bin_.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        plan.append((times, bin_))
    return plan


def _slots(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, end number, pieces per bin, first sequence, first offset) for every run."""
    slots, sequence, next_number = [], 0, {}
    for times, bin_ in plan:
        offset = 0
        for length in sorted(bin_, reverse=True):
            n, first = bin_[length], next_number.get(length, 0)
            slots.append((length, first, first + n * times, n, sequence, offset))
            next_number[length] = first + n * times
            offset += n * length
        sequence += times
    return slots


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens, as few as the method finds.

    A document is its ids and then ``end_id``; only a longer one is cut.  Returns one row per
    piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  A null text is packed as
    an empty one (one token); null ids and repeated rows are packed row by row; an empty table
    gives no rows; other columns are ignored.  Only the histogram of lengths (at most ``capacity``
    rows) and the plan made from it reach the driver.
    """
    spark = docs.sparkSession
    pieces = staged(
        docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(_pieces(tokenizer, end_id, capacity), PIECE_SCHEMA),
        "pieces",
    )
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = spark.createDataFrame(
        _slots(minimum_bin_slack(counts, capacity)), "slot_length long, first long, end long, per_bin long, first_sequence long, first_offset long"
    )
    # Number the pieces of a length: by shares of its rows, so that one length may hold any part of the table.
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("share", F.pmod(F.xxhash64("row"), F.lit(shares)))
    by_share = pieces.groupBy("length", "share").agg(F.count("*").alias("n"))
    before = by_share.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = (
        pieces.withColumn("place", F.row_number().over(Window.partitionBy("length", "share").orderBy("row")) - 1)
        .join(before.select("length", "share", F.coalesce("before", F.lit(0)).alias("before")), ["length", "share"])
        .withColumn("number", F.col("place") + F.col("before"))
    )
    # The slots are bounded by capacity: a step per exhausted length, and few lengths a step.
    found = numbered.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("end")))
    in_run = F.col("number") - F.col("first")
    return found.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.floor(in_run / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + F.pmod(in_run, F.col("per_bin")) * F.col("length")).cast("long").alias("offset"),
    )
