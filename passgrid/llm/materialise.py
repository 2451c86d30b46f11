"""Token-ID output in training order (operator 7).

Documents become a stream of token ids per input split, cut into sequences of a fixed length.
A keyed Feistel network over the sequences' global numbers, with cycle-walking to stay below
their count, is the training order: every sequence has its slot before anything is moved, and a
restart needs the key and a slot alone.  Sequences are partitioned by slot range, a run of
consecutive shards a task, and each shard is written with equal strides, so slot ``s`` lies in shard ``s // per_shard`` at byte
``(s % per_shard) * stride``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passgrid.llm.common import col, run_dir, staged
from passgrid.llm.wordpieces import word_tokenizer

SEQUENCE_SCHEMA = "part long, place long, first_doc_id long, last_doc_id long, n_tokens int, ids binary"
ROUNDS = 6
#: Consecutive shards of a task at most.
RUN = 16


def feistel(numbers: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..size-1, number by number.

    Two halves of equal width cover the numbers below the least power of four that is >= size;
    what falls outside size is sent through again until it falls inside (cycle-walking).
    """
    half = np.uint64(max(1, ((max(size, 2) - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = np.random.default_rng(key).integers(0, 2**63, ROUNDS, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            mixed = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        return (left << half) | right

    out = once(numbers.astype(np.uint64))
    while (outside := out >= np.uint64(size)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _sequences(tokenizer: str, end_id: int, length: int, dtype: str):
    width = length * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = word_tokenizer(tokenizer), end_id.to_bytes(4, "little")
        part, place = TaskContext.get().partitionId(), 0
        rest, owners = b"", []  # ids left over, and (doc_id, bytes of it that are left)

        def take(n: int) -> tuple[int | None, int | None]:
            first = last = owners[0][0]
            while n > 0:
                last, size = owners[0]
                if size > n:
                    owners[0] = (last, size - n)
                    n = 0
                else:
                    owners.pop(0)
                    n -= size
            return first, last

        def row(ids: bytes) -> tuple:
            nonlocal place
            a = np.frombuffer(ids, "<u4")
            first, last = take(len(ids))
            place += 1
            return part, place - 1, first, last, len(a), a.astype(dtype).tobytes()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            names = ["part", "place", "first_doc_id", "last_doc_id", "n_tokens", "ids"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            rows, streams = [], [rest]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = own.ids(text or "") + end
                streams.append(ids)
                owners.append((doc_id, len(ids)))
            stream = b"".join(streams)
            whole = len(stream) // width * width
            rows = [row(stream[at : at + width]) for at in range(0, whole, width)]
            rest = stream[whole:]
            if rows:
                yield batch_of(rows)
        if rest:
            yield batch_of([row(rest)])

    return run


CHUNK_SCHEMA = "shard long, slots array<long>, n_tokens array<int>, first_doc_ids array<long>, last_doc_ids array<long>, data binary"


def _slots(size: int, key: int, bases: dict[int, int], per_shard: int, stride: int):
    """Sequences with their slots, those of a batch that go to one shard as one compressed row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = np.array([bases[p] for p in batch.column("part").to_pylist()], np.int64)
            slots = feistel(base + batch.column("place").to_numpy(), size, key)
            columns = [np.array(batch.column(n).to_pylist(), object) for n in ("n_tokens", "first_doc_id", "last_doc_id", "ids")]
            order = slots.argsort()
            cuts = np.nonzero(np.diff(slots[order] // per_shard))[0] + 1
            rows = []
            for some in np.split(order, cuts) if len(order) else []:
                n, first, last, ids = (c[some] for c in columns)
                data = b"".join([x.ljust(stride, b"\0") for x in ids])
                rows.append((int(slots[some[0]] // per_shard), slots[some].tolist(), n.tolist(), first.tolist(), last.tolist(), zstandard.compress(data, 3)))
            longs = pa.list_(pa.int64())
            types = [pa.int64(), longs, pa.list_(pa.int32()), longs, longs, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[x.split()[0] for x in CHUNK_SCHEMA.split(", ")])

    return run


def _write_shards(path: str, per_shard: int, stride: int, length: int):
    """Rows come sorted by shard; a shard (per_shard strides) is put in order, written, and named when whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        attempt = TaskContext.get().taskAttemptId()
        held: list[dict] = []

        def shard() -> pa.RecordBatch:
            number = held[0]["shard"]
            flat = [np.array([x for row in held for x in row[n]], object) for n in ("slots", "n_tokens", "first_doc_ids", "last_doc_ids")]
            data = np.concatenate([np.frombuffer(zstandard.decompress(row["data"]), np.uint8).reshape(-1, stride) for row in held])
            order = flat[0].astype(np.int64).argsort()
            slots, n, first, last = (c[order] for c in flat)
            temporary = f"{root}/_writing-{number:09d}-{attempt}"
            crcs, width = [], stride // length
            with store.open_output_stream(temporary) as out:
                for i, k in zip(order, n, strict=True):
                    out.write(data[i].tobytes())
                    crcs.append(zlib.crc32(data[i, : k * width].tobytes()))
            final = f"{root}/shard-{number:09d}.bin"
            if store.get_file_info(final).type == fs.FileType.NotFound:
                store.move(temporary, final)
            else:  # an attempt before this one came this far: its bytes are the same
                store.delete_file(temporary)
            slots = slots.astype(np.int64)
            names = ["slot", "shard", "byte_offset", "n_tokens", "first_doc_id", "last_doc_id", "ids_crc32"]
            return pa.RecordBatch.from_arrays(
                [pa.array(slots), pa.array(slots // per_shard), pa.array(slots % per_shard * stride), pa.array(list(n), pa.int32()), pa.array(list(first), pa.int64()), pa.array(list(last), pa.int64()), pa.array(crcs, pa.int64())], names=names
            )

        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["shard"] != row["shard"]:
                    yield shard()
                    held.clear()
                held.append(row)
        if held:
            yield shard()

    return run


OUTPUT_SCHEMA = "slot long, shard long, byte_offset long, n_tokens int, first_doc_id long, last_doc_id long, ids_crc32 long"


def materialise(
    docs: DataFrame,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 2048,
    key: int = 20240229,
    per_shard: int = 8192,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 1,
    dtype: str = "<u2",
) -> DataFrame:
    """Write all documents' token ids as shuffled fixed-stride shards under ``path``.

    A document is its ids and ``end_id``; sequences of ``length`` tokens run across documents of
    one input split, and only a split's last sequence is shorter (its stride is zero-filled).
    Returns one row per sequence: slot (0..n-1, each once), shard, byte_offset, n_tokens,
    first_doc_id, last_doc_id, ids_crc32 (of the stored ids).  Null texts count as empty, null ids
    and repeated rows are kept, an empty table writes a manifest of no sequences and gives no rows,
    other columns are ignored.  A ``dtype`` that can not hold the vocabulary and ``end_id`` is refused
    ("<u2" holds 65,536 ids).  Only one count per input split reaches the driver.  A shard is named
    when whole; a repeated task leaves a shard that is there already, whose bytes are the same.
    """
    spark = docs.sparkSession
    if max(word_tokenizer(tokenizer).library.get_vocab_size() - 1, end_id) > np.iinfo(dtype).max:
        raise ValueError(f"{dtype} does not hold the ids of {tokenizer}")
    path = path or run_dir(spark, "token-shards")
    sequences = staged(
        docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(_sequences(tokenizer, end_id, length, dtype), SEQUENCE_SCHEMA),
        "sequences",
    )
    counts = sorted((r["part"], r["n"]) for r in sequences.groupBy("part").agg(F.count("*").alias("n")).collect())
    size, bases = 0, {}
    for part, n in counts:
        bases[part], size = size, size + n
    stride = length * np.dtype(dtype).itemsize
    placed = sequences.mapInArrow(_slots(size, key, bases, per_shard, stride), CHUNK_SCHEMA)
    shards = -(-size // per_shard)
    run = max(1, min(RUN, shards // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ranges = placed.repartitionById(max(1, -(-shards // run)), F.floor(F.col("shard") / run).cast("int")).sortWithinPartitions("shard")
    spark.createDataFrame([(size, length, stride, per_shard, dtype, key)], "sequences long, length long, stride long, per_shard long, dtype string, key long").coalesce(1).write.json(f"{path}/manifest")
    return staged(ranges.mapInArrow(_write_shards(path, per_shard, stride, length), OUTPUT_SCHEMA), "shard-index")


def read_slots(spark: SparkSession, path: str, first: int = 0, count: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Sequences in training order from slot ``first`` on, a shard open at a time (a trainer's loop, no job)."""
    about = spark.read.json(f"{path}/manifest").first()
    store, root = fs.FileSystem.from_uri(path)
    last = about["sequences"] if count is None else min(about["sequences"], first + count)
    slot = first
    while slot < last:
        shard = slot // about["per_shard"]
        with store.open_input_file(f"{root}/shard-{shard:09d}.bin") as f:
            f.seek(slot % about["per_shard"] * about["stride"])
            while slot < last and slot // about["per_shard"] == shard:
                yield slot, np.frombuffer(f.read(about["stride"]), about["dtype"])
                slot += 1
