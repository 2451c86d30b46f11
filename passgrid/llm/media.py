"""Content-addressed media columns in tar shards (operator 10).

Every text becomes a payload of whole pixel rows (64 RGB pixels, 192 bytes) and is stored as a
PNG image named by its digest in the tar shard of the task that met it, once per shard.  Rows
carry digest, shard, offset and length.  Metadata columns come from a range read of the image
header alone; payload columns and the feature come from a full range read of the stored bytes.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passgrid.llm.common import col, run_dir, spread_join, staged

ROW = 192
# The PNG signature and the end chunk.
PNG = b"\x89PNG\r\n\x1a\n"
END = b"\x00\x00\x00\x00IEND\xaeB`\x82"
#: Bytes from the start of an image that hold its signature and header chunk.
HEADER = 33


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (ROW - len(data) if len(data) < ROW else -len(data) % ROW)


def encode_png(payload: bytes) -> bytes:
    """An RGB image, 8 bits a sample, 64 pixels wide; every row unfiltered."""
    rows = len(payload) // ROW
    lines = np.zeros((rows, ROW + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
    return PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW // 3, rows, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + END


def decode_header(data: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits a sample, colour type, from the first bytes alone."""
    if data[:8] != PNG or data[12:16] != b"IHDR" or zlib.crc32(data[12:29]) != struct.unpack(">I", data[29:33])[0]:
        raise ValueError("not the header of a stored image")
    return struct.unpack(">IIBB", data[16:26])


def decode_png(data: bytes) -> bytes:
    width, height, bits, kind = decode_header(data)
    if (width, bits, kind) != (ROW // 3, 8, 2):
        raise ValueError("not an image of this operator")
    at, packed = HEADER, b""
    while (kind := data[at + 4 : at + 8]) != b"IEND":
        size = struct.unpack(">I", data[at : at + 4])[0]
        if kind == b"IDAT":
            packed += data[at + 8 : at + 8 + size]
        at += 12 + size
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, ROW + 1)[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean and deviation of the samples in thousandths and their shares in 16 equal bands, as hex bytes."""
    samples = np.frombuffer(payload, np.uint8)
    bands = np.bincount(samples >> 4, minlength=16) * 255 // len(samples)
    return f"{int(samples.mean() * 1000)}:{int(samples.std() * 1000)}:{bytes(bands.astype(np.uint8).tolist()).hex()}"


INDEX_SCHEMA = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def _store(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        context = TaskContext.get()
        # The attempt is in the name: a repeated task writes its own shard and the index names that one.
        name = f"shard-{context.partitionId():06d}-{context.taskAttemptId()}.tar"
        here: dict[str, tuple[int, int]] = {}
        out, at = None, 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload = payload_of(text)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in here:
                    image = encode_png(payload)
                    member = tarfile.TarInfo(f"{digest}.png")
                    member.size = len(image)
                    head = member.tobuf(tarfile.USTAR_FORMAT)
                    if out is None:
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(f"{root}/{name}")
                    out.write(head + image + bytes(-len(image) % 512))
                    here[digest] = at + len(head), len(image)
                    at += len(head) + len(image) + -len(image) % 512
                offset, length = here[digest]
                rows.append((doc_id, len(text.encode("utf-8", "surrogatepass")) if text else 0, digest, name, offset, length))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[x.split()[0] for x in INDEX_SCHEMA.split(", ")])
        if out is not None:
            out.write(bytes(1024))
            out.close()

    return run


READ_SCHEMA = "digest string, shard string, offset long, length long, width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read(path: str):
    """Rows come sorted by shard and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        name, shard = None, None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["shard"] != name:
                    name, shard = row["shard"], store.open_input_file(f"{root}/{row['shard']}")
                width, height, _, _ = decode_header(shard.read_at(HEADER, row["offset"]))
                image = shard.read_at(row["length"], row["offset"])
                payload = decode_png(image)
                rows.append((*(row[k] for k in ("digest", "shard", "offset", "length")), width, height, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature_of(payload)))
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[x.split()[0] for x in READ_SCHEMA.split(", ")])

    return run


def _stored(docs: DataFrame, path: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their digest, one place a digest)."""
    index = staged(docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(_store(path), INDEX_SCHEMA), "media-index")
    # Minima are partial, so a payload that a third of all rows hold is a row per task here.
    chosen = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")
    return index.select("doc_id", "n_bytes", "digest"), chosen


def store_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text's payload in tar shards under ``path``; one index row per input row.

    Rows: doc_id, n_bytes, digest, shard, offset, length.  A payload that several tasks met is in
    several shards; all its rows name one of them.
    """
    return spread_join(*_stored(docs, path, id_col, text_col), "digest", "doc_id")


def media_columns(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the texts as media and fill columns from the stored bytes.

    Returns one row per input row: doc_id, n_bytes (UTF-8, unpadded), payload_bytes,
    payload_sha256, tail_crc32 (last 16 bytes of the payload), media_bytes, media_sha256 (of the
    stored image), feature, and the location: digest, shard, offset, length, width, height.  Texts
    are padded by blanks to a positive multiple of 192 bytes; a null text is empty (one row of
    blanks); null ids and repeated rows keep a row each; an empty table writes nothing and gives
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or run_dir(spark, "media")
    rows, chosen = _stored(docs, path, id_col, text_col)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # By place, not by shard alone: a large shard is read by several tasks, each from its own offset on.
    read = chosen.repartition(tasks, "shard", F.floor(F.col("offset") / (16 << 20))).sortWithinPartitions("shard", "offset").mapInArrow(_read(path), READ_SCHEMA)
    return spread_join(rows, read, "digest", "doc_id").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "length", "width", "height"
    )
