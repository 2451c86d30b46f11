"""Token counts by distinct pre-tokens (operator 1).

One pass turns every block of documents into per-document pre-token frequencies over the
block's own vocabulary.  The blocks' vocabularies are shuffled by pre-token, so that the pieces
of each distinct pre-token are counted once in the whole corpus; the counts are joined back to
the blocks and every document's frequencies are summed against them.  No ids are made.  What is
shuffled are distinct pre-tokens per block, not occurrences, so the commonest word is one row a
block, no larger a share of the rows than any block's vocabulary allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passgrid.llm.common import col, staged
from passgrid.llm.wordpieces import word_tokenizer

#: Bytes of text in a block at most (a longer text is a block of its own).
BLOCK_BYTES = 64 << 20
BLOCK_SCHEMA = "block string, doc_ids array<long>, n_bytes array<long>, direct array<long>, frequencies binary, pretokens array<string>"


def _packed(a: np.ndarray) -> bytes:
    """Small non-negative int32 numbers, compressed byte plane by byte plane."""
    return zstandard.compress(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def frequencies(lines: list[np.ndarray], counts: list[np.ndarray]) -> bytes:
    """Per document: how many entries, their ids (rising, as differences), their counts."""
    sizes = np.array([len(x) for x in lines], np.int64)
    ids = np.concatenate([np.diff(x, prepend=0) for x in lines] or [np.zeros(0, np.int64)])
    parts = [_packed(sizes), _packed(ids), _packed(np.concatenate(counts or [np.zeros(0, np.int64)]))]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def sums(data: bytes, pieces: np.ndarray) -> np.ndarray:
    """Per document the sum of count times pieces over its entries."""
    out, at = [], 0
    for _ in range(3):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(_unpacked(data[at + 8 : at + 8 + n]))
        at += 8 + n
    sizes, steps, counts = out
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.cumsum(steps)
    # The steps start at 0 in every document: take off what the documents before it added up to.
    before = np.concatenate([[0], ids])[starts[:-1]]
    ids = ids - np.repeat(before, sizes)
    total = np.concatenate([[0], np.cumsum(counts * pieces[ids] if len(ids) else counts)])
    return total[starts[1:]] - total[starts[:-1]]


def _cut(batches: Iterator[pa.RecordBatch], most: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``most`` bytes of text, or of one longer text."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, most + (sizes[at - 1] if at else 0), "right")))
            yield batch.slice(at, end - at)
            at = end


def _blocks(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_tokenizer(tokenizer)
        part, number = TaskContext.get().partitionId(), 0
        for batch in _cut(batches, BLOCK_BYTES):
            vocabulary: dict[str, int] = {}
            chunks: dict[str, tuple[int, ...]] = {}
            ids, n_bytes, direct, lines, counts = batch.column(0), [], [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                if not own.by_chunk:  # a file of another kind: its whole text is one entry of the library's count
                    direct.append(len(own.ids(text)) // 4)
                    lines.append(np.zeros(0, np.int64))
                    counts.append(np.zeros(0, np.int64))
                    continue
                special, entries = 0, []
                for found, one in own.segments(text.lower() if text.isascii() and own.opening not in text else text):
                    if found is None:
                        special += 1
                        continue
                    for c in found:
                        known = chunks.get(c)
                        if known is None:
                            known = chunks[c] = tuple(vocabulary.setdefault(w, len(vocabulary)) for w in own.chunk_pretokens(c))
                        entries += known
                direct.append(special)
                line, n = np.unique(np.array(entries, np.int64), return_counts=True)
                lines.append(line)
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{part}-{number}"]),
                    pa.array([ids.to_pylist()], pa.list_(pa.int64())),
                    pa.array([n_bytes], pa.list_(pa.int64())),
                    pa.array([direct], pa.list_(pa.int64())),
                    pa.array([frequencies(lines, counts)], pa.binary()),
                    pa.array([list(vocabulary)], pa.list_(pa.string())),
                ],
                names=["block", "doc_ids", "n_bytes", "direct", "frequencies", "pretokens"],
            )
            number += 1

    return run


def _count_pieces(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_tokenizer(tokenizer)
        for batch in batches:
            n = [len(own.tokens_of_pretoken(w)) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], names=["pretoken", "pieces"])

    return run


def _sum_block(block: pa.Table, counted: pa.Table) -> pa.Table:
    pieces = np.zeros(counted.num_rows, np.int64)
    pieces[counted.column("position").to_numpy()] = counted.column("pieces").to_numpy()
    ids, n_bytes, tokens = [], [], []
    for row in block.select(["doc_ids", "n_bytes", "direct", "frequencies"]).to_pylist():
        ids += row["doc_ids"]
        n_bytes += row["n_bytes"]
        tokens.append(sums(row["frequencies"], pieces) + np.array(row["direct"], np.int64))
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(n_bytes, pa.int64()), "n_tokens": pa.array(np.concatenate(tokens))})


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """Tokens of every whole text, without begin, end or added special tokens.

    Returns one row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).
    A null text counts as empty (0 bytes, 0 tokens); null ids and repeated rows keep a row each;
    an empty table gives no rows; other columns are ignored.  ``tokenizer`` is a path or the name
    of a public file.  A block is an Arrow batch or the part of one with BLOCK_BYTES of text.
    """
    blocks = staged(
        docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(_blocks(tokenizer), BLOCK_SCHEMA),
        "pretoken-blocks",
    )
    vocabulary = blocks.select(F.col("block").alias("of_block"), F.posexplode("pretokens").alias("position", "pretoken"))
    pieces = vocabulary.select("pretoken").distinct().mapInArrow(_count_pieces(tokenizer), "pretoken string, pieces int")
    counted = vocabulary.join(pieces, "pretoken").select("of_block", "position", "pieces")
    sizes = blocks.select("block", "doc_ids", "n_bytes", "direct", "frequencies")
    out = sizes.groupBy("block").cogroup(counted.groupBy("of_block")).applyInArrow(_sum_block, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
