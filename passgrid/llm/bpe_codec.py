"""BPE encoding and decoding with forced boundaries (operator 13).

A merge joins two tokens at one place: the last byte of the left one and the first of the right one
then stand side by side inside a token.  Byte pairs that no vocabulary token holds side by side (the
last byte of a pre-token is told apart, as the model does) are never merged across, so they are
certain cuts: the fragments between them are encoded one by one, each distinct one once a worker,
and their ids are concatenated.  Decoding is what the file's decoder makes of the ids; a file
without one joins the vocabulary's strings by spaces.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from passgrid.llm.common import col, numbered_columns
from passgrid.llm.wordpieces import WordTokenizer, _Filled, _in_latin1, resolved

#: Bytes of text that are encoded (ids that are decoded: a fourth) before a batch is handed on.
BATCH_BYTES = 4 << 20
#: Bytes up to which a pre-token is cut and merged by plain loops; entries of each cache.
SHORT, CACHE_ENTRIES = 64, 300_000


class BoundaryTokenizer(WordTokenizer):
    """Encoder of a byte-level BPE file by fragments; one instance per Python worker and file."""

    def __init__(self, path: str):
        if not path.endswith(".json"):
            raise ValueError(f"{path}: only plain byte-level BPE of a .json file is encoded by fragments")
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError(f"{path}: only plain byte-level BPE is encoded by fragments")
        self.byte_of = {self.byte_chars.get(b, chr(b)): b for b in range(256)}
        # Symbols: bytes 0 to 255, and 256 to 511 for the last byte of a pre-token where the model marks it.
        self.marks_end = bool(end)
        self.symbol_ids = np.full(512, -1, np.int64)
        first, last = {}, {}
        for c, b in self.byte_of.items():
            for symbol, token in ((b, c), (256 + b, c + end)):
                if token in vocab and (symbol < 256 or end):
                    self.symbol_ids[symbol] = vocab[token]
                    first[token] = last[token] = symbol
        self.joined = np.zeros((512, 512), bool)
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((vocab[a], vocab[b]), rank)
            self.made.append(vocab[a + b])
            self.joined[last[a], first[b]] = True
            first[a + b], last[a + b] = first[a], last[b]
        self.has_decoder = spec.get("decoder") is not None
        by_id = sorted([(i, t) for t, i in vocab.items()] + [(a["id"], a["content"]) for a in spec.get("added_tokens") or []])
        self.strings = [""] * (by_id[-1][0] + 1)
        for i, t in by_id:
            self.strings[i] = t
        # Rows of what is joined within a pre-token and at its end, for pre-tokens of a few bytes.
        self.inside, self.at_end = ([row.tobytes() for row in m] for m in (self.joined[:256, :256], self.joined[:256, 256:] if self.marks_end else self.joined[:256, :256]))
        self._last: dict[bytes, bytes] = _Filled(lambda f: self._encoded(f, True))
        self._inner: dict[bytes, bytes] = _Filled(lambda f: self._encoded(f, False))

    def cuts(self, word: bytes) -> list[int]:
        """Where a pre-token's bytes are cut because no token reaches across."""
        if len(word) <= SHORT:
            inside, last = self.inside, len(word) - 2
            return [i + 1 for i in range(last) if not inside[word[i]][word[i + 1]]] + ([last + 1] if last >= 0 and not self.at_end[word[-2]][word[-1]] else [])
        symbols = np.frombuffer(word, np.uint8).astype(np.uint16)
        if self.marks_end:
            symbols[-1] += 256
        return (np.nonzero(~self.joined[symbols[:-1], symbols[1:]])[0] + 1).tolist()

    def _encoded(self, fragment: bytes, ends: bool) -> bytes:
        """Ids of one fragment; ``ends`` if it is the end of its pre-token."""
        tokens = self.symbol_ids[: 256][np.frombuffer(fragment, np.uint8)].tolist()
        if ends and self.marks_end:
            tokens[-1] = int(self.symbol_ids[256 + fragment[-1]])
        if -1 in tokens:
            raise ValueError("the vocabulary lacks a byte")
        merge = self._merge_short if len(tokens) <= SHORT else self._merge_long
        return b"".join([self.packed[t] for t in merge(tokens)])

    def _merge_short(self, tokens: list[int]) -> list[int]:
        """The merge of the least rank first, the leftmost of equals."""
        known, none = self.ranks.get, len(self.made)
        ranks = [known(pair, none) for pair in pairwise(tokens)]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            tokens[i : i + 2] = [self.made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = known((tokens[i - 1], tokens[i]), none)
            if i < len(ranks):
                ranks[i] = known((tokens[i], tokens[i + 1]), none)
        return tokens

    def _merge_long(self, tokens: list[int]) -> list[int]:
        """The same by a heap."""
        n, known = len(tokens), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i) for i in range(n - 1) if (rank := known((tokens[i], tokens[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if tokens[i] >= 0 else n
            if j >= n or known((tokens[i], tokens[j])) != rank:
                continue  # one of the two was merged already
            tokens[i], tokens[j], k, h = self.made[rank], -1, after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                if (rank := known((tokens[i], tokens[k]))) is not None:
                    heapq.heappush(heap, (rank, i))
            if h >= 0 and (rank := known((tokens[h], tokens[i]))) is not None:
                heapq.heappush(heap, (rank, h))
        return [t for t in tokens if t >= 0]

    def _word_ids(self, word: str) -> bytes:
        data = word.encode("utf-8", "replace")
        cuts = self.cuts(data)
        if not cuts:
            return self._last[data]
        out = [self._inner[data[a:b]] for a, b in pairwise([0, *cuts])]
        return b"".join([*out, self._last[data[cuts[-1] :]]])

    def _chunk_ids(self, chunk: str) -> bytes:
        return b"".join(map(self._word_ids, self.chunk_pretokens(chunk)))

    def trim(self) -> None:
        for cache in (self._chunks, self._last, self._inner):
            if len(cache) > CACHE_ENTRIES:
                cache.clear()

    def ids(self, text: str) -> bytes:
        """Ids of the text, packed as little-endian unsigned 32-bit numbers."""
        if self.by_chunk:
            return super().ids(text)
        self.trim()
        out = []
        for part in self.added_split.split(text) if self.added_split else [text]:
            if part in self.added:
                out.append(self.packed[self.added[part]])
            elif part:
                normal = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
                words = self.library.pre_tokenizer.pre_tokenize_str(normal)
                out += [self._word_ids(w) for w in (bytes(map(self.byte_of.__getitem__, shown)).decode("utf-8") for shown, _ in words)]
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        if self.has_decoder:
            return self.library.decode(ids.tolist(), skip_special_tokens=False)
        strings = self.strings
        return " ".join([strings[i] for i in ids.tolist()])


@lru_cache(4)
def _by_path(path: str) -> BoundaryTokenizer:
    return BoundaryTokenizer(path)


def _slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``most`` bytes of a column, or of one longer value."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, most + (sizes[at - 1] if at else 0), "right")))
        yield batch.slice(at, end - at)
        at = end


def _encode(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _by_path(resolved(tokenizer))
        for whole in batches:
            for batch in _slices(whole, 1, BATCH_BYTES):
                ids = [own.ids(t or "") for t in batch.column(1).to_pylist()]
                n = pa.array([len(i) // 4 for i in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


def _decode(tokenizer: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _by_path(resolved(tokenizer))
        for whole in batches:
            for batch in _slices(whole, len(names) - 1, BATCH_BYTES):
                texts = [None if i is None else own.decode(np.frombuffer(i, "<u4")) for i in batch.column(len(names) - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """Token ids of every whole text: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit numbers).

    Ids are those of the tokenizers library without special tokens, truncation or padding; strings of
    added tokens inside a text become their single id, as the library does by default.  A null text
    counts as empty (no ids); null ids and repeated rows keep a row each; an empty table gives no
    rows; other columns are ignored.  ``tokenizer`` is a path or the name of a public file of a
    byte-level BPE; another kind raises.  Memory is that of one batch, or of one text and, where no
    byte pair cuts it, a heap over one pre-token.
    """
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encode(tokenizer), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ids_col: str = "ids", tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """The rows with ``decoded``, the text that the file's decoder makes of their ids (null ids: null; none: empty).

    Ids beyond the vocabulary raise.  Other columns stay; a column ``decoded`` of the rows is replaced.
    """
    others = [c for c in encoded.columns if c not in (ids_col, "decoded")]
    rows = encoded.select(*[col(c) for c in others], col(ids_col))
    plain = numbered_columns(rows)
    out = plain.mapInArrow(_decode(tokenizer, plain.columns), StructType([*plain.schema.fields, StructField("decoded", StringType())]))
    return out.toDF(*rows.columns, "decoded")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """Digests of every text's ids and of what they decode to: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Hard rows are as in ``encode``; one pass, without a shuffle.
    """
    both = decode(encode(docs, id_col, text_col, tokenizer), "ids", tokenizer)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
