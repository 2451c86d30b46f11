"""Quality classifier: a factorisation machine (operator 5).

Features of a whole text: hashed words (log counts, scaled to length one), structure statistics
and metadata (size), the latter two in bands, one feature a band.  Pairwise interactions are
inner products of low-rank factors, scored in linear time: half of (sum of v x) squared minus the
sum of squares.  The labels' rows enter through a bounded sample; scoring runs over all rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passgrid.llm.common import col, numbered_columns, staged
from passgrid.llm.license_scan import FOLD

WORD_BITS = 15
BANDS = 24
#: Structure statistics, each in [0, 1] before it is put into a band.
STATISTICS = [
    "upper_share", "digit_share", "punctuation_share", "bar_share", "symbol_share", "blank_share", "stop_share", "wide_share",
    "word_length", "distinct_words", "repeated_neighbours", "repeated_lines", "top_word_share", "line_length", "size", "upper_start_share",
]
N_FEATURES = (1 << WORD_BITS) + BANDS * len(STATISTICS)
CACHE_ENTRIES = 500_000


class Features:
    """Feature ids and values of texts; one instance a task."""

    def __init__(self):
        self.slots: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(self.slots) > CACHE_ENTRIES:
            self.slots.clear()
        words, slots, mask = data.translate(FOLD).split(), self.slots, (1 << WORD_BITS) - 1
        ids = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            slot = slots.get(w)
            if slot is None:
                slot = slots[w] = zlib.crc32(w) & mask
            ids[i] = slot
        hashed, counts = np.unique(ids, return_counts=True)
        values = np.log1p(counts)
        values /= max(1e-9, float(np.sqrt((values**2).sum())))
        share = self._statistics(data, words, ids, counts)
        bands = (1 << WORD_BITS) + np.arange(len(STATISTICS)) * BANDS + np.minimum(BANDS - 1, (np.array(share) * BANDS).astype(np.int64))
        return np.concatenate([hashed, bands]), np.concatenate([values, np.full(len(bands), 0.5)]).astype(np.float32)

    @staticmethod
    def _statistics(data: bytes, words: list[bytes], ids: np.ndarray, counts: np.ndarray) -> list[float]:
        n, n_words = max(1, len(data)), max(1, len(words))
        seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        letters = max(1, int(seen[65:91].sum() + seen[97:123].sum() + seen[128:].sum() // 2))
        punctuation = seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum()
        symbols = seen[list(b"#$%&*!|=+<>{}[]~^")].sum()
        lines = data.split(b"\n")
        root = lambda x: float(min(1.0, x)) ** 0.5  # noqa: E731  small shares take several bands
        return [
            root(seen[65:91].sum() / letters),
            root(seen[48:58].sum() / n),
            root(punctuation / n),
            root(seen[124] / n * 4),
            root(symbols / n),
            root(seen[[9, 10, 13, 32]].sum() / n),
            root(seen[[46, 63]].sum() / n_words),
            root(seen[128:].sum() / n),
            min(1.0, sum(map(len, words)) / n_words / 16),
            len(counts) / n_words,
            root(float((ids[1:] == ids[:-1]).sum()) / n_words),
            root(1 - len(set(lines)) / len(lines)),
            root(float(counts.max()) / n_words if len(counts) else 0.0),
            min(1.0, np.log2(1 + n / len(lines)) / 16),
            min(1.0, np.log2(n + 1) / 20),
            root(seen[65:91].sum() / n_words),
        ]


class Machine:
    """w0 + w.x + half of the sum over factors of ((v.x)^2 - v^2.x^2), through the logistic curve."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def score(self, ids: np.ndarray, values: np.ndarray) -> float:
        vx = self.v[ids] * values[:, None]
        s = vx.sum(0)
        z = self.w0 + float(self.w[ids] @ values) + 0.5 * float(s @ s - (vx * vx).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def gradient(self, ids: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Score less label per row; the features that occur and the mean log loss's derivatives by their w and v."""
        x, i = np.concatenate(values), np.concatenate(ids)
        sizes = np.array([len(r) for r in ids])
        starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(ids)), sizes)
        vx = self.v[i] * x[:, None]
        s = np.add.reduceat(vx, starts)
        z = self.w0 + np.add.reduceat(self.w[i] * x, starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        d = (error[owner] * x)[:, None]
        unique, where = np.unique(i, return_inverse=True)
        moves = d * (s[owner] - vx)
        dw = np.bincount(where, d[:, 0]).astype(np.float32)
        dv = np.stack([np.bincount(where, moves[:, f]) for f in range(vx.shape[1])], 1).astype(np.float32)
        return error, unique, dw / len(ids), dv / len(ids)

    @classmethod
    def fit(cls, ids: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, rank: int, steps: int, rate: float, decay: float, seed: int) -> Machine:
        """``steps`` mini-batches of 64 rows, all rows in turn (400 times at most), with per-coordinate step sizes (AdaGrad)."""
        rng = np.random.default_rng(seed)
        w, v = np.zeros(N_FEATURES, np.float32), rng.normal(0, 0.05, (N_FEATURES, rank)).astype(np.float32)
        gw, gv, g0 = np.full_like(w, 1e-2), np.full_like(v, 1e-2), 1e-2
        share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
        w0 = float(np.log(share / (1 - share)))
        for _ in range(min(400, -(-steps * 64 // len(labels))) if len(labels) else 0):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), 64):
                rows = order[at : at + 64]
                error, unique, dw, dv = cls(w0, w, v).gradient([ids[r] for r in rows], [values[r] for r in rows], labels[rows])
                dw, dv = dw + decay * w[unique], dv + decay * v[unique]
                gw[unique] += dw * dw
                gv[unique] += dv * dv
                w[unique] -= rate * dw / np.sqrt(gw[unique])
                v[unique] -= rate * dv / np.sqrt(gv[unique])
                e = float(error.mean())
                g0 += e * e
                w0 -= rate * e / g0**0.5
        return cls(w0, w, v)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5 (a null id counts as an empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        pairs = [features(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array([p[0].astype("<i4").tobytes() for p in pairs], pa.binary()), pa.array([p[1].astype("<f4").tobytes() for p in pairs], pa.binary())],
            names=["doc_id", "label", "ids", "values"],
        )


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 16_000, rank: int = 8, steps: int = 1200, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Fit the machine on at most about ``sample`` labelled rows that are not held out.

    The sample is by a hash of the id, so it is the same in every run.  Rows with a null label or
    id teach nothing; an id labelled more than once counts by its smallest label.
    """
    wanted = (
        labels.select(col(id_col).cast("long").alias("doc_id"), col(label_col).cast("double").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    share = min(1.0, sample / max(1, wanted.count()))
    some = wanted.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # Bounded by ``sample`` (its share of the hash range), so it is sent to the documents, not they to it.
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).join(F.broadcast(some), "doc_id")
    features = staged(rows.mapInArrow(_extract, "doc_id long, label double, ids binary, values binary"), "quality-sample")

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        ids = [np.frombuffer(b, "<i4").astype(np.int64) for b in table.column("ids").to_pylist()]
        values = [np.frombuffer(b, "<f4") for b in table.column("values").to_pylist()]
        m = Machine.fit(ids, values, table.column("label").to_numpy(), rank, steps, rate, decay, seed)
        return pa.table({"w0": pa.array([m.w0]), "w": pa.array([m.w.astype("<f4").tobytes()], pa.binary()), "v": pa.array([m.v.astype("<f4").tobytes()], pa.binary())})

    # One task holds the bounded sample; the model (about N_FEATURES * (rank + 1) numbers) is all that the driver gets.
    found = features.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(fit, "w0 double, w binary, v binary").collect()
    if not found:
        return Machine(0.0, np.zeros(N_FEATURES, np.float32), np.zeros((N_FEATURES, rank), np.float32))
    return Machine(found[0]["w0"], np.frombuffer(found[0]["w"], "<f4"), np.frombuffer(found[0]["v"], "<f4").reshape(N_FEATURES, rank))


def score_quality(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Score every whole text.

    Returns a row per input row: doc_id, held_out, score (0 to 1), predicted
    (1 if score >= threshold).  A null text is scored as an empty one; null ids and repeated rows
    keep a row each; an empty table gives none; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.w0, model.w, model.v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, machine = Features(), Machine(*shared.value)
        for batch in batches:
            scores = [machine.score(*features(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Machine, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows, whole, whose text the machine does not reject.

    Decided text by text: a null text is scored as an empty one, repeated rows and null ids stay or
    go by their text, an empty table stays empty, columns may have any names.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.w0, model.w, model.v))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, machine = Features(), Machine(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array([machine.score(*features(t)) >= threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    plain = numbered_columns(docs)  # names may hold dots, which the Arrow map does not take
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
