"""Hard negatives by an inverted multi-index (operator 12).

Vectors are cut in two halves, each half has a codebook, and a row's cell is the pair of its nearest
codewords.  What a row of a cell can score with an anchor is at most the sum of two half bounds:
inner product with the codeword and the anchor's length times the codeword's radius, the largest
distance of any row to it.  A multi-sequence heap takes cells by falling sum of half bounds, so
once a window of scores has as many rows as asked for, and no cell left can reach the least of them,
it is certified.  The first cells of every anchor are searched for floors, and the heap then goes on from there
to the last cell whose bound reaches the floor.  Positives are one such search, with a window open
above; their scores make the windows of the second one, over rows of other labels.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passgrid.llm.common import col, staged
from passgrid.llm.topk_search import inner

#: Rows of a cell on average, rows of a chunk (a larger cell is several), anchors of a group, rows of the first cells of an anchor.
CELL, CHUNK, GROUP, FIRST = 2048, 4096, 256, 4096
#: Codewords of a half at most (the driver sees their square in counts), and the sample (rows, bytes) that they are fitted on.
MOST_WORDS, SAMPLE, SAMPLE_BYTES, STEPS = 512, 16_384, 32 << 20, 8
#: Groups whose requests for one chunk are handled together.
TOGETHER = 64
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def _narrow(m: np.ndarray) -> bytes:
    """Whole numbers held as doubles, in the fewest bytes that keep them."""
    kind = "<i2" if np.abs(m).max(initial=0) < 2**15 else "<f8"
    return kind.encode() + m.astype(kind).tobytes()


def _wide(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, data[:3].decode(), offset=3).astype(np.float64).reshape(rows, -1)


def _whole_numbers(scale: int):
    """Rows that take part, their components floor(scale * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, label, v in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if i is None or label is None or v is None or any(x is None for x in v):
                    continue
                with np.errstate(over="ignore"):
                    a = np.floor(scale * np.array(v, np.float64))
                if np.isfinite(a).all():
                    rows.append((i, label, len(a), _narrow(a)))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["vec_id", "label", "width", "vector"])

    return run


def _matrix(vectors: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        row = _wide(v, 1)[0]
        out[i, : len(row)] = row
    return out


def codebook(points: np.ndarray, words: int) -> np.ndarray:
    """Centres of a half by a few steps of k-means, from evenly spaced points of the (sorted) sample."""
    centres = points[np.linspace(0, len(points) - 1, min(words, len(points))).astype(int)]
    for _ in range(STEPS):
        near = nearest(points, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = ((centres**2).sum(1)[None, :] - 2 * points @ centres.T).argmin(1)
    return near, np.linalg.norm(points - centres[near], axis=1)


class Index:
    """Codebooks, and of every cell its rows and the radii of its two halves; what tasks need to walk the heap."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], cells: list[tuple[int, int, float, float]]):
        self.books, shape = books, (len(books[0]), len(books[1]))
        self.n, self.radius = np.zeros(shape, np.int64), (np.zeros(shape), np.zeros(shape))
        for cell, n, r0, r1 in cells:
            at = divmod(cell, shape[1])
            self.n[at], self.radius[0][at], self.radius[1][at] = n, r0, r1
        self.word_radius = self.radius[0].max(1), self.radius[1].max(0)
        self.half = books[0].shape[1]

    def walk(self, anchor: np.ndarray) -> Iterator[tuple[float, int, float, float]]:
        """(bound by codewords, cell, its own upper and lower bound) of cells with rows, by falling bound."""
        parts = anchor[: self.half], anchor[self.half :]
        length = [float(np.linalg.norm(p)) for p in parts]
        dots = [book @ p for book, p in zip(self.books, parts, strict=True)]
        reach = [d + n * r for d, n, r in zip(dots, length, self.word_radius, strict=True)]
        order = [(-r).argsort(kind="stable") for r in reach]
        slack = 1e-9 * (sum(float(np.abs(d).max()) for d in dots) + sum(n * float(r.max()) for n, r in zip(length, self.word_radius, strict=True))) + 1e-6
        sums = lambda x, y: -float(reach[0][order[0][x]] + reach[1][order[1][y]])
        heap = [(sums(0, 0), 0, 0)]
        while heap:
            bound, x, y = heapq.heappop(heap)
            i, j = int(order[0][x]), int(order[1][y])
            if self.n[i, j]:
                dot, off = float(dots[0][i] + dots[1][j]), length[0] * self.radius[0][i, j] + length[1] * self.radius[1][i, j]
                yield -bound + slack, i * self.n.shape[1] + j, dot + off + slack, dot - off - slack
            if x + 1 < len(order[0]):
                heapq.heappush(heap, (sums(x + 1, y), x + 1, y))
            if x == 0 and y + 1 < len(order[1]):
                heapq.heappush(heap, (sums(0, y + 1), 0, y + 1))

    def first(self, anchor: np.ndarray, enough: int) -> list[int]:
        """The cells that come first and hold ``enough`` rows."""
        out, seen = [], 0
        for _, cell, _, _ in self.walk(anchor):
            out.append(cell)
            seen += int(self.n.flat[cell])
            if seen >= enough:
                break
        return out

    def rest(self, anchor: np.ndarray, enough: int, low: int, high: int) -> list[int]:
        """The cells after those until no bound reaches ``low``, but for those with no score from ``low`` to ``high``."""
        out, seen = [], 0
        for bound, cell, most, least in self.walk(anchor):
            if seen < enough:
                seen += int(self.n.flat[cell])
                continue
            if bound < low:
                break  # all windows are certified
            if most >= low and least <= high:
                out.append(cell)
        return out


def _deal(books: tuple[np.ndarray, np.ndarray], width: int):
    """Rows with their cell and the distances of their halves to its codewords."""
    half = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column("vector").to_pylist(), width)
            (i, r0), (j, r1) = nearest(m[:, :half], books[0]), nearest(m[:, half:], books[1])
            own = [batch.column(c) for c in ("vec_id", "label", "vector")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(i * len(books[1]) + j), pa.array(r0), pa.array(r1)], names=["vec_id", "label", "vector", "cell", "r0", "r1"])

    return run


DEALT = "vec_id long, label long, vector binary, cell long, r0 double, r1 double"
CHUNKS = "cell long, piece int, ids binary, labels binary, matrix binary"
GROUPS = "grp string, ids array<long>, labels array<long>, matrix binary"


def _packed(width: int, anchors: bool):
    """A chunk as one row, or its anchors as groups; rows are in order, so a repeated attempt gives the same."""

    def run(table: pa.Table) -> pa.Table:
        cell, piece = table.column("cell")[0].as_py(), table.column("piece")[0].as_py()
        rows = sorted(zip(*[table.column(c).to_pylist() for c in ("vec_id", "label", "vector")], strict=True))
        m = _matrix([v for _, _, v in rows], width)
        ids, labels = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        if not anchors:
            return pa.table({"cell": [cell], "piece": pa.array([piece], pa.int32()), **{n: pa.array([x], pa.binary()) for n, x in (("ids", ids.tobytes()), ("labels", labels.tobytes()), ("matrix", _narrow(m)))}})
        cuts = range(0, len(rows), GROUP)
        lists = lambda a: pa.array([a[c : c + GROUP].tolist() for c in cuts], pa.list_(pa.int64()))
        return pa.table({"grp": [f"{cell}-{piece}-{c}" for c in cuts], "ids": lists(ids), "labels": lists(labels), "matrix": pa.array([_narrow(m[c : c + GROUP]) for c in cuts], pa.binary())})

    return run


REQUESTS = "cell long, piece int, grp string, own binary, ids binary, labels binary, matrix binary, windows int, low binary, high binary"


def _requests(index: Index, first: bool, enough: int):
    """What every group wants of which chunk: its anchors that the chunk's cell concerns, with their windows.

    Anchors without windows want nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels = np.array(row["ids"], np.int64), np.array(row["labels"], np.int64)
                m, most = _wide(row["matrix"], len(ids)), 1 + max(w["window"] for w in row["windows"])
                low, high = np.full((len(ids), most), HIGHEST), np.full((len(ids), most), LOWEST)  # nothing lies in these
                for w in row["windows"]:
                    low[w["row"], w["window"]], high[w["row"], w["window"]] = w["low"], w["high"]
                wanted: dict[int, list[int]] = {}
                for r in sorted({w["row"] for w in row["windows"]}):
                    open_ = low[r] <= high[r]
                    cells = index.first(m[r], enough) if first else index.rest(m[r], enough, int(low[r][open_].min()), int(high[r][open_].max()))
                    for cell in cells:
                        wanted.setdefault(cell, []).append(r)
                for cell, rows in wanted.items():
                    own = np.array(rows, np.int64)
                    sent = [own.tobytes(), ids[own].tobytes(), labels[own].tobytes(), _narrow(m[own])]
                    pieces = -(-int(index.n.flat[cell]) // CHUNK)
                    columns = [pa.array([cell] * pieces), pa.array(range(pieces), pa.int32()), pa.array([row["grp"]] * pieces), *[pa.array([x] * pieces, pa.binary()) for x in sent]]
                    columns += [pa.array([most] * pieces, pa.int32()), *[pa.array([x[own].tobytes()] * pieces, pa.binary()) for x in (low, high)]]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in REQUESTS.split(", ")])

    return run


FOUND = "grp string, row int, window int, vec_id long, score long"


def _visited(same: bool, k: int):
    """The k best rows of a chunk in every window asked for: of the anchor's label (but the anchor's id), or of another one."""

    def run(data: pa.Table, requests: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for chunk in data.to_pylist():
            ids, labels = np.frombuffer(chunk["ids"], np.int64), np.frombuffer(chunk["labels"], np.int64)
            points = _wide(chunk["matrix"], len(ids))
            for at in range(requests.num_rows):
                asked = requests.slice(at, 1).to_pylist()[0]
                own, anchors, of = (np.frombuffer(asked[c], np.int64) for c in ("own", "ids", "labels"))
                low, high = (np.frombuffer(asked[c], np.int64).reshape(len(own), -1) for c in ("low", "high"))
                scores = inner(_wide(asked["matrix"], len(own)), points)
                fit = (labels[None, :] == of[:, None]) & (ids[None, :] != anchors[:, None]) if same else labels[None, :] != of[:, None]
                for r in range(len(own)):
                    some = np.nonzero(fit[r] & (scores[r] >= low[r].min()) & (scores[r] <= high[r].max()))[0]
                    some = some[np.lexsort((ids[some], np.invert(scores[r][some])))]  # ~score orders longs downwards
                    s = scores[r][some]
                    for w in range(low.shape[1]):
                        best = some[(s >= low[r, w]) & (s <= high[r, w])][:k]
                        for column, value in zip(out, (np.full(len(best), at), np.full(len(best), own[r]), np.full(len(best), w), ids[best], scores[r][best]), strict=True):
                            column.append(value)
        if not out[0]:
            return pa.table({n: pa.array([], t) for n, t in zip(("grp", "row", "window", "vec_id", "score"), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)})
        at, row, window, vec_id, score = (np.concatenate(c).astype(np.int64) for c in out)
        names = requests.column("grp").take(pa.array(at))
        return pa.table({"grp": names, "row": pa.array(row, pa.int32()), "window": pa.array(window, pa.int32()), "vec_id": pa.array(vec_id), "score": pa.array(score)})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("grp", "row", "window").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _search(groups: DataFrame, chunks: DataFrame, windows: DataFrame, index: Index, same: bool, k: int, enough: int) -> DataFrame:
    """The k best rows (staged) of every window (grp, row, window, low, high; staged); ties go to the smaller id."""
    parts = max(1, -(-groups.count() // TOGETHER))
    keys = ["cell", "piece", "part"]

    def visits(open_windows: DataFrame, first: bool) -> DataFrame:
        asked = open_windows.groupBy("grp").agg(F.collect_list(F.struct("row", "window", "low", "high")).alias("windows"))  # of a group: at most GROUP rows with k windows each
        wanted = groups.join(asked, "grp").mapInArrow(_requests(index, first, enough), REQUESTS).withColumn("part", F.pmod(F.xxhash64("grp"), F.lit(parts)))
        wanted = staged(wanted, "requests")
        copies = chunks.join(wanted.select(*keys).distinct(), ["cell", "piece"])  # a chunk goes to the parts that want it
        to = wanted.select(*[F.col(k).alias(f"to_{k}") for k in keys], *[c for c in wanted.columns if c not in keys])
        return copies.groupBy(*keys).cogroup(to.groupBy(*[f"to_{k}" for k in keys])).applyInArrow(_visited(same, k), FOUND)

    near = staged(_best(visits(windows, True), k).drop("rank"), "near")
    floors = near.groupBy("grp", "row", "window").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).drop("n")
    narrowed = windows.join(floors, ["grp", "row", "window"], "left").withColumn("low", F.greatest("low", "floor")).drop("floor")
    return staged(_best(near.unionByName(visits(narrowed, False)), k), "best")


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100, positives: int = 5, negatives: int = 5, share: int = 80, scale: int = 256, enough: int = FIRST
) -> DataFrame:
    """For every anchor and each of its positives, the best-scoring rows of other labels that score at most what the positive does.

    Components become floor(scale * x), scores are integer inner products with the anchor, higher ones
    come first and ties go to the smaller id.  Anchors are rows whose id is divisible by ``every``; an
    anchor's positives are its first ``positives`` rows of the same label and another id, and a
    positive's negatives the first ``negatives`` rows of a different label with ``share`` * positive
    <= 100 * negative <= 100 * positive score.  Returns anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score; fewer rows where there are fewer candidates, none for
    a positive without negatives.  Rows with a null id, label or vector, or a component that is null
    or not finite, before or after scaling, take no part; shorter vectors count as filled up by zeros;
    repeated rows count one by one, as anchors too; scores beyond a long stay at its ends; an empty
    table gives no rows; other columns are ignored.  Codebooks come from a sample of at most SAMPLE
    rows; they steer which cells are skipped, not the result.
    """
    rows = vectors.select(col(id_col).cast("long").alias("vec_id"), col(label_col).cast("long").alias("label"), col(vector_col).cast("array<double>").alias("v"))
    rows = staged(rows.mapInArrow(_whole_numbers(scale), "vec_id long, label long, width int, vector binary"), "vectors")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max("width"), F.lit(0))).first()
    words = max(1, min(MOST_WORDS, math.ceil(math.sqrt(n / CELL))))
    taken = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, width))))
    drawn = rows if n <= taken else rows.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 40)) < int(taken / n * (1 << 40)))
    sample = _matrix(sorted(bytes(r["vector"]) for r in drawn.select("vector").limit(2 * taken).collect()) or [_narrow(np.zeros(0))], width)
    books = codebook(sample[:, : (width + 1) // 2], words), codebook(sample[:, (width + 1) // 2 :], words)
    dealt = staged(rows.mapInArrow(_deal(books, width), DEALT), "cells")
    cells = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("r0").alias("r0"), F.max("r1").alias("r1"))
    met = [tuple(r) for r in cells.collect()]  # at most MOST_WORDS squared
    index = Index(books, met)
    pieces = F.broadcast(vectors.sparkSession.createDataFrame([(c, -(-k // CHUNK)) for c, k, _, _ in met], "cell long, pieces int"))  # of the same bound
    cut = dealt.join(pieces, "cell").select("vec_id", "label", "vector", "cell", F.pmod(F.xxhash64("vec_id", "vector"), F.col("pieces")).cast("int").alias("piece"))
    chunks = staged(cut.groupBy("cell", "piece").applyInArrow(_packed(width, False), CHUNKS), "chunks")
    groups = staged(cut.where(F.col("vec_id") % every == 0).groupBy("cell", "piece").applyInArrow(_packed(width, True), GROUPS), "anchors")
    anchors = groups.select("grp", F.posexplode("ids").alias("row", "anchor_id"))
    whole = staged(anchors.select("grp", "row", F.lit(0).alias("window"), F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high")), "windows")
    near = _search(groups, chunks, whole, index, True, positives, enough).select("grp", "row", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    least = F.expr(f"CAST(CEIL(CAST({share} AS DECIMAL(5, 0)) * CAST(positive_score AS DECIMAL(19, 0)) / 100) AS LONG)")
    windows = near.select("grp", "row", "window", least.alias("low"), F.col("positive_score").alias("high")).where("low <= high")
    found = _search(groups, chunks, staged(windows, "windows"), index, False, negatives, enough)
    both = near.join(found, ["grp", "row", "window"]).join(anchors, ["grp", "row"])
    return both.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
