"""Evaluation kit: box overlap, average precision, ROC, similarity pairs, leakage audit, gates."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BOX = ["x1", "y1", "x2", "y2"]


def _iou(a, b) -> Column:
    """Intersection over union of two boxes, whose corners the functions give by name; 0 for an empty union."""
    w = F.greatest(F.lit(0.0), F.least(a("x2"), b("x2")) - F.greatest(a("x1"), b("x1")))
    h = F.greatest(F.lit(0.0), F.least(a("y2"), b("y2")) - F.greatest(a("y1"), b("y1")))
    area = lambda p: (p("x2") - p("x1")) * (p("y2") - p("y1"))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def iou(a: str = "", b: str = "g_") -> Column:
    """Intersection over union of two boxes held in columns with the prefixes; 0 for an empty union."""
    return _iou(lambda c: F.col(a + c), lambda c: F.col(b + c))


def best_truth(dets: DataFrame, truths: DataFrame) -> DataFrame:
    """Each detection with the truth of its image and label that it overlaps most (first on a tie); null without overlap.

    Truths of an image and label come as one list, so that detections travel once and no pair is a row.
    """
    g = truths.groupBy("img_id", "label").agg(F.collect_list(F.struct("gt_idx", *BOX)).alias("__g"))
    each = F.filter(F.transform("__g", lambda x: F.struct(_iou(F.col, lambda c: x[c]).alias("iou"), (-x["gt_idx"]).alias("less"), x["gt_idx"].alias("gt_idx"))), lambda x: x["iou"] > 0)
    met = dets.join(g, ["img_id", "label"], "left").select(*[dets[c] for c in dets.columns], F.array_max(each).alias("__b"))
    return met.select(*dets.columns, "__b.gt_idx", "__b.iou")


def _taken() -> Column:
    """The best overlap of the surer detections with the same truth, -1 without one."""
    surer = W.partitionBy("img_id", "label", "gt_idx").orderBy(F.col("confidence").desc(), "det_idx").rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.when(F.col("gt_idx").isNotNull(), F.max("iou").over(surer)), F.lit(-1.0))


def true_positive_counts(matched: DataFrame, thresholds: list[float]) -> DataFrame:
    """(label, t, tp, n): true positives and detections per threshold; rows are not spread over thresholds, only sums are."""
    rows = matched.withColumn("taken", _taken())
    hits = [F.coalesce(F.sum((F.coalesce(F.col("iou") >= t, F.lit(False)) & (F.col("taken") < t)).cast("long")), F.lit(0)).alias(f"tp{i}") for i, t in enumerate(thresholds)]
    sums = rows.groupBy("label").agg(F.count("*").alias("n"), *hits)
    return sums.select("label", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"tp{i}").alias("tp")) for i, t in enumerate(thresholds)])).alias("x"), "n").select("label", "x.t", "x.tp", "n")


def true_positives(matched: DataFrame, thresholds: list[float]) -> DataFrame:
    """Detections per threshold with ``tp``: overlap reaches it and no surer detection took that truth."""
    rows = matched.withColumn("t", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    hit = F.coalesce(F.col("iou") >= F.col("t"), F.lit(False))
    first = F.row_number().over(W.partitionBy("img_id", "label", "t", F.when(hit, F.col("gt_idx"))).orderBy(F.col("confidence").desc(), "det_idx"))
    return rows.withColumn("tp", (hit & (first == 1)).cast("int"))


def precision_recall(tps: DataFrame, truths: DataFrame) -> DataFrame:
    """Running precision and recall by falling confidence.

    Sums run within bands of confidence and are moved by the bands before, so that a class is not
    one sorted partition.
    """
    band = tps.withColumn("band", F.floor(F.col("confidence") * 1000))
    sums = band.groupBy("label", "t", "band").agg(F.sum("tp").alias("s"), F.count("*").alias("n"))
    before = W.partitionBy("label", "t").orderBy(F.col("band").desc()).rowsBetween(W.unboundedPreceding, -1)
    moved = sums.select("label", "t", "band", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    run = W.partitionBy("label", "t", "band").orderBy(F.col("confidence").desc(), "img_id", "det_idx").rowsBetween(W.unboundedPreceding, 0)
    rows = band.join(moved, ["label", "t", "band"]).withColumn("cum_tp", F.col("s0") + F.sum("tp").over(run)).withColumn("cum_n", F.col("n0") + F.count("*").over(run))
    n_gt = truths.groupBy("label").agg(F.count("*").alias("n_gt"))
    return rows.join(n_gt, "label").withColumn("recall", F.col("cum_tp") / F.col("n_gt")).withColumn("precision", F.col("cum_tp") / F.col("cum_n"))


def recall_bins(matched: DataFrame, truths: DataFrame, thresholds: list[float]) -> DataFrame:
    """(label, t, r, p): the best precision p at recall level r of 0..100, for every threshold at once.

    A detection is a true positive at t if it reaches t and no surer one of the same truth does, so one
    running maximum serves all thresholds.  Their sums run side by side within bands of confidence, and
    rows are spread over thresholds only where they are counted.
    """
    rows = matched.withColumn("taken", _taken()).withColumn("band", F.floor(F.col("confidence") * 1000))
    tps = [f"tp{i}" for i in range(len(thresholds))]
    rows = rows.select("label", "band", "confidence", "img_id", "det_idx", *[(F.coalesce(F.col("iou") >= t, F.lit(False)) & (F.col("taken") < t)).cast("long").alias(c) for c, t in zip(tps, thresholds, strict=True)])
    sums = rows.groupBy("label", "band").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in tps])
    before = W.partitionBy("label").orderBy(F.col("band").desc()).rowsBetween(W.unboundedPreceding, -1)
    moved = sums.select("label", "band", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", *tps)])
    run = W.partitionBy("label", "band").orderBy(F.col("confidence").desc(), "img_id", "det_idx").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumns({f"{c}_run": F.sum(c).over(run) for c in tps} | {"n_run": F.count("*").over(run)}).join(moved, ["label", "band"])
    placed = placed.join(truths.groupBy("label").agg(F.count("*").alias("n_gt")), "label")
    cum = lambda c: F.col(f"{c}_run") + F.col(f"{c}_before")
    points = [F.struct(F.lit(t).alias("t"), F.least(F.floor(cum(c) / F.col("n_gt") * 100 + 1e-9), F.lit(100)).alias("r"), (cum(c) / cum("n")).alias("p")) for c, t in zip(tps, thresholds, strict=True)]
    return placed.select("label", F.explode(F.array(*points)).alias("x")).groupBy("label", "x.t", "x.r").agg(F.max("x.p").alias("p"))


def average_precision(bins: DataFrame) -> DataFrame:
    """Mean over 101 recall levels of the best precision at that recall or beyond, from ``recall_bins``."""
    levels = bins.select("label", "t").distinct().withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(100).cast("long"))))
    best = levels.join(bins, ["label", "t", "r"], "left").withColumn("p", F.coalesce(F.max("p").over(W.partitionBy("label", "t").orderBy(F.col("r").desc()).rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0)))
    return best.groupBy("label", "t").agg((F.sum("p") / 101).alias("ap"))


def mean_average_precision(aps: DataFrame) -> DataFrame:
    """AP at .50 and over all thresholds, per label and over labels."""
    per = aps.groupBy("label").agg(F.max(F.when(F.col("t") == 0.5, F.col("ap"))).alias("ap50"), F.avg("ap").alias("ap50_95"))
    return per.unionByName(per.agg(F.lit("(all)").alias("label"), F.avg("ap50").alias("ap50"), F.avg("ap50_95").alias("ap50_95"))).select("label", F.round("ap50", 4).alias("ap50"), F.round("ap50_95", 4).alias("ap50_95"))


#: Pairs of boxes that are compared at a time.
PAIRS = 1 << 20


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """As doubles, null as NaN, which overlaps nothing and reaches nothing."""
    return column.cast(pa.float64()).combine_chunks().to_numpy(zero_copy_only=False)


def _pairs_over(corners: np.ndarray, left: np.ndarray, first: np.ndarray, counts: np.ndarray, test) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row of ``left`` and each of the ``counts`` rows from ``first`` on whose overlap passes, compared ``PAIRS`` at a time."""
    found, at, ends = [], 0, np.cumsum(counts)
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = counts[at:to]
        i = np.repeat(left[at:to], n)
        j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:to], n)
        d, g = corners[i], corners[j]
        inter = np.clip(np.minimum(d[:, 2:], g[:, 2:]) - np.maximum(d[:, :2], g[:, :2]), 0, None).prod(1)
        union = (d[:, 2:] - d[:, :2]).prod(1) + (g[:, 2:] - g[:, :2]).prod(1) - inter
        ok = test(np.where(union > 0, inter / np.where(union > 0, union, 1), 0))
        found.append((i[ok], j[ok]))
        at = to
    return tuple(np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))


def _images(batches):
    """Tables of whole images and labels, in which rows of one lie together, with where each begins; the last of a batch waits for its rest."""

    def begins(t: pa.Table) -> np.ndarray:
        out = np.zeros(len(t), bool)
        out[:1] = True
        image, label = t.column("img_id").combine_chunks(), t.column("label").combine_chunks().dictionary_encode().indices
        for codes, none in ((image.fill_null(0).to_numpy(zero_copy_only=False), image.is_null()), (label.fill_null(-1).to_numpy(zero_copy_only=False), label.is_null())):
            none = none.to_numpy(zero_copy_only=False)
            out[1:] |= (codes[1:] != codes[:-1]) | (none[1:] != none[:-1])
        return np.nonzero(out)[0]

    left = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if left is None else pa.concat_tables([left, t])
        if len(t):
            starts = begins(t)
            if starts[-1] > 0:
                yield t.slice(0, int(starts[-1])), starts[:-1]
            left = t.slice(int(starts[-1]))
    if left is not None and len(left):
        yield left, np.zeros(1, np.int64)


def _by_rank(rank: np.ndarray):
    """Places of equal ranks, by rank."""
    order = np.argsort(rank, kind="stable")
    return np.split(order, np.nonzero(np.diff(rank[order]))[0] + 1) if len(order) else []


def greedy_counts(dets: DataFrame, truths: DataFrame, confidences: list[float], overlap: float = 0.5, per_image: bool = True) -> DataFrame:
    """Per label and confidence: detections from there on, truths, and those matched, each detection in input
    order taking the first free truth it overlaps enough.  Boxes of an image and label lie together, and many
    images are matched at a time, their first detections, then their second ones; without ``per_image`` counts
    are summed as they are made, ``img_id`` is null and a label may have several rows."""
    box = lambda df, truth, idx, sure: df.select("img_id", "label", F.lit(truth).alias("truth"), F.col(idx).alias("idx"), sure.cast("double").alias("confidence"), *BOX)
    boxes = box(dets, False, "det_idx", F.col("confidence")).unionByName(box(truths, True, "gt_idx", F.lit(None)))
    sorted_ = boxes.repartition("img_id", "label").sortWithinPartitions("img_id", "label", "truth", "idx", "confidence", *BOX)

    def run(batches):
        for t, starts in _images(batches):
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(t))))
            truth, conf = t.column("truth").to_numpy().astype(bool), _numbers(t.column("confidence"))
            corners = np.stack([_numbers(t.column(c)) for c in BOX], 1)
            labels = t.column("label").take(pa.array(starts)).combine_chunks()
            known = t.column("img_id").is_valid().to_numpy() & t.column("label").is_valid().to_numpy()  # null is like no other null
            n_gt = np.bincount(group[truth], minlength=len(starts))
            d = np.nonzero(~truth & known)[0]
            first = np.append(starts[1:], len(t)) - n_gt  # truths stand behind the detections
            i, j = _pairs_over(corners, d, first[group[d]], n_gt[group[d]], lambda x: x >= overlap)
            ranks = _by_rank(i - starts[group[i]])
            n_det, n_tp = np.zeros((len(confidences), len(starts)), np.int64), np.zeros((len(confidences), len(starts)), np.int64)
            for k, c in enumerate(confidences):
                taken = np.zeros(len(t), bool)
                for at in ranks:  # one detection an image, so none takes another's
                    free = at[(conf[i[at]] >= c) & ~taken[j[at]]]
                    taken[j[free[np.unique(i[free], return_index=True)[1]]]] = True
                n_det[k] = np.bincount(group[~truth & (conf >= c)], minlength=len(starts))
                n_tp[k] = np.bincount(group[taken], minlength=len(starts))
            images = t.column("img_id").take(pa.array(starts)).combine_chunks()
            if not per_image:
                codes = labels.dictionary_encode(null_encoding="encode")
                own, labels = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary
                total = lambda x: np.bincount(own, weights=x, minlength=len(labels)).astype(np.int64)  # noqa: B023, E731
                n_gt, n_det, n_tp = total(n_gt), np.stack([total(x) for x in n_det]), np.stack([total(x) for x in n_tp])
                images = pa.nulls(len(labels), pa.int64())
            for k, c in enumerate(confidences):
                columns = [images.cast(pa.int64()), labels, pa.array(np.full(len(labels), c)), pa.array(n_det[k]), pa.array(n_gt.astype(np.int64)), pa.array(n_tp[k])]
                yield pa.RecordBatch.from_arrays(columns, names=["img_id", "label", "conf", "n_det", "n_gt", "n_tp"])

    return sorted_.mapInArrow(run, "img_id long, label string, conf double, n_det long, n_gt long, n_tp long")


def rates(counts: DataFrame, keys: list[str]) -> DataFrame:
    s = counts.groupBy(*keys).agg(F.sum("n_det").alias("n_det"), F.sum("n_gt").alias("n_gt"), F.sum("n_tp").alias("n_tp"))
    p, r = F.col("n_tp") / F.greatest(F.lit(1), F.col("n_det")), F.col("n_tp") / F.greatest(F.lit(1), F.col("n_gt"))
    return s.withColumn("precision", F.round(p, 4)).withColumn("recall", F.round(r, 4)).withColumn("f1", F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4))


def best_threshold(swept: DataFrame, default: float = 0.35) -> DataFrame:
    """Per label the confidence of the best F1, the lowest on a tie; the default without any truth."""
    best = swept.groupBy("label").agg(F.max_by("conf", F.struct("f1", -F.col("conf"))).alias("conf"), F.max("f1").alias("f1"), F.max("n_gt").alias("n_gt"))
    return best.select("label", F.when(F.col("n_gt") > 0, F.col("conf")).otherwise(default).alias("conf"), "f1")


def suppress(dets: DataFrame, overlap: float = 0.45) -> DataFrame:
    """Non-maximum suppression within image and label; boxes of one lie together, the surest first, and many images go at a
    time, their first boxes, then their second ones."""
    known = dets.where(F.col("img_id").isNotNull() & F.col("label").isNotNull())
    sorted_ = known.repartition("img_id", "label").sortWithinPartitions("img_id", "label", -F.col("confidence"), "det_idx", *BOX)

    def run(batches):
        for t, starts in _images(batches):
            sizes = np.diff(np.append(starts, len(t)))
            rank = np.arange(len(t)) - np.repeat(starts, sizes)
            corners = np.stack([_numbers(t.column(c)) for c in BOX], 1)
            i, j = _pairs_over(corners, np.arange(len(t)), np.arange(len(t)) + 1, np.repeat(sizes, sizes) - rank - 1, lambda x: x > overlap)
            alive = np.ones(len(t), bool)
            for at in _by_rank(rank[i]):
                alive[j[at[alive[i[at]]]]] = False
            yield from t.filter(pa.array(alive)).combine_chunks().to_batches()

    return sorted_.mapInArrow(run, dets.schema)


def roc(scores: DataFrame) -> DataFrame:
    """ROC points from (score, positive): per distinct score (and 0 and 1) the rates from there on, to 4 decimals.

    Counts per score are summed within bands of a thousandth and moved by the bands above.
    """
    ends = scores.limit(1).select(F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("score")).withColumn("p", F.lit(0)).withColumn("n", F.lit(0))
    each = scores.select("score", F.col("positive").cast("int").alias("p"), (1 - F.col("positive").cast("int")).alias("n")).unionByName(ends)
    by = each.groupBy("score").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).withColumn("band", F.floor(F.col("score") * 1000))
    above = W.orderBy(F.col("band").desc()).rowsBetween(W.unboundedPreceding, -1)  # bands, of which there are about a thousand
    bands = by.groupBy("band").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    moved = bands.select("band", F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("n0"))
    down = W.partitionBy("band").orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, 0)
    total = bands.agg(F.sum("bp").alias("tp_all"), F.sum("bn").alias("fp_all"))  # one row
    run = by.join(moved, "band").withColumn("tp", F.sum("p").over(down) + F.col("p0")).withColumn("fp", F.sum("n").over(down) + F.col("n0")).crossJoin(F.broadcast(total))
    return run.select(F.round("score", 4).alias("threshold"), F.round(F.col("fp") / F.col("fp_all"), 4).alias("fpr"), F.round(F.col("tp") / F.col("tp_all"), 4).alias("tpr"))


def auc(points: DataFrame, at: float = 0.05) -> DataFrame:
    """Trapezoid area, and the best true rate at a false rate up to ``at``.

    Both rates rise together and have four decimals, so there are at most 20,001 distinct points to order.
    """
    w = W.orderBy("fpr", "tpr")
    steps = points.select("fpr", "tpr").distinct().withColumn("f0", F.lag("fpr").over(w)).withColumn("t0", F.lag("tpr").over(w))
    return steps.agg(F.round(F.sum((F.col("fpr") - F.col("f0")) * (F.col("tpr") + F.col("t0")) / 2), 4).alias("auc"), F.coalesce(F.max(F.when(F.col("fpr") <= at + 1e-5, F.col("tpr"))), F.lit(0.0)).alias("tpr_at"))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def centres_of(points: np.ndarray, most: int) -> np.ndarray:
    """Unit vectors among ``points``, each the farthest from those before it, in a chain of near ones."""
    chosen, near = [0], points @ points[0]
    while len(chosen) < min(most, len(points)) and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, points @ points[chosen[-1]])
    centres, order, left = points[chosen], [0], list(range(1, len(chosen)))
    while left:
        order.append(left.pop(int((centres[left] @ centres[order[-1]]).argmax())))
    return centres[order]


class PairPlan:
    """Cells of unit vectors around centres, cut into blocks and tiles, and which cells can hold a pair at ``least`` or above.

    Two vectors are at least as far apart as their centres less both radii, all as angles; a cell with a
    vector of zeros (``zero``) has no radius and meets all.
    """

    def __init__(self, centres: np.ndarray, sizes: np.ndarray, radii: np.ndarray, zero: bool, least: float, block: int, tile: int):
        self.sizes, self.block, self.tile = sizes, block, tile
        blocks = -(-sizes // block)
        self.first = np.cumsum(blocks) - blocks  # number of a cell's first block
        apart = np.arccos(np.clip(centres @ centres.T, -1, 1)) - radii[:, None] - radii[None, :]
        self.wanted = np.ones((len(sizes), len(sizes)), bool)
        self.wanted[: len(centres), : len(centres)] = apart <= (np.arccos(np.clip(least, -1, 1)) + 1e-6 if least > -1 else np.inf)
        if not zero:
            self.wanted[len(centres) :] = self.wanted[:, len(centres) :] = False
        self.tiles = max(1, -(-int(blocks.sum()) // tile))

    def tiles_of(self, tile: int) -> np.ndarray:
        """The tiles that a tile has to meet: cells lie in them one after the other."""
        first, last = self.first // self.tile, (self.first + np.maximum(-(-self.sizes // self.block), 1) - 1) // self.tile
        own = (first <= tile) & (tile <= last) & (self.sizes > 0)
        met = self.wanted[own].any(0) & (self.sizes > 0)
        marks = np.zeros(self.tiles + 1, np.int64)
        np.add.at(marks, first[met], 1)
        np.add.at(marks, np.minimum(last[met] + 1, self.tiles), -1)
        return np.nonzero(np.cumsum(marks)[: self.tiles] > 0)[0]

    def skipped(self) -> float:
        """The share of all pairs that is counted without a look."""
        n = self.sizes.astype(float)
        return 1 - float((self.wanted * np.outer(n, n)).sum()) / max(1.0, float(n.sum()) ** 2)


def _units(batches):
    """Vectors as unit vectors, one of zeros as it is."""
    for batch in batches:
        out = []
        for v in batch.column("v").to_pylist():
            a = np.array(v, float)
            norm = np.linalg.norm(a)
            out.append((a / norm if norm > 0 else np.zeros_like(a)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(out, pa.binary())], names=["k", "v"])


def _stacked(vectors: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v) // 8] = np.frombuffer(v)
    return out


def pair_plan(vectors: DataFrame, key: str, vector: str, least: float, block: int = 1024, tile: int = 32, cells: int = 512, sample: int = 4096) -> tuple[DataFrame, PairPlan, int, int]:
    """Rows (k, v, cell) dealt to at most ``cells`` centres taken from a bounded sample, their plan, how many rows take part and the widest vector."""
    sound = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    rows = vectors.where(sound).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(_units, "k long, v binary")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.length("v")), F.lit(0)) / 8).first()
    width = max(1, int(width))
    drawn = rows if n <= sample else rows.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    points = _stacked(sorted(bytes(r["v"]) for r in drawn.select("v").limit(2 * sample).collect()), width)
    points = points[np.linalg.norm(points, axis=1) > 0]
    centres = centres_of(points, min(cells, 2 * -(-n // block))) if len(points) else np.zeros((0, width))

    def deal(batches):
        for batch in batches:
            m = _stacked(batch.column("v").to_pylist(), width)
            zero = ~m.any(1)
            near = (m @ centres.T).argmax(1) if len(centres) else np.zeros(len(m), np.int64)
            angle = np.arccos(np.clip((m * centres[near]).sum(1), -1, 1)) if len(centres) else np.zeros(len(m))
            near[zero], angle[zero] = len(centres), 0.0
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("v"), pa.array(near, pa.int32()), pa.array(angle)], names=["k", "v", "cell", "angle"])

    dealt = rows.mapInArrow(deal, "k long, v binary, cell int, angle double")
    sizes, radii = np.zeros(len(centres) + 1, np.int64), np.zeros(len(centres))
    for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r")).collect():  # one row a cell
        sizes[r["cell"]] = r["n"]
        if r["cell"] < len(centres):
            radii[r["cell"]] = r["r"] + 1e-7
    # With few rows smaller tiles, so that there are tasks enough.
    plan = PairPlan(centres, sizes, radii, least <= 0, least, block, max(1, min(tile, int(sizes.sum()) // (16 * block))))
    return dealt, plan, int(n), width


def all_pairs(vectors: DataFrame, key: str, vector: str, least: float, block: int = 1024, tile: int = 32) -> tuple[DataFrame, DataFrame]:
    """All pairs i < j by blocks: (how many pairs, how many at or above ``least``) and those pairs.

    Vectors lie around centres in blocks of up to about ``block``, packed as one row, and blocks in tiles;
    a tile is sent to the tiles it has to meet, so a block travels once for every ``tile`` * ``block`` rows
    that may be near it, and no pair below ``least`` becomes a row.  Blocks of cells whose covering radii keep them apart are
    not compared; how many pairs there are is arithmetic.  Rows whose vector is null or holds a null
    take no part; a vector of zeros is like none (its similarity is 0); a shorter vector counts as filled up by zeros.
    """
    dealt, plan, n, width = pair_plan(vectors, key, vector, least, block, tile)
    pieces = F.element_at(F.array(*[F.lit(int(x)) for x in np.maximum(1, -(-plan.sizes // block))]), F.col("cell") + 1)
    cut = dealt.withColumn("piece", F.pmod(F.xxhash64("k"), pieces).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        cell, piece = table.column("cell")[0].as_py(), table.column("piece")[0].as_py()
        rows = sorted(zip(table.column("k").to_pylist(), table.column("v").to_pylist(), strict=True))
        own = int(plan.first[cell] + piece) // plan.tile
        met = [int(t) for t in plan.tiles_of(own)]
        keys, m = np.array([k for k, _ in rows], np.int64).tobytes(), _stacked([v for _, v in rows], width).tobytes()
        columns = {"p": pa.array([min(own, t) for t in met], pa.int32()), "q": pa.array([max(own, t) for t in met], pa.int32()), "own": pa.array([own] * len(met), pa.int32()), "cell": pa.array([cell] * len(met), pa.int32())}
        return pa.table(columns | {"keys": pa.array([keys] * len(met), pa.binary()), "m": pa.array([m] * len(met), pa.binary())})

    def multiply(table: pa.Table, keep: bool) -> pa.Table:
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        blocks = [(own, cell, np.frombuffer(k, np.int64), np.frombuffer(m).reshape(-1, width)) for own, cell, k, m in zip(*[table.column(c).to_pylist() for c in ("own", "cell", "keys", "m")], strict=True)]
        blocks.sort(key=lambda b: (b[0], b[1], b[2][0]))
        found, above = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]], 0
        for x, (own, cell, keys, m) in enumerate(blocks):
            for y in range(x, len(blocks)):
                if own != p or blocks[y][0] != q or not plan.wanted[cell, blocks[y][1]]:
                    continue
                s = m @ blocks[y][3].T
                if x == y:
                    s[np.tril_indices(len(keys))] = -2.0  # each pair once
                near = s >= max(least, -1.5)
                above += int(near.sum())
                if not keep:  # only counted: a tile's pairs may be all there can be, and none is held
                    continue
                i, j = np.nonzero(near)
                for column, value in zip(found, (np.minimum(keys[i], blocks[y][2][j]), np.maximum(keys[i], blocks[y][2][j]), s[i, j]), strict=True):
                    column.append(value)
        a, b, sim = (np.concatenate(c) for c in found)
        total = [pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.float64()), pa.array([above], pa.int64())]
        rest = [pa.array(a), pa.array(b), pa.array(sim), pa.array([0] * len(a), pa.int64())]
        return pa.table({name: pa.chunked_array([t, r]) for name, t, r in zip(("a", "b", "sim", "n_above"), total, rest, strict=True)})

    packed = cut.groupBy("cell", "piece").applyInArrow(pack, "p int, q int, own int, cell int, keys binary, m binary").groupBy("p", "q")
    met = lambda keep: packed.applyInArrow(lambda t: multiply(t, keep), "a long, b long, sim double, n_above long")
    everything = vectors.sparkSession.createDataFrame([(n * (n - 1) // 2, 0)], "n_pairs long, n_above long")
    return met(False).where(F.col("a").isNull()).select(F.lit(0).cast("long").alias("n_pairs"), "n_above").unionByName(everything), met(True).where(F.col("a").isNotNull()).select("a", "b", "sim")


def sign_hash(vector: Column) -> Column:
    """64 bits: the signs of the first 64 components."""
    return F.aggregate(F.transform(F.slice(vector, 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def near_hashes(left: DataFrame, right: DataFrame, key: str, hash_: str, most: int = 6, blocks: int = 8) -> DataFrame:
    """Pairs of the two sides (whose keys are unique) whose 64-bit hashes differ in at most ``most`` bits.

    Of ``blocks`` equal parts, ``blocks - most`` at least are equal in such a pair, so the join on every
    choice of that many parts loses none; with eight parts the keys have 16 bits.  A pair comes out at the
    first choice it meets by, that of its first equal parts, so none is told from another afterwards.
    """
    size, kept = 64 // blocks, blocks - most
    part = lambda h, i: F.shiftrightunsigned(h, i * size).bitwiseAND(F.lit((1 << size) - 1))

    def keys(h: Column) -> Column:
        chosen = list(combinations(range(blocks), kept))
        value = lambda c: reduce(lambda v, i: F.shiftleft(v, size).bitwiseOR(part(h, i)), c, F.lit(0).cast("long"))
        return F.array(*[F.struct(F.lit(n).alias("i"), value(c).alias("v")) for n, c in enumerate(chosen)])

    l = left.select(F.col(key).alias("a"), F.col(hash_).alias("ha"), F.explode(keys(F.col(hash_))).alias("x"))
    r = right.select(F.col(key).alias("b"), F.col(hash_).alias("hb"), F.explode(keys(F.col(hash_))).alias("x"))
    other = F.col("ha").bitwiseXOR(F.col("hb"))
    bits = F.bit_count(other)
    equal = reduce(lambda m, i: m.bitwiseOR(F.when(part(other, i) == 0, 1 << i).otherwise(0)), range(blocks), F.lit(0))
    passed = [sum(1 << i for i in range(max(c)) if i not in c) for c in combinations(range(blocks), kept)]  # parts before the last one chosen that were not
    first = equal.bitwiseAND(F.element_at(F.array(*[F.lit(m) for m in passed]), F.col("x.i") + 1)) == 0
    return l.join(r, "x").where((bits <= most) & first).select("a", "b", bits.alias("bits"))


def distribution(df: DataFrame, value: str) -> DataFrame:
    q = lambda p: F.round(F.percentile(value, F.lit(p)), 4)
    return df.agg(F.count(value).alias("n"), F.round(F.min(value), 4).alias("min"), *[q(p / 100).alias(f"p{p}") for p in (10, 25, 50, 75, 90, 95, 99)], F.round(F.max(value), 4).alias("max"), F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev_pop(value), 4).alias("std"))


def confusion_rates(df: DataFrame, least: int = 30) -> DataFrame:
    """Precision, recall and F1 per class from (truth, predicted), with accuracy and macro F1, and whether the class has enough rows."""
    cells = df.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    sums = cells.select(F.explode(F.array(F.struct(F.col("truth").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x"), "n", (F.col("truth") == F.col("predicted")).alias("same"))
    per = sums.groupBy(F.col("x.c").alias("class")).agg(F.sum(F.col("x.t") * F.col("n")).alias("support"), F.sum(F.col("x.p") * F.col("n")).alias("predicted"), F.sum(F.when(F.col("same") & (F.col("x.t") == 1), F.col("n")).otherwise(0)).alias("hits"))
    p, r = F.col("hits") / F.greatest(F.lit(1), F.col("predicted")), F.col("hits") / F.greatest(F.lit(1), F.col("support"))
    rated = per.withColumn("precision", F.round(p, 4)).withColumn("recall", F.round(r, 4)).withColumn("f1", F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4))
    every = rated.agg(F.round(F.sum("hits") / F.sum("support"), 4).alias("accuracy"), F.round(F.avg("f1"), 4).alias("macro_f1"))  # one row
    return rated.crossJoin(F.broadcast(every)).withColumn("status", F.when(F.col("support") >= least, "MEASURED").otherwise("TOO_FEW"))


def false_positive_rates(df: DataFrame, source: str, fired: Column, gate: float = 0.05) -> DataFrame:
    """Per source and over all (null source)."""
    out = df.withColumn("__f", fired.cast("int")).rollup(source).agg(F.count("*").alias("n"), F.sum("__f").alias("fired"))
    return out.withColumn("rate", F.round(F.col("fired") / F.col("n"), 4)).withColumn("passes", F.col("fired") <= gate * F.col("n"))


def model_parity(old: DataFrame, new: DataFrame, least: float = 0.95) -> DataFrame:
    """Per image: the surest box of either model, and whether they agree or are both absent."""
    top = lambda df, p: df.groupBy("img_id").agg(F.max_by(F.struct(*BOX), F.struct("confidence", -F.col("det_idx"))).alias("x")).select("img_id", *[F.col(f"x.{c}").alias(p + c) for c in BOX])
    both = top(old, "").join(top(new, "g_"), "img_id", "full_outer")
    return both.withColumn("overlap", F.when(F.col("x1").isNotNull() & F.col("g_x1").isNotNull(), iou())).select("img_id", F.round("overlap", 6).alias("overlap"), F.coalesce(F.col("overlap") >= least, F.lit(False)).alias("same"))


def gates(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """PASS, FAIL or UNMEASURED per threshold row; a missing metric fails unless its threshold is 0."""
    v, t = F.col("value"), F.col("threshold")
    meets = F.when(F.col("comparator") == ">=", v >= t).when(F.col("comparator") == "<=", v <= t).otherwise(v == t)
    state = F.when(v.isNull() & (t == 0), "UNMEASURED").when(v.isNull(), "FAIL").when(meets, "PASS").otherwise("FAIL")
    return thresholds.join(metrics, "metric", "left").withColumn("state", state)


def verdict(*gate_tables: DataFrame) -> DataFrame:
    """GO if no gate fails, and how many do."""
    failing = reduce(lambda a, b: a.unionByName(b), [g.select("metric", "state") for g in gate_tables]).where("state = 'FAIL'")
    return failing.agg(F.count("*").alias("blocking")).withColumn("verdict", F.when(F.col("blocking") == 0, "GO").otherwise("NO_GO"))


def reconcile(claimed: DataFrame, measured: DataFrame) -> DataFrame:
    """Claims against measurements by kind of tolerance: points, relative percent, or exact."""
    c, m = F.col("claimed"), F.col("measured")
    gap = F.abs(c - m)
    ok = F.when(F.col("kind") == "pct_point", gap <= F.col("tolerance")).when(F.col("kind") == "rel_pct", gap <= F.abs(c) * F.col("tolerance") / 100).otherwise(c == m)
    state = F.when(c.isNull(), "UNCLAIMED").when(m.isNull(), "UNMEASURED").when(ok, "MATCH").otherwise("MISMATCH")
    return claimed.join(measured, "metric", "full_outer").withColumn("state", state)


def liveness(frames: DataFrame, travel: float = 20.0, dip: float = 0.20, least: int = 3) -> DataFrame:
    """Per capture: least eye ratio, dips, travel of the head, and whether it moved or blinked."""
    out = frames.groupBy("capture").agg(F.count("*").alias("frames"), F.min("ear").alias("min_ear"), F.sum((F.col("ear") < dip).cast("int")).alias("dips"), (F.max("px") - F.min("px")).alias("travel_x"), (F.max("py") - F.min("py")).alias("travel_y"))
    alive = (F.col("dips") > 0) | (F.col("travel_x") >= travel) | (F.col("travel_y") >= travel)
    return out.withColumn("alive", F.when(F.col("frames") >= least, alive))


def latency_figures(df: DataFrame, value: str) -> DataFrame:
    """Interpolated p50, p95 and p99 and the mean, and the p95 taken at place int(.95 n)."""
    exact = df.agg(*[F.round(F.percentile(value, F.lit(p / 100)), 4).alias(f"p{p}") for p in (50, 95, 99)], F.round(F.avg(value), 4).alias("mean"))
    counted = df.groupBy(value).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))  # one row
    run = counted.withColumn("upto", F.sum("n").over(W.orderBy(value).rowsBetween(W.unboundedPreceding, 0))).crossJoin(F.broadcast(total))
    placed = run.agg(F.min(F.when(F.col("upto") > F.floor(F.col("total") * 0.95), F.col(value))).cast("double").alias("p95_placed"))
    return exact.crossJoin(F.broadcast(placed))  # one row each


def field_robustness(matched: DataFrame, condition: str, ms: str, overlap: float = 0.5) -> DataFrame:
    """Per condition: share of detections that overlap a truth at all and enough, mean overlap, and the time at place int(.95 n).

    Whole milliseconds are counted first, so what is ordered is distinct values.
    """
    figures = matched.groupBy(condition).agg(F.count("*").alias("n"), F.round(F.avg(F.col("iou").isNotNull().cast("double")), 4).alias("detect_rate"), F.round(F.avg("iou"), 4).alias("mean_iou"), F.round(F.avg(F.coalesce(F.col("iou") >= overlap, F.lit(False)).cast("double")), 4).alias("id_recall"))
    counted = matched.groupBy(condition, ms).agg(F.count("*").alias("k"))
    upto = counted.withColumn("upto", F.sum("k").over(W.partitionBy(condition).orderBy(ms).rowsBetween(W.unboundedPreceding, 0))).join(figures.select(condition, "n"), condition)
    p95 = upto.groupBy(condition).agg(F.min(F.when(F.col("upto") > F.floor(F.col("n") * 0.95), F.col(ms))).alias(f"p95_{ms}"))
    return figures.join(p95, condition)


def leak_verdict(checks: dict[str, DataFrame]) -> DataFrame:
    """One row per check: how many rows it found and whether it passes (none), and one over all."""
    rows = reduce(lambda a, b: a.unionByName(b), [df.agg(F.count("*").alias("found")).select(F.lit(k).alias("check"), "found") for k, df in checks.items()])
    return rows.unionByName(rows.agg(F.lit("(all)").alias("check"), F.sum("found").alias("found"))).withColumn("passes", F.col("found") == 0)
