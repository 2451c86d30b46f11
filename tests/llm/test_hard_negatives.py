"""Hard negatives against all pairs."""

import numpy as np
import pytest

from passgrid.llm import hard_negatives as mined
from passgrid.llm.common import documents
from passgrid.llm.hard_negatives import Index, codebook, hard_negatives
from passgrid.llm.registry import QUERIES


def brute(rows, every, positives=5, negatives=5, share=80, scale=256):
    """The definition, over (id, label, vector) rows."""
    kept = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((i, label, [int(x) for x in np.floor(scale * np.array(v, np.float64))]))
    out = []
    for i, label, v in kept:
        if i % every:
            continue
        score = lambda w: sum(x * y for x, y in zip(v, w, strict=False))  # noqa: B023, E731
        scored = sorted((-score(w), j, other) for j, other, w in kept)
        best = [(-s, j) for s, j, other in scored if other == label and j != i][:positives]
        for p, j in best:
            window = [(-s, k) for s, k, other in scored if other != label and share * p <= -100 * s <= 100 * p][:negatives]
            out += [(i, j, rank, k, p, s) for rank, (s, k) in enumerate(window, 1)]
    return sorted(out)


def vectors(n, seed, dims=6, clusters=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    which = rng.integers(0, clusters, n)
    points = (centres[which] + 0.2 * rng.normal(size=(n, dims))).round(2)
    return [(int(i), int(c if i % 7 else (c + 1) % clusters), [float(x) for x in p]) for i, (c, p) in enumerate(zip(which, points, strict=True))]


SCHEMA = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("cell,chunk,group", [(2048, 4096, 256), (12, 9, 2), (3, 100, 1)])
def test_all_pairs(spark, monkeypatch, cell, chunk, group):
    for name, value in (("CELL", cell), ("CHUNK", chunk), ("GROUP", group)):
        monkeypatch.setattr(mined, name, value)
    rows = vectors(600, 4)
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(map(tuple, hard_negatives(table, every=20, scale=16, enough=30).collect()))
    assert got == brute(rows, 20, scale=16) and len(got) > 100


def test_cells_come_by_falling_bound_and_some_are_skipped():
    rng = np.random.default_rng(1)
    points = np.floor(256 * np.concatenate([c + 0.03 * rng.normal(size=(300, 8)) for c in rng.normal(size=(20, 8))]))
    books = codebook(points[:, :4], 12), codebook(points[:, 4:], 12)
    near = [mined.nearest(points[:, s], b) for s, b in ((slice(0, 4), books[0]), (slice(4, 8), books[1]))]
    cell = near[0][0] * 12 + near[1][0]
    index = Index(books, [(int(c), int((cell == c).sum()), near[0][1][cell == c].max(), near[1][1][cell == c].max()) for c in np.unique(cell)])
    skipped = 0
    for anchor in points[::500]:
        scores = points @ anchor
        walked = list(index.walk(anchor))
        assert [w[1] for w in sorted(walked, key=lambda w: -w[0])] == [w[1] for w in walked]
        assert sorted(w[1] for w in walked) == np.unique(cell).tolist()
        for bound, c, most, least in walked:
            assert least <= scores[cell == c].min() and scores[cell == c].max() <= most <= bound + 1e-3
        low = int(np.sort(scores)[-5])
        seen = index.first(anchor, 50) + index.rest(anchor, 50, low, 2**63 - 1)
        assert set(cell[scores >= low]) <= set(seen)
        skipped += len(walked) - len(seen)
    assert skipped > 0


def test_hard_rows(spark):
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 1, [0.5, 0.5]), (3, 2, [1.0, 0.4]), (4, 2, [1.0, 0.4]), (4, 2, [1.0, 0.4]), (5, None, [1.0, 0.4]), (None, 2, [1.0, 0.4])]
    rows += [(6, 2, None), (7, 2, [1.0, None]), (8, 2, [float("nan"), 1.0]), (9, 2, [float("inf"), 1.0]), (10, 2, [1.0]), (11, 2, []), (12, 3, [-1.0, -1.0]), (20, 3, [-1.0, 0.0]), (30, 4, [0.0, 0.0]), (31, 4, [0.0, 0.0])]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS `a.b`", "1 AS label2", "'y' AS cell", "'z' AS rank").repartition(2)
    got = sorted(map(tuple, hard_negatives(table, every=10).collect()))
    assert got == brute(rows, 10)
    assert {r[0] for r in got} >= {0, 30} and (30, 31, 1, 0, 0, 0) in got
    assert hard_negatives(table.where("vec_id < 0")).collect() == [] and hard_negatives(table.where("vec_id = 2")).collect() == []


def test_a_third_of_the_rows_equal(spark, monkeypatch):
    monkeypatch.setattr(mined, "CHUNK", 50)
    rows = vectors(300, 9) + [(1000 + i, i % 3, [0.5, -0.25, 0.5, 0.1, 0.2, 0.0]) for i in range(150)]
    assert sorted(map(tuple, hard_negatives(spark.createDataFrame(rows, SCHEMA), every=50, scale=16, enough=40).collect())) == brute(rows, 50, scale=16)


def test_registered_query(spark, small):
    rows = [(r.vec_id, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in documents(spark, small, "embeddings").collect()]
    got = sorted(map(tuple, QUERIES["op12_hard_negatives"](spark, small).collect()))
    assert got == brute(rows, 100) and got
