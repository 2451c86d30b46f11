"""Exact top-k search by inner product with dual cover trees (operator 3).

Vectors and queries are dealt to the same cover tree, level by level: the centres of a node's
children are found by farthest-first traversal of a bounded sample of its rows, every row goes to
the nearest one, and a node is open as long as it holds more rows than a chunk.  Each leaf's chunk
of data and each group of queries is a subtree, built where it is searched.  A first round searches
every query group against its home chunk.  Then the groups go down the tree: a node is entered if
its bound (inner product of centres, covering radii) can still reach the group's worst k-th score,
and in the chunks that are reached both subtrees are walked together under the same test.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passgrid.llm.common import col, spread_join, staged

#: Rows of a data chunk, rows of a query group, rows of a leaf, children of a node at most.
CHUNK, GROUP, LEAF, FAN_OUT = 4096, 512, 256, 16
#: Levels of the tree at most (numbers of nodes stay below a long), and bytes of centres that the driver hands out at once.
LEVELS, CENTRE_BYTES = 14, 32 << 20


def farthest_first(points: np.ndarray, most: int, radius: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Indices of centres, each the point farthest from those before it, until ``radius`` covers all; and each point's nearest centre."""
    centres, near = [0], np.zeros(len(points), np.int64)
    distance = np.linalg.norm(points - points[0], axis=1)
    while len(centres) < most and distance.max() > radius:
        new = int(distance.argmax())
        d = np.linalg.norm(points - points[new], axis=1)
        near[d < distance] = len(centres)
        distance = np.minimum(distance, d)
        centres.append(new)
    return np.array(centres), near


class CoverTree:
    """Nodes over rows of a matrix: centre, covering radius, children or a leaf's rows.

    Children are points more than half the node's radius apart that cover it at that radius; a
    node that would need more than ``FAN_OUT`` of them keeps the first and their own radii.
    """

    def __init__(self, points: np.ndarray):
        self.points, self.centre, self.radius, self.children, self.rows = points, [], [], [], []
        self._node(np.arange(len(points)))
        self.centre = np.array(self.centre)
        self.radius = np.array(self.radius) * (1 + 1e-9) + 1e-6
        self.norm = np.linalg.norm(self.centre, axis=1)

    def _node(self, rows: np.ndarray) -> int:
        own = self.points[rows]
        middle = own[np.linalg.norm(own - own.mean(0), axis=1).argmin()]
        radius, number = float(np.linalg.norm(own - middle, axis=1).max()), len(self.radius)
        self.centre.append(middle)
        self.radius.append(radius)
        self.children.append([])
        self.rows.append(rows)
        if len(rows) > LEAF and radius > 0:
            _, near = farthest_first(own, FAN_OUT, radius / 2)
            self.children[number] = [self._node(rows[near == k]) for k in range(near.max() + 1) if (near == k).any()]
        return number


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles; beyond a long they stay at its ends."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = [[int(x) for x in row] for row in a], [[int(x) for x in row] for row in b]
    return np.array([[max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(p, q, strict=True)))) for q in exact[1]] for p in exact[0]], np.int64)


class Best:
    """The k best (score, id) of each query so far; ties to the smaller id.

    What reaches a query's worst kept score waits in a list, which is merged when it has grown to
    a few times what can be kept.
    """

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray):
        self.query_ids, self.k, self.least = ids, k, floor.astype(float)
        self.kept = [np.zeros(0, np.int64)] * 3  # query row, candidate id, score
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.n_waiting = 0

    def worst(self, rows: np.ndarray) -> float:
        return float(self.least[rows].min())

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        reach = (scores >= self.least[rows][:, None]) & (ids[None, :] != self.query_ids[rows][:, None])
        r, c = np.nonzero(reach)
        self.waiting.append((rows[r], ids[c], scores[r, c]))
        self.n_waiting += len(r)
        if self.n_waiting > 4 * self.k * len(self.query_ids):
            self.merge()

    def merge(self) -> list[np.ndarray]:
        rows, ids, scores = (np.concatenate([a, *b]) for a, b in zip(self.kept, zip(*self.waiting, strict=True), strict=True)) if self.waiting else self.kept
        order = np.lexsort((ids, np.invert(scores), rows))  # ~score orders longs downwards
        rows, ids, scores = rows[order], ids[order], scores[order]
        sizes = np.bincount(rows, minlength=len(self.query_ids))
        place = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        last = place == self.k - 1
        self.least[rows[last]] = np.maximum(self.least[rows[last]], scores[last])
        self.kept = [a[place < self.k] for a in (rows, ids, scores)]
        self.waiting, self.n_waiting = [], 0
        return self.kept


def dual_search(queries: CoverTree, data: CoverTree, data_ids: np.ndarray, best: Best) -> None:
    """Walk both trees together; a pair of nodes goes when its bound is below its query node's worst k-th score."""

    def bound(q: int, d: np.ndarray) -> np.ndarray:
        reach = data.centre[d] @ queries.centre[q]
        return reach + queries.radius[q] * data.norm[d] + data.radius[d] * queries.norm[q] + queries.radius[q] * data.radius[d]

    stack = [(0, 0, float(bound(0, np.array([0]))[0]))]
    while stack:
        q, d, most = stack.pop()
        rows = queries.rows[q]
        if most < best.worst(rows):
            continue
        if queries.children[q] and (not data.children[d] or queries.radius[q] >= data.radius[d]):
            stack += [(c, d, float(bound(c, np.array([d]))[0])) for c in queries.children[q]]
        elif data.children[d]:
            below = np.array(data.children[d])
            bounds = bound(q, below)
            order = bounds.argsort()  # the most promising is taken first
            stack += [(q, int(below[o]), float(bounds[o])) for o in order]
        else:
            for at in range(0, len(data.rows[d]), 4 * LEAF):  # equal vectors make leaves of any size
                own = data.rows[d][at : at + 4 * LEAF]
                best.offer(rows, data_ids[own], inner(queries.points[rows], data.points[own]))


def _matrix(vectors: list[bytes]) -> np.ndarray:
    width = max(map(len, vectors)) // 8
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v) // 8] = np.frombuffer(v)
    return out


def _same_width(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


ROW_SCHEMA = "vec_id long, vector binary"


def _whole_numbers(scale: int):
    """Rows that take part, their components floor(scale * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or v is None or any(x is None for x in v):
                    continue
                with np.errstate(over="ignore"):
                    a = np.floor(scale * np.array(v, np.float64))
                if np.isfinite(a).all():
                    ids.append(i)
                    out.append(a.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "vector"])

    return run


def _rows_of(nodes: np.ndarray, known: dict[int, object]) -> Iterator[tuple[int, np.ndarray]]:
    """The places of every known node's rows."""
    order = nodes.argsort(kind="stable")
    for place in np.split(order, np.nonzero(np.diff(nodes[order]))[0] + 1) if len(order) else []:
        if (node := int(nodes[place[0]])) in known:
            yield node, place


def _sampled(counts: dict[int, int], sample: int):
    """About ``sample`` rows of every open node, by a hash of id and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, draw = batch.column("node").to_numpy(), batch.column("draw").to_numpy()
            taken = np.concatenate([place[draw[place] < sample / counts[node]] for node, place in _rows_of(nodes, counts)] or [np.zeros(0, np.int64)])
            some = batch.take(pa.array(taken))
            yield pa.RecordBatch.from_arrays([some.column("node"), some.column("vector")], names=["node", "vector"])

    return run


def _centres(counts: dict[int, int]):
    def run(table: pa.Table) -> pa.Table:
        points = _matrix(sorted(table.column("vector").to_pylist()))
        node = table.column("node")[0].as_py()
        centres = points[farthest_first(points, min(FAN_OUT, 2 * -(-counts[node] // CHUNK)))[0]]
        return pa.table({"node": [node], "width": pa.array([points.shape[1]], pa.int32()), "centres": pa.array([centres.tobytes()], pa.binary())})

    return run


def _deal(centres: dict[int, np.ndarray]):
    """Rows of open nodes go to the child of the nearest centre; their distance to it makes its covering radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, place in _rows_of(batch.column("node").to_numpy(), centres):
                own = batch.take(pa.array(place))
                m, top = _matrix(own.column("vector").to_pylist()), centres[node]
                width = max(m.shape[1], top.shape[1])
                m, top = _same_width(m, width), _same_width(top, width)
                near = ((top**2).sum(1)[None, :] - 2 * m @ top.T).argmin(1)
                distance = np.linalg.norm(m - top[near], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [own.column("vec_id"), own.column("vector"), own.column("draw"), pa.array(node * FAN_OUT + near + 1), pa.array(distance)], names=["vec_id", "vector", "draw", "node", "distance"]
                )

    return run


DEALT = "vec_id long, vector binary, draw double, node long, distance double"
BALL = "node long, centre array<double>"


def _tree(rows: DataFrame, n: int, width: int, sample: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows with their leaf (``node``) and its chunk (``piece``), and per level the nodes with parent, centre, radius and ``open``.

    The children of node x are x * FAN_OUT + 1, ...  A node that its centres do not part (equal
    vectors) is closed at any size, and cut into chunks by a hash.  The driver sees the open nodes'
    numbers and centres, in portions of at most CENTRE_BYTES.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("draw", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 40)) / float(1 << 40)).withColumn("node", F.lit(0).cast("long"))
    if n <= CHUNK:
        return rows.withColumn("piece", F.lit(0)).select("vec_id", "vector", "node", "piece"), []
    open_nodes, leaves, levels = spark.createDataFrame([(0, n)], "node long, n long"), [], []
    portion = max(1, CENTRE_BYTES // (FAN_OUT * max(1, width) * 8))
    for _ in range(LEVELS):
        dealt, balls, last = [], [], -1
        while some := open_nodes.where(F.col("node") > last).orderBy("node").limit(portion).collect():
            counts, last = {r["node"]: r["n"] for r in some}, some[-1]["node"]
            own = rows.where(F.col("node").between(some[0]["node"], last))
            found = own.select("node", "vector", "draw").mapInArrow(_sampled(counts, sample), "node long, vector binary").groupBy("node").applyInArrow(_centres(counts), "node long, width int, centres binary").collect()
            centres = {r["node"]: np.frombuffer(r["centres"]).reshape(-1, max(1, r["width"])) for r in found}
            dealt.append(own.mapInArrow(_deal(centres), DEALT))
            balls.append(spark.createDataFrame([(node * FAN_OUT + k + 1, c.tolist()) for node, top in centres.items() for k, c in enumerate(top)], BALL))
        if not dealt:
            break
        rows = staged(reduce(DataFrame.unionByName, dealt), "dealt")
        parent = F.floor((F.col("node") - 1) / FAN_OUT).cast("long")
        kids = rows.groupBy("node").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).withColumn("parent", parent)
        kids = kids.join(open_nodes.select(F.col("node").alias("parent"), F.col("n").alias("n_parent")), "parent").join(reduce(DataFrame.unionByName, balls), "node")
        more = (F.col("n") > CHUNK) & (F.col("n") < F.col("n_parent"))
        kids = staged(kids.select("node", "parent", "n", "centre", (F.col("radius") * (1 + 1e-9) + 1e-6).alias("radius"), more.alias("open")), "nodes")
        levels.append(kids)
        closed = spread_join(rows.select("vec_id", "vector", "node"), kids.select("node", "n", "open"), "node", "vec_id").where("NOT open")
        leaves.append(closed.select("vec_id", "vector", "node", F.pmod(F.xxhash64("vec_id", "vector"), F.ceil(F.col("n") / CHUNK)).cast("int").alias("piece")))
        open_nodes = kids.where("open").select("node", "n")
    else:  # no numbers are left: what is still open is cut by a hash
        rest = spread_join(rows.select("vec_id", "vector", "node"), open_nodes, "node", "vec_id")
        leaves.append(rest.select("vec_id", "vector", "node", F.pmod(F.xxhash64("vec_id", "vector"), F.ceil(F.col("n") / CHUNK)).cast("int").alias("piece")))
        levels[-1] = levels[-1].withColumn("open", F.lit(False))
    return reduce(DataFrame.unionByName, leaves), levels


CHUNKS = "node long, piece int, ids binary, width int, matrix binary, middle array<double>, radius double"
GROUPS = "q string, " + CHUNKS


def _packed(node: int, piece: int, ids: np.ndarray, m: np.ndarray) -> tuple:
    middle = m.mean(0)
    radius = float(np.linalg.norm(m - middle, axis=1).max()) * (1 + 1e-9) + 1e-6
    return node, piece, ids.astype("<i8").tobytes(), m.shape[1], m.tobytes(), middle.tolist(), radius


def _table(rows: list[tuple], schema: str) -> pa.Table:
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], types[kind]) for i, (name, kind) in enumerate(fields)})


def _pack(groups: bool):
    """A chunk's rows as one row, or its queries as groups of near ones; repeated rows count one by one."""

    def run(table: pa.Table) -> pa.Table:
        node, piece = table.column("node")[0].as_py(), table.column("piece")[0].as_py()
        rows = sorted(zip(table.column("vec_id").to_pylist(), table.column("vector").to_pylist(), strict=True))
        ids, m = np.array([i for i, _ in rows], np.int64), _matrix([v for _, v in rows])
        if not groups:
            return _table([_packed(node, piece, ids, m)], CHUNKS)
        order = farthest_first(m, 2 * -(-len(ids) // GROUP))[1].argsort(kind="stable")
        cuts = [order[at : at + GROUP] for at in range(0, len(order), GROUP)]
        return _table([(f"{node}-{piece}-{g}", *_packed(node, piece, ids[own], m[own])) for g, own in enumerate(cuts)], GROUPS)

    return run


FOUND = GROUPS + ", floors binary, worst double, of_query binary, found binary, scores binary"


def _search(k: int):
    """Query groups against one data chunk, each with what it has for certain (``floors``, if it was searched before)."""

    def run(data: pa.Table, groups: pa.Table) -> pa.Table:
        out = []
        for chunk in data.to_pylist():
            ids, tree = np.frombuffer(chunk["ids"], "<i8"), None
            points = np.frombuffer(chunk["matrix"]).reshape(len(ids), -1)
            for group in groups.to_pylist():
                query_ids = np.frombuffer(group["ids"], "<i8")
                queries = np.frombuffer(group["matrix"]).reshape(len(query_ids), -1)
                width = max(points.shape[1], queries.shape[1])
                if tree is None or tree.points.shape[1] < width:
                    tree = CoverTree(_same_width(points, width))
                width = tree.points.shape[1]
                floor = np.frombuffer(group["floors"]) if group["floors"] else np.full(len(query_ids), -np.inf)
                best = Best(query_ids, k, floor)
                dual_search(CoverTree(_same_width(queries, width)), tree, ids, best)
                rows, found, scores = best.merge()
                own = [group[name.split()[0]] for name in GROUPS.split(", ")]
                out.append((*own, best.least.tobytes(), float(best.least.min()), query_ids[rows].astype("<i8").tobytes(), found.astype("<i8").tobytes(), scores.astype("<i8").tobytes()))
        return _table(out, FOUND)

    return run


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Found pairs row by row."""
    for batch in batches:
        for row in batch.to_pylist():
            flat = [pa.array(np.frombuffer(row[c], "<i8")) for c in ("of_query", "found", "scores")]
            yield pa.RecordBatch.from_arrays(flat, names=["query_id", "vec_id", "score"])


RESULT = "query_id long, vec_id long, score long"


def _reached(groups: DataFrame, levels: list[DataFrame], chunks: DataFrame) -> DataFrame:
    """(q, node, piece) of the chunks that the bound leaves for a group, but for its home; down the tree, level by level."""
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))

    def kept(pairs: DataFrame) -> DataFrame:
        dot = F.aggregate(F.zip_with("middle", "q_middle", lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
        most = dot + F.col("q_radius") * norm(F.col("middle")) + F.col("radius") * norm(F.col("q_middle")) + F.col("radius") * F.col("q_radius")
        return pairs.where(most + 1e-6 * F.abs(most) + 1e-6 >= F.col("worst"))

    own = ["q", "home", "home_piece", "q_middle", "q_radius", "worst"]
    at, ends = groups.withColumn("node", F.lit(0).cast("long")), []
    for level in levels:
        nodes = level.select(F.col("node").alias("child"), F.col("parent").alias("node"), F.col("centre").alias("middle"), "radius", "open")
        met = kept(at.join(nodes, "node")).select(*own, F.col("child").alias("node"), "open")
        ends.append(met.where("NOT open").drop("open"))
        at = met.where("open").drop("open")
    ends = reduce(DataFrame.unionByName, ends) if ends else at
    met = kept(ends.join(chunks.select("node", "piece", "middle", "radius"), "node"))
    return met.where((F.col("node") != F.col("home")) | (F.col("piece") != F.col("home_piece"))).select("q", "node", "piece")


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, scale: int = 64, sample: int = 2048, batch: int = 64) -> DataFrame:
    """The k rows with the largest integer inner product for every query row.

    Components become floor(scale * x).  Queries are the rows whose id is divisible by ``every``;
    candidates are all rows of another id.  Returns query_id, rank (from 1), vec_id, score; ties
    go to the smaller id; fewer rows if there are fewer candidates.  Repeated rows count one by one,
    as candidates and as queries (an id's query rows share one ranking).  Rows with a null id, a
    null vector, or a component that is null or not finite, before or after scaling, take no part; a
    shorter vector counts as filled up by zeros; scores beyond a long stay at its ends; an empty
    table gives no rows; other columns are ignored.  Centres of a node come from about ``sample`` of
    its rows; they steer the order, not the result.
    """
    rows = staged(vectors.select(col(id_col).cast("long").alias("vec_id"), col(vector_col).cast("array<double>").alias("v")).mapInArrow(_whole_numbers(scale), ROW_SCHEMA), "vectors")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.length("vector")), F.lit(0)) / 8).first()
    leaves, levels = _tree(rows, n, int(width), sample)
    chunks = staged(leaves.groupBy("node", "piece").applyInArrow(_pack(False), CHUNKS), "chunks")
    queries = leaves.where(F.col("vec_id") % every == 0).groupBy("node", "piece").applyInArrow(_pack(True), GROUPS).withColumn("floors", F.lit(None).cast("binary"))
    near = staged(chunks.groupBy("node", "piece").cogroup(queries.groupBy("node", "piece")).applyInArrow(_search(k), FOUND), "near")
    about = near.select("q", F.col("node").alias("home"), F.col("piece").alias("home_piece"), F.col("middle").alias("q_middle"), F.col("radius").alias("q_radius"), "worst")
    # Groups are sent to a chunk in parts whose matrices fit in memory; a chunk is copied to the parts that want it, no others.
    of_part = max(1, min(batch, (64 << 20) // (GROUP * 8 * max(1, int(width)))))
    part = F.pmod(F.xxhash64("q"), F.lit(max(1, -(-near.count() // of_part)))).alias("part")
    wanted = staged(_reached(about, levels, chunks).select("q", "node", "piece", part), "wanted")
    to = wanted.select("q", F.col("node").alias("to"), F.col("piece").alias("to_piece"), F.col("part").alias("in_part"))
    sent = to.join(near.drop("worst", "of_query", "found", "scores"), "q")
    copies = wanted.select("node", "piece", "part").distinct().join(chunks, ["node", "piece"])
    far = copies.groupBy("node", "piece", "part").cogroup(sent.groupBy("to", "to_piece", "in_part")).applyInArrow(_search(k), FOUND)
    found = [x.select("of_query", "found", "scores").mapInArrow(_each, RESULT) for x in (near, far)]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    best = found[0].unionByName(found[1]).withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
