"""N-gram Jaccard join by chosen paths (operator 2).

A document is its set of word shingles; documents of equal sets are one class, and only classes
are joined.  From the root down, a set follows every token whose hash at that node is below
1 / (threshold * size): two similar sets then share each step with a fixed chance, whatever the
size of the corpus.  A node's bucket that is small enough is compared by brute force over short
sketches, a larger one is split on the next token of the path, and as many runs are made as the
target recall asks for.  What is still large after the last split (near copies share their whole
paths, so no split parts them) is compared with one leader first, and only what is not like the
leader is compared with the rest, tile by tile.  Sketches only propose: proposals are gathered into
components, and inside each all links are counted exactly.  A large component goes by differences
from a reference set: members that differ from it by little are linked for certain and only
counted, the others are compared over their differences, in tiles of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passgrid.llm.common import col, numbered_columns, release_but, sent_or_joined, spread_join, staged
from passgrid.llm.components import components
from passgrid.llm.license_scan import FOLD

BINS = 128
#: A bucket up to SMALL is compared as it is; beyond it is split, at most DEPTH steps down; a last bucket above TILE is cut into tiles.
SMALL, DEPTH, TILE, EXACT_TILE = 128, 3, 2048, 512
#: Most hashes of (node, shingle) held at once.
HASHED = 1 << 21
CACHE_ENTRIES = 250_000
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits depend on all bits of x."""
    x = (x ^ (x >> np.uint64(33))) * M1
    x = (x ^ (x >> np.uint64(33))) * M2
    return x ^ (x >> np.uint64(33))


class Shingles:
    """Sorted distinct shingle hashes of texts; one instance a task."""

    def __init__(self, width: int):
        self.width, self.words = width, {}
        self.odd = mix(np.arange(1, width + 2, dtype=np.uint64)) | np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        words, known = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split(), self.words
        if len(known) > CACHE_ENTRIES:
            known.clear()
        h = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            v = known.get(w)
            if v is None:
                v = known[w] = xxhash.xxh3_64_intdigest(w)
            h[i] = v
        n = min(self.width, len(h))
        if not n:
            return h
        total = np.full(len(h) - n + 1, n, np.uint64) * self.odd[-1]
        for k in range(n):
            total += h[k : len(h) - n + 1 + k] * self.odd[k]
        return np.unique(mix(total))


def class_key(shingles: np.ndarray, text: str | None) -> bytes:
    """128 bits of the set; of the text itself if it has no word."""
    if len(shingles):
        return xxhash.xxh3_128_digest(shingles.tobytes())
    return xxhash.xxh3_128_digest(b"\0" + (text or "").encode("utf-8", "surrogatepass"))


def sketch(shingles: np.ndarray) -> bytes:
    """Least hash of each of BINS parts of the hash space, by 8 bits; 0 is an empty part."""
    out = np.zeros(BINS, np.uint8)
    bins = (shingles % np.uint64(BINS)).astype(np.int64)[::-1]
    out[bins] = (np.uint64(1) + (shingles[::-1] >> np.uint64(20)) % np.uint64(255)).astype(np.uint8)  # the least is written last
    return out.tobytes()


def chosen(shingles: np.ndarray, nodes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For every node the children a set goes to: (number of the node, child)."""
    limit = np.uint64(int(min(1.0, 1 / (threshold * len(shingles))) * (2**64 - 1025)))
    step, parents, children = max(1, HASHED // len(shingles)), [], []
    for first in range(0, len(nodes), step):
        h = mix(shingles[None, :] ^ nodes[first : first + step, None])
        at, which = np.nonzero(h <= limit)
        parents.append(first + at)
        children.append(mix(h[at, which] + nodes[first + at]))
    return np.concatenate(parents or [np.zeros(0, np.int64)]), np.concatenate(children or [np.zeros(0, np.uint64)])


PATHS = ", ".join(["keys_0 array<long>", *[f"keys_{k} array<long>, from_{k} array<int>" for k in range(1, DEPTH)]])


def paths(shingles: np.ndarray, runs: int, threshold: float) -> list[np.ndarray]:
    """A set's nodes, DEPTH steps down from each run's root: those of the first step, then for each further one the nodes and which of those before they follow."""
    nodes, out = mix(np.arange(1, runs + 1, dtype=np.uint64)), []
    for level in range(DEPTH):
        parents, nodes = chosen(shingles, nodes, threshold) if len(shingles) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        out += [nodes.astype(np.int64)] + ([parents] if level else [])
    return out


def _describe(width: int, runs: int, threshold: float):
    """Every text's class, size, sketch and paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        names = ["node", "n", "sketch", *[c.split()[0] for c in PATHS.split(", ")]]
        types = [pa.binary(), pa.int32(), pa.binary(), *[pa.list_(pa.int32() if c.startswith("from") else pa.int64()) for c in names[3:]]]
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                rows.append((class_key(s, text), len(s), sketch(s), *paths(s, runs, threshold)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], names=["doc_id", *names])

    return run


def _by_key(names: list[str], handle: Callable[[dict[str, list]], list[tuple]], types: list, out_names: list[str]):
    """Run ``handle`` on the rows of each key; rows come sorted by ``names[0]`` and a key's rows together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(table: pa.Table) -> list[tuple]:
            data = {n: table.column(n).to_pylist() for n in names}
            key = data[names[0]]
            cuts = [0, *[i for i in range(1, len(key)) if key[i] != key[i - 1]], len(key)]
            return [row for a, b in pairwise(cuts) for row in handle({n: v[a:b] for n, v in data.items()})]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=out_names)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(names[0]).to_pylist()
            last = next((i for i in range(len(key) - 1, 0, -1) if key[i] != key[i - 1]), 0)
            if held and held[0].column(names[0])[0].as_py() != key[0] or last:
                # everything before the last key is whole
                done = pa.Table.from_batches([*held, batch.slice(0, last)])
                held = [batch.slice(last)]
                if rows := emit(done):
                    yield batch_of(rows)
            else:
                held.append(batch)
        if held and (rows := emit(pa.Table.from_batches(held))):
            yield batch_of(rows)

    return run


def _alike(sketch_a: np.ndarray, n_a: np.ndarray, sketch_b: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sketches and sizes leave the threshold possible, row by row."""
    same = ((sketch_a == sketch_b) & (sketch_b > 0)).sum(1)
    some = ((sketch_a | sketch_b) > 0).sum(1)
    low, high = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    # Four deviations of the estimate below the threshold, more where sets are small.
    return (low >= threshold * high - 1e-9) & (same >= np.where(low <= 64, threshold - 0.35, threshold - 0.17) * some)


def _sketches(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), BINS)


def _propose(threshold: float):
    """A spanning forest of the pairs of a bucket (or of two tiles of one) that are alike."""

    def handle(rows: dict[str, list]) -> list[tuple]:
        nodes = rows["node"]
        if len(nodes) < 2:
            return []
        sketches, sizes = _sketches(rows["sketch"]), np.array(rows["n"], np.float64)
        left, out = np.arange(len(nodes)), []
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                i = queue.pop()
                near = _alike(sketches[left], sizes[left], sketches[i][None, :], sizes[i], threshold)
                found, left = left[near], left[~near]
                out += [(nodes[i], nodes[j]) for j in found]
                queue += found.tolist()
        return out

    return _by_key(["bucket", "node", "n", "sketch"], handle, [pa.binary(), pa.binary()], ["a", "b"])


def _attach(threshold: float):
    """Rows with their bucket's leader: ``core`` tells whether the row is like it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = pa.array([], pa.bool_())
            if batch.num_rows:
                n = [batch.column(c).to_numpy().astype(np.float64) for c in ("n", "leader_n")]
                sketches = [_sketches(batch.column(c).to_pylist()) for c in ("sketch", "leader_sketch")]
                near = pa.array(_alike(sketches[0], n[0], sketches[1], n[1], threshold))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("key", "node", "n", "sketch", "leader")] + [near], names=["key", "node", "n", "sketch", "leader", "core"])

    return run


def _linked_pairs(sizes: np.ndarray, tokens: np.ndarray, counts: np.ndarray, base: np.ndarray, threshold: float, may: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Partners per row, and a spanning forest of the links, over rows given as token lists one after the other.

    Common tokens of i and j are ``base[i] + base[j]`` (what their lists leave out) and what the lists
    share; ``may[i] != may[j]`` if the pair is this tile's own, or ``may`` is negative throughout.
    """
    starts = np.cumsum(counts) - counts
    padded = np.append(tokens, tokens.max(initial=0) + 1)  # so that an empty last list has a place to point at
    mark, links, out = np.zeros(padded[-1] + 1, np.int64), np.zeros(len(sizes), np.int64), []
    for i in range(len(sizes) - 1):
        own, rest = tokens[starts[i] : starts[i] + counts[i]], starts[i + 1]
        mark[own] = 1
        shared = np.add.reduceat(mark[padded[rest:]], starts[i + 1 :] - rest)
        mark[own] = 0
        shared[counts[i + 1 :] == 0] = 0
        common = base[i] + base[i + 1 :] + shared
        linked = common >= threshold * (sizes[i] + sizes[i + 1 :] - common) - 1e-9
        if may[0] >= 0:
            linked &= may[i + 1 :] != may[i]
        partners = i + 1 + np.nonzero(linked)[0]
        links[i] += len(partners)
        links[partners] += 1
        for j in partners[label[partners] != label[i]].tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return links, out


LINKS = "a binary, links long, b binary"
LINK_TYPES = [pa.binary(), pa.int64(), pa.binary()]


def _found(nodes: list[bytes], links: np.ndarray, forest: list[tuple[int, int]]) -> list[tuple]:
    """(a, 0, b) for the edges of a forest, (a, links, null) for the number of partners."""
    return [(nodes[i], 0, nodes[j]) for i, j in forest] + [(n, k, None) for n, k in zip(nodes, links.tolist(), strict=True) if k]


DIFFERENCES = "key binary, node binary, n_reference int, lacking int, beyond int, core boolean, other binary"
MEMBERS = LINKS + ", " + DIFFERENCES


def _members(width: int, threshold: float):
    """Components over their texts: all exact links of one that is a tile, differences from the reference in a part of a larger one.

    The reference is the row whose node is the root; it is sent to every part of its component.
    ``core`` rows differ from it so little that two of them are linked whatever they differ by.
    """
    shingles, none = Shingles(width), (None,) * len(DIFFERENCES.split(", "))

    def sets(rows: dict[str, list], copied: bool) -> dict[bytes, np.ndarray]:
        own: dict[bytes, np.ndarray] = {}
        for node, text, of_other in zip(rows["node"], rows["text"], rows["copied"], strict=True):
            if of_other == copied and node not in own:
                s = shingles(text)
                if class_key(s, text) == node:  # an id may come with several texts
                    own[node] = s
        return own

    def handle(rows: dict[str, list]) -> list[tuple]:
        own = sets(rows, False)
        if not rows["large"][0]:
            if len(own) < 2:
                return []
            sizes = np.array([len(s) for s in own.values()])
            _, tokens = np.unique(np.concatenate(list(own.values())), return_inverse=True)
            found = _linked_pairs(sizes, tokens, sizes, np.zeros(len(own), np.int64), threshold, np.full(len(own), -1), np.arange(len(own)))
            return [row + none for row in _found(list(own), *found)]
        root, out = rows["root"][0], []
        reference = sets(rows, True)[root]
        for node, s in own.items():
            other = np.setxor1d(s, reference, assume_unique=True)
            beyond = (len(s) - len(reference) + len(other)) // 2
            lacking = len(other) - beyond
            core = lacking + threshold * beyond <= (1 - threshold) * len(reference) / 2
            out.append((None, None, None, root, node, len(reference), lacking, beyond, core, other.tobytes()))
        return out

    types = [*LINK_TYPES, pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    return _by_key(["tile", "root", "node", "large", "copied", "text"], handle, types, [c.split()[0] for c in MEMBERS.split(", ")])


def _compare(threshold: float):
    """Exact links of a tile, or between two tiles, of a large component, over differences from its reference."""

    def handle(rows: dict[str, list]) -> list[tuple]:
        if len(rows["node"]) < 2:
            return []
        other = [np.frombuffer(b, np.uint64) for b in rows["other"]]
        lacking, beyond, n = (np.array(rows[c], np.int64) for c in ("lacking", "beyond", "n_reference"))
        _, tokens = np.unique(np.concatenate(other), return_inverse=True)
        _, sides = np.unique(np.array(rows["side"]), return_inverse=True)
        label = np.arange(len(lacking))
        label[np.array(rows["core"])] = len(lacking)  # linked already
        # Common tokens are the reference's less what either lacks, and what both differ by: half of the reference is each one's base.
        base = n / 2 - lacking
        may = sides if rows["crossing"][0] else np.full(len(sides), -1)
        return _found(rows["node"], *_linked_pairs(n - lacking + beyond, tokens, np.array([len(x) for x in other]), base, threshold, may, label))

    return _by_key(["tile", "node", "side", "crossing", "core", "n_reference", "lacking", "beyond", "other"], handle, LINK_TYPES, ["a", "links", "b"])


def _tiled(rows: DataFrame, size: int) -> DataFrame:
    """Rows (``key``, ``node``, ``core``; staged) cut into tiles of about ``size``, one copy per pair of tiles.

    Core rows need no comparison with each other, so their tiles only meet those of the rest.
    Adds ``tile`` (the pair, as a string), ``side`` (the row's own tile) and ``crossing`` (whether
    the pair is of two tiles, in which case pairs within one are not its own).
    """
    n = lambda core: F.ceil(F.count(F.when(F.col("core") == core, 1)) / size).cast("int")
    tiles = rows.groupBy("key").agg(n(True).alias("core_tiles"), n(False).alias("rest_tiles"))
    own = F.when(F.col("core"), F.col("core_tiles")).otherwise(F.col("rest_tiles"))
    cut = spread_join(rows, tiles, "key", "node").where("rest_tiles > 0")
    cut = cut.withColumn("side", F.concat(F.when(F.col("core"), "c").otherwise("r"), F.pmod(F.xxhash64("node"), own)))
    named = lambda letter, count: F.transform(F.when(F.col(count) > 0, F.sequence(F.lit(1), F.col(count))).otherwise(F.array().cast("array<int>")), lambda k: F.concat(F.lit(letter), k - 1))
    paired = cut.withColumn("met", F.explode(F.when(F.col("core"), named("r", "rest_tiles")).otherwise(F.concat(named("r", "rest_tiles"), named("c", "core_tiles")))))
    pair = F.concat_ws("-", F.hex("key"), F.least("side", "met"), F.greatest("side", "met"))
    return paired.withColumn("tile", pair).withColumn("crossing", F.col("side") != F.col("met")).drop("core_tiles", "rest_tiles", "met")


def _by_tile(rows: DataFrame, tile: str) -> DataFrame:
    return rows.repartition(tile).sortWithinPartitions(tile)


def _buckets(classes: DataFrame, described: DataFrame, scratch: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(bucket, node) of the buckets that are compared as they are, and of the larger ones that no split is left for.

    What is shuffled are buckets and nodes; a path's next nodes are read for large buckets only, from
    the row that stands for the class.
    """
    at, small = classes.select("node", F.explode("keys").alias("bucket")), []
    for level in range(DEPTH):
        last = level == DEPTH - 1
        sizes = staged(at.groupBy("bucket").count().where("count > 1"), f"sizes-{level}", scratch, "none")
        met = staged(spread_join(at, sizes, "bucket", "node", sizes=sizes), f"level-{level}", scratch, "none")
        small.append(met.where(F.col("count") <= (TILE if last else SMALL)).select("bucket", "node"))
        large = met.where(F.col("count") > (TILE if last else SMALL)).select("bucket", "node")
        if last or large.isEmpty():
            break
        split = large.groupBy("node").agg(F.collect_list("bucket").alias("buckets"))  # of a class: as many as it has nodes in a step
        split = staged(split.join(classes.select("node", F.col("least_id").alias("doc_id")), "node"), f"split-{level}", scratch, "none")
        rows = described.select("doc_id", F.col("node").alias("own"), f"keys_{level}", F.arrays_zip(f"keys_{level + 1}", f"from_{level + 1}").alias("steps"))
        below = sent_or_joined(rows, split, "doc_id", 256).where("own = node").withColumn("x", F.explode("steps")).where(F.array_contains("buckets", F.get(f"keys_{level}", F.col(f"x.from_{level + 1}"))))
        at = staged(below.select("node", F.col(f"x.keys_{level + 1}").alias("bucket")).distinct(), f"below-{level}", scratch, "none")  # rows may be repeated
    return reduce(DataFrame.unionByName, small), large


def _proposals(classes: DataFrame, described: DataFrame, threshold: float, scratch: list[DataFrame]) -> DataFrame:
    """Pairs (a, b) of classes that connect all pairs which share a bucket and are alike."""
    small, large = _buckets(classes, described, scratch)
    about = classes.select("node", "n", "sketch")
    pairs = _by_tile(small.join(about, "node").select("bucket", "node", "n", "sketch"), "bucket").mapInArrow(_propose(threshold), "a binary, b binary")
    if large.isEmpty():
        return pairs
    large = staged(large.select(F.col("bucket").cast("string").cast("binary").alias("key"), "node").join(about, "node"), "large-buckets", scratch)
    first = large.groupBy("key").agg(F.min(F.struct("node", "n", "sketch")).alias("x"))
    leaders = first.select("key", F.col("x.node").alias("leader"), F.col("x.n").alias("leader_n"), F.col("x.sketch").alias("leader_sketch"))
    led = staged(
        spread_join(large, leaders, "key", "node").select("key", "node", "n", "sketch", "leader", "leader_n", "leader_sketch").mapInArrow(_attach(threshold), "key binary, node binary, n int, sketch binary, leader binary, core boolean"),
        "led",
        scratch,
    )
    attached = led.where("core AND node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    tiles = _by_tile(_tiled(led, TILE).select(F.col("tile").alias("bucket"), "node", "n", "sketch"), "bucket")
    return pairs.unionByName(attached).unionByName(tiles.mapInArrow(_propose(threshold), "a binary, b binary"))


def _exact(near: DataFrame, classes: DataFrame, own: DataFrame, width: int, threshold: float, scratch: list[DataFrame]) -> DataFrame:
    """Exact links of all pairs in the components of ``near`` (node, root): rows (a, links, null) and (a, 0, b).

    Every member's tile is settled before a text is touched; texts in no component stay where they
    are, the others are shuffled once, by tile.
    """
    counts = near.groupBy("root").agg(F.count("*").alias("count"))
    sized = spread_join(near, counts, "root", "node").join(classes.select("node", F.col("least_id").alias("doc_id")), "node")
    sized = sized.withColumn("large", F.col("count") > EXACT_TILE).withColumn("parts", F.ceil(F.col("count") / EXACT_TILE).cast("int"))
    tile = lambda number: F.when(F.col("large"), F.concat_ws("-", F.hex("root"), number)).otherwise(F.hex("root")).alias("tile")
    members = sized.select("doc_id", tile(F.pmod(F.xxhash64("node"), F.col("parts"))), "root", "node", "large", F.lit(False).alias("copied"))
    copies = sized.where(F.col("large") & (F.col("node") == F.col("root"))).withColumn("number", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    copies = copies.select("doc_id", tile(F.col("number")), "root", "node", "large", F.lit(True).alias("copied"))
    wanted = staged(members.unionByName(copies), "members", scratch, "none")
    texts = sent_or_joined(own, wanted, "doc_id", 160).select("tile", "root", "node", "large", "copied", "text")
    compared = staged(_by_tile(texts, "tile").mapInArrow(_members(width, threshold), MEMBERS), "compared", scratch)
    small, others = compared.where(F.col("a").isNotNull()).select("a", "links", "b"), compared.where(F.col("key").isNotNull()).drop("a", "links", "b")
    core = others.where("core")
    sure = spread_join(core, core.groupBy("key").agg(F.count("*").alias("count")), "key", "node")
    sure = sure.select(F.col("node").alias("a"), (F.col("count") - 1).alias("links"), F.lit(None).cast("binary").alias("b"))
    tied = core.where(F.col("node") != F.col("key")).select(F.col("node").alias("a"), F.lit(0).cast("long").alias("links"), F.col("key").alias("b"))
    compared = _by_tile(_tiled(others, EXACT_TILE), "tile").select("tile", "node", "side", "crossing", "core", "n_reference", "lacking", "beyond", "other").mapInArrow(_compare(threshold), LINKS)
    return small.unionByName(sure).unionByName(tied).unionByName(compared)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """Documents with their class and links at Jaccard >= threshold over shingles of ``width`` words.

    Words are as in the license scan (ASCII lower-cased, other characters kept).  A text of fewer
    words is one shingle; a text without words is alike only to the same text, and has no links.
    Returns one row per input row with an id: doc_id, class_id (least doc_id of all documents that
    links and equal sets connect), n_links (different sets linked to its own), n_copies (other rows
    of the same set).  A null text is an empty one; rows without id take no part; an id that comes
    with several texts keeps a row for each, and its links count if its text was a class's sample
    (the least id); an empty table gives no rows; other columns are ignored.  ``recall`` is the
    least chance of a pair at the threshold to be proposed after DEPTH splits; it sets the runs.
    """
    chance = 0.0
    for _ in range(DEPTH):  # a pair at the threshold shares one child a node on average
        chance = 1 - math.exp(-1.0 if chance == 0.0 else -chance)
    runs = math.ceil(math.log(1 - recall) / math.log(1 - chance))
    own = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    scratch: list[DataFrame] = []
    described = staged(own.mapInArrow(_describe(width, runs, threshold), f"doc_id long, node binary, n int, sketch binary, {PATHS}"), "shingled")
    about = [F.first(c).alias(name) for c, name in (("n", "n"), ("sketch", "sketch"), ("keys_0", "keys"))]
    classes = staged(described.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), *about), "classes", scratch)
    near = staged(components(_proposals(classes, described, threshold, scratch), scratch), "proposed", scratch, "none")
    release_but(scratch, classes, near)
    exact = staged(_exact(near, classes, own, width, threshold, scratch), "exact", scratch, "none")
    release_but(scratch, classes, exact)
    links = exact.where(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    roots_of = components(exact.where(F.col("b").isNotNull()).select("a", "b"), scratch)
    linked = staged(classes.select("node", "least_id", "copies").join(roots_of, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node")), "linked", scratch, "none")
    release_but(scratch, linked)
    class_ids = linked.groupBy("root").agg(F.min("least_id").alias("class_id"))
    found = spread_join(linked, class_ids, "root", "node").select("node", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("copies") - 1).alias("n_copies"))
    rows = described.select("doc_id", "node")
    return spread_join(rows, found, "node", "doc_id", sizes=linked.select("node", F.col("copies").alias("count"))).select("doc_id", "class_id", "n_links", "n_copies")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows, whole, of which one per group of near-duplicates is kept: that of the least id.

    Rows are told apart by a number of their own, not by the id: of repeated rows one is kept, an
    id with several texts is decided text by text, and rows without id take part (they stay only if
    their group has no row with an id).  Null texts are equal to empty ones and to each other.  An
    empty table stays empty; columns may have any names.
    """
    plain = staged(numbered_columns(docs).withColumn("row", F.monotonically_increasing_id()), "numbered-rows")
    own = dict(zip(docs.columns, plain.columns, strict=False))
    classes = jaccard_join(plain, "row", own[text_col], width, threshold).select(F.col("doc_id").alias("row"), "class_id")
    order = F.struct(F.col(own[id_col]).isNull(), own[id_col], "row")
    kept = plain.select("row", own[id_col]).join(classes, "row").groupBy("class_id").agg(F.min(order).alias("x")).select(F.col("x.row").alias("row"))
    return plain.join(kept, "row", "left_semi").drop("row").toDF(*docs.columns)
