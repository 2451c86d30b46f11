"""Readers and writers of dataset files."""

import json
import os
import struct
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from passgrid.functions.pixels import LUMA, PASSES, SIGNATURE, decode_png, difference_hash
from passgrid.operators import datasets as D
from passgrid.operators.evalkit import near_hashes
from passgrid.sources.annotations import register


def test_coco(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a"}, {"id": 2, "file_name": "b"}], "annotations": [{"id": 5, "image_id": 1, "bbox": [1.0, 2.0, 3.0, 4.0]}], "categories": []}
    (tmp_path / "train.json").write_text(json.dumps(doc))
    images, annotations = D.read_coco(spark, str(tmp_path / "train.json"))
    assert images.count() == 2 and annotations.first().bbox == [1.0, 2.0, 3.0, 4.0]
    negatives = images.join(annotations, F.col("image_id") == images["id"], "left_anti")
    assert [r.id for r in negatives.collect()] == [2]
    D.write_coco(images.drop("file").withColumn("split", F.lit("train")), annotations.drop("file").withColumn("split", F.lit("train")), str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out") == ["train.json"]
    written = json.loads((tmp_path / "out/train.json").read_text())
    assert {k: sorted(v, key=lambda x: x["id"]) for k, v in written.items()} == doc


def test_coco_documents_of_many_parts(spark, tmp_path):
    """Written in parallel, read back by the source: the same entries in one document a split; writing again replaces them."""
    images = spark.range(500, numPartitions=7).select("id", F.concat(F.lit('im "'), "id", F.lit('"\n.png')).alias("file_name"), F.lit(640).alias("width"), F.lit(None).cast("int").alias("height"), F.element_at(F.array(F.lit("train"), F.lit("valid"), F.lit("test")), (F.col("id") % 3 + 1).cast("int")).alias("split"))
    boxes = images.select(F.col("id"), F.col("id").alias("image_id"), F.lit(1).alias("category_id"), F.array(F.lit(1.5), F.col("id").cast("double"), F.lit(3.0), F.lit(4.0)).alias("bbox"), F.lit(12.0).alias("area"), F.lit(0).alias("iscrowd"), "split")
    kinds = spark.createDataFrame([(1, "card", s) for s in ("train", "valid")], "id int, name string, split string")
    path = str(tmp_path / "out")
    for _ in range(2):
        D.write_coco(images, boxes, path, kinds)
        assert sorted(os.listdir(path)) == ["test.json", "train.json", "valid.json"]
    assert json.loads((tmp_path / "out/train.json").read_text())["categories"] == [{"id": 1, "name": "card"}]
    got = spark.read.format("coco").option("table", "images").load(path)
    assert {(r.file, r.id, r.file_name, r.width, r.height) for r in got.collect()} == {(f"{r.split}.json", r.id, r.file_name, 640, None) for r in images.collect()}
    again = spark.read.format("coco").load(path)
    assert again.rdd.getNumPartitions() == 3
    assert {(r.file, r.id, tuple(r.bbox), r.iscrowd) for r in again.collect()} == {(f"{r.split}.json", r.id, tuple(r.bbox), 0) for r in boxes.collect()}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    register(spark)
    path = tmp_path / "out"
    rows = spark.range(40, numPartitions=4).select(F.lit("train").alias("split"), F.lit("image").alias("kind"), F.when(F.col("id") == 35, "{broken").otherwise(F.concat(F.lit('{"id": '), "id", F.lit("}"))).alias("doc"))
    with pytest.raises(Exception):
        rows.write.format("coco").mode("overwrite").option("path", str(path)).save()
    assert not path.exists() or os.listdir(path) == []
    rows.where("id < 35").write.format("coco").mode("overwrite").option("path", str(path)).save()
    with pytest.raises(Exception):
        rows.write.format("coco").mode("overwrite").option("path", str(path)).save()
    assert os.listdir(path) == ["train.json"] and len(json.loads((path / "train.json").read_text())["images"]) == 35


def test_label_and_polygon_sources(spark, tmp_path):
    register(spark)
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels/img1.txt").write_text("0 0.5 0.5 0.2 0.2\n0 0.5\n1 x 0.5 0.1 0.1\n0 1.5 0.5 0.1 0.1\n")
    (tmp_path / "labels/img2.txt").write_text("")
    yolo = spark.read.format("yolo").load(str(tmp_path / "labels"))
    assert [(r.image, r.label, r.cx) for r in yolo.collect()] == [("img1", 0, 0.5)] and yolo.rdd.getNumPartitions() == 2
    via = {"x1": {"filename": "f.png", "regions": [{"shape_attributes": {"all_points_x": [1, 2], "all_points_y": [3, 4]}, "region_attributes": {"field_name": "doc_quad"}}, {"shape_attributes": {"all_points_x": [9], "all_points_y": [9]}, "region_attributes": {"field_name": "photo"}}]}}
    (tmp_path / "via.json").write_text(json.dumps(via))
    read = lambda **o: [(r.filename, r.xs, r.ys) for r in spark.read.format("via").options(**o).load(str(tmp_path / "via.json")).collect()]
    assert read() == [("f.png", [1.0, 2.0], [3.0, 4.0])] and read(region="photo") == [("f.png", [9.0], [9.0])]
    assert spark.read.format("coco").load(str(tmp_path / "nothing")).collect() == []


def test_yolo_lines(spark, tmp_path):
    (tmp_path / "img1.txt").write_text("0 0.5 0.5 0.2 0.2\n0 0.5\n1 x 0.5 0.1 0.1\n0 1.5 0.5 0.1 0.1\n")
    assert [(r.image, r.label, r.cx) for r in D.read_yolo(spark, str(tmp_path / "img1.txt")).collect()] == [("img1", 0, 0.5)]


def test_regions_and_quads(spark, tmp_path):
    via = {"x1": {"filename": "f.png", "regions": [{"shape_attributes": {"all_points_x": [1, 2], "all_points_y": [3, 4]}, "region_attributes": {"field_name": "doc_quad"}}, {"shape_attributes": {"all_points_x": [9], "all_points_y": [9]}, "region_attributes": {"field_name": "photo"}}]}}
    (tmp_path / "via.json").write_text(json.dumps(via))
    r = D.read_regions(spark, str(tmp_path / "via.json")).collect()
    assert len(r) == 1 and [tuple(p) for p in r[0].points] == [(1.0, 3.0), (2.0, 4.0)]
    (tmp_path / "frame.json").write_text('{"quad": [[0, 0], [5, 0], [5, 5], [0, 5]]}')
    assert len(D.read_quads(spark, str(tmp_path / "frame.json")).first().quad) == 4


def test_evidence_and_inventory(spark, tmp_path):
    import os

    for i, name in enumerate(("old", "new")):
        p = tmp_path / f"{name}.evidence"
        p.write_text(json.dumps({"a": {"b": i}}))
        os.utime(p, (1_700_000_000 + i * 100, 1_700_000_000 + i * 100))
    assert D.newest_evidence(spark, str(tmp_path / "*.evidence"), "a.b").first().value == "1"
    for split, n in (("train", 3), ("test", 1)):
        for k in range(n):
            d = tmp_path / "inv" / "src" / split / "card"
            d.mkdir(parents=True, exist_ok=True)
            (d / f"{k}.bin").write_bytes(b"12345")
    assert {(r.source, r.split, r["class"], r.files, r.bytes) for r in D.inventory(spark, str(tmp_path / "inv")).collect()} == {("src", "train", "card", 3, 15), ("src", "test", "card", 1, 5)}


def test_difference_hashes(spark, tmp_path):
    import numpy as np

    ramp = np.tile(np.arange(0, 180, 2, dtype=np.uint8), (64, 1))
    for name, a in (("up", ramp), ("down", ramp[:, ::-1])):
        (tmp_path / f"{name}.pgm").write_bytes(b"P5\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + a.tobytes())
    got = {r.path.rsplit("/", 1)[1]: r.hash for r in D.difference_hashes(spark, str(tmp_path / "*.pgm")).collect()}
    assert got == {"up.pgm": -1, "down.pgm": 0}


def png(a, depth=8, colour=0, interlaced=False, filters=(0, 1, 2, 3, 4), palette=None):
    """A PNG of samples (height x width x channels), its lines filtered by the kinds in turn."""
    h, w, c = a.shape
    step, packed, turn = max(1, c * depth // 8), b"", 0
    for x0, y0, dx, dy in PASSES if interlaced else [(0, 0, 1, 1)]:
        part = a[y0::dy, x0::dx]
        if part.size == 0:
            continue
        above = None
        for row in part.reshape(len(part), -1):
            if depth == 16:
                line = np.stack([row >> 8, row & 255], 1).ravel().tolist()
            else:
                line = np.packbits(((row[:, None] >> np.arange(depth)[::-1]) & 1).astype(np.uint8).ravel()).tolist()
            above = above or [0] * len(line)
            kind, out = filters[turn % len(filters)], []
            turn += 1
            for i, v in enumerate(line):
                left, up, corner = line[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
                far = {left: abs(up - corner), up: abs(left - corner), corner: abs(left + up - 2 * corner)}
                nearest = next(x for x in (left, up, corner) if far[x] == min(abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)))
                out.append((v - [0, left, up, (left + up) // 2, nearest][kind]) % 256)
            packed += bytes([kind, *out])
            above = line
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    data = zlib.compress(packed)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, int(interlaced))) + (chunk(b"PLTE", bytes(palette)) if palette else b"") + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", data[:20]) + chunk(b"IDAT", data[20:]) + chunk(b"IEND", b"")


def test_png_pixels():
    rng = np.random.default_rng(0)
    for w, h in ((23, 17), (1, 1), (9, 8), (3, 40)):
        for interlaced in (False, True):
            for depth in (1, 2, 4, 8, 16):
                a = rng.integers(0, 1 << depth, (h, w, 1))
                want = a[:, :, 0] >> 8 if depth == 16 else a[:, :, 0] * 255 // ((1 << depth) - 1)
                assert (decode_png(png(a, depth, 0, interlaced)) == want).all()
            for colour, c in ((2, 3), (6, 4)):
                a = rng.integers(0, 256, (h, w, c))
                assert (decode_png(png(a, 8, colour, interlaced)) == (a[:, :, :3] @ np.array(LUMA) + 32768 >> 16)).all()
            palette = rng.integers(0, 256, (16, 3))
            a = rng.integers(0, 16, (h, w, 1))
            assert (decode_png(png(a, 4, 3, interlaced, palette=palette.ravel().tolist())) == (palette[a[:, :, 0]] @ np.array(LUMA) + 32768 >> 16)).all()


def test_hashes_of_png_are_those_of_pgm(spark, tmp_path):
    rng = np.random.default_rng(1)
    for i in range(6):
        h, w = rng.integers(5, 70, 2)
        a = rng.integers(0, 256, (h, w)).astype(np.uint8) if i else np.full((h, w), 7, np.uint8)
        (tmp_path / f"{i}.pgm").write_bytes(b"P5\n%d %d\n255\n" % (w, h) + a.tobytes())
        (tmp_path / f"{i}.png").write_bytes(png(a[:, :, None].astype(int), interlaced=i % 2 == 1))
        means = np.array([[np.array([[Fraction(int(a[y, x])) * max(Fraction(0), min(Fraction((r + 1) * int(h), 8), y + 1) - max(Fraction(r * int(h), 8), y)) * max(Fraction(0), min(Fraction((c + 1) * int(w), 9), x + 1) - max(Fraction(c * int(w), 9), x)) for x in range(w)] for y in range(h)]).sum() for c in range(9)] for r in range(8)]) if i < 2 else None
        if means is not None:
            bits = [bool(m[c + 1] > m[c]) for m in means for c in range(8)]
            assert difference_hash(a) % 2**64 == sum(1 << k for k, b in enumerate(bits) if b)
    got = {r.path.rsplit("/", 1)[1]: r.hash for r in D.difference_hashes(spark, str(tmp_path / "*.p*")).collect()}
    assert len(got) == 12 and all(got[f"{i}.pgm"] == got[f"{i}.png"] for i in range(6))
    hashes = spark.createDataFrame([(k, v) for k, v in got.items()], "name string, hash long")
    near = near_hashes(hashes.where("name LIKE '%pgm'"), hashes.where("name LIKE '%png'"), "name", "hash")
    assert near.count() >= 6
