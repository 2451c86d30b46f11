"""Dataset building: splits, boxes, merges, samples; tables only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passgrid.functions.pixels import difference_hash, grey
from passgrid.sources.annotations import coco_rows, register

# Capture conditions by index range.
CONDITIONS = [(0, 9, "table"), (10, 19, "keyboard"), (20, 29, "hand"), (30, 39, "partial"), (40, 49, "clutter")]


def split_by_type(df: DataFrame, kind: str, test: list[str], valid: list[str]) -> DataFrame:
    return df.withColumn("split", F.when(F.col(kind).isin(*test), "test").when(F.col(kind).isin(*valid), "valid").otherwise("train"))


def split_by_number(df: DataFrame, number: Column, train: int = 32, valid: int = 36) -> DataFrame:
    return df.withColumn("split", F.when(number < train, "train").when(number < valid, "valid").otherwise("test"))


def split_by_group(df: DataFrame, group: str, valid: int = 10, test: int = 10) -> DataFrame:
    """All rows of a group in one split, by a hash of the group."""
    h = F.conv(F.left(F.sha2(F.col(group).cast("string"), 256), F.lit(8)), 16, 10).cast("long") % 100
    return df.withColumn("split", F.when(h < test, "test").when(h < test + valid, "valid").otherwise("train"))


def clip(v: Column, high) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(high).cast("double") if not isinstance(high, Column) else high.cast("double"), v))


def yolo_to_coco(cx: Column, cy: Column, w: Column, h: Column, width: int, height: int) -> Column:
    """Pixel box (x, y, w, h), clipped to the image, two decimals."""
    x, y = cx * width - w * width / 2, cy * height - h * height / 2
    x1, y1, x2, y2 = clip(x, width), clip(y, height), clip(x + w * width, width), clip(y + h * height, height)
    return F.struct(F.round(x1, 2).alias("x"), F.round(y1, 2).alias("y"), F.round(x2 - x1, 2).alias("w"), F.round(y2 - y1, 2).alias("h"))


def coco_to_yolo(x: Column, y: Column, w: Column, h: Column, width: int, height: int) -> Column:
    return F.struct(F.round((x + w / 2) / width, 6).alias("cx"), F.round((y + h / 2) / height, 6).alias("cy"), F.round(w / width, 6).alias("w"), F.round(h / height, 6).alias("h"))


def quad_to_box(quad: Column, width: int, height: int) -> Column:
    """The clipped box around a quadrilateral; null if it lies outside or is a pixel wide at most."""
    xs, ys = F.transform(quad, lambda p: p[0]), F.transform(quad, lambda p: p[1])
    outside = (F.array_max(xs) <= 0) | (F.array_min(xs) >= width) | (F.array_max(ys) <= 0) | (F.array_min(ys) >= height)
    x1, y1, x2, y2 = clip(F.array_min(xs), width), clip(F.array_min(ys), height), clip(F.array_max(xs), width), clip(F.array_max(ys), height)
    box = F.struct(F.round(x1, 2).alias("x"), F.round(y1, 2).alias("y"), F.round(x2 - x1, 2).alias("w"), F.round(y2 - y1, 2).alias("h"))
    return F.when((F.size(quad) >= 4) & ~outside & (x2 - x1 > 1) & (y2 - y1 > 1), box)


def long_side(width: Column, height: Column, side: int = 1280) -> Column:
    s = F.least(F.lit(1.0), side / F.greatest(width, height))
    return F.struct(F.round(width * s, 0).cast("int").alias("width"), F.round(height * s, 0).cast("int").alias("height"), s.alias("scale"))


def letterbox_to_image(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, side: int = 640) -> Column:
    """A box of the padded square back in the image's pixels."""
    s = F.least(side / width, side / height)
    px, py = (side - width * s) / 2, (side - height * s) / 2
    return F.struct(clip((x1 - px) / s, width).alias("x1"), clip((y1 - py) / s, height).alias("y1"), clip((x2 - px) / s, width).alias("x2"), clip((y2 - py) / s, height).alias("y2"))


def background_zones(x: Column, y: Column, w: Column, h: Column, width: int, height: int, least: int = 64) -> Column:
    """Parts of the image above, below, left and right of a box that are wide enough to cut from."""
    zone = lambda n, a, b, c, d, span: F.when(span >= least, F.struct(F.lit(n).alias("zone"), a.cast("double").alias("x"), b.cast("double").alias("y"), c.cast("double").alias("w"), d.cast("double").alias("h")))
    zero, wide, high = F.lit(0.0), F.lit(float(width)), F.lit(float(height))
    return F.array_compact(F.array(zone("above", zero, zero, wide, y, y), zone("below", zero, y + h, wide, high - y - h, high - y - h), zone("left", zero, zero, x, high, x), zone("right", x + w, zero, wide - x - w, high, wide - x - w)))


def sampled(df: DataFrame, group: str, key: str, most: int, seed: int) -> DataFrame:
    """At most so many rows a group, by a hash of key and seed: the same in every run."""
    place = F.row_number().over(W.partitionBy(group).orderBy(F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))), 256), key))
    return df.withColumn("__r", place).where(F.col("__r") <= most).drop("__r")


def capture_condition(df: DataFrame, number: str) -> DataFrame:
    ranges = df.sparkSession.createDataFrame(CONDITIONS, "low int, high int, condition string")
    joined = df.join(F.broadcast(ranges), F.col(number).between(F.col("low"), F.col("high")), "left")  # a fixed table of five ranges
    return joined.withColumn("condition", F.coalesce("condition", F.lit("unknown"))).drop("low", "high")


def merged_sources(sources: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Images and annotations of several sources in one numbering, with where they came from.

    New ids are dense: numbers within buckets of a hash, moved by the buckets before.
    """
    from passgrid.operators.ledger import running_index

    images = annotations = None
    for name, (i, a) in sources.items():
        i, a = i.withColumn("source", F.lit(name)), a.withColumn("source", F.lit(name))
        images = i if images is None else images.unionByName(i, allowMissingColumns=True)
        annotations = a if annotations is None else annotations.unionByName(a, allowMissingColumns=True)
    bucket = F.pmod(F.xxhash64("source", "image_id"), F.lit(64))
    images = running_index(images.withColumn("__b", bucket), "__b", ["source", "image_id"]).drop("__b").withColumnRenamed("index", "new_id")
    return images, annotations.join(images.select("source", "image_id", "new_id"), ["source", "image_id"])


def mrz_strips(df: DataFrame, kind: str, types: list[str]) -> DataFrame:
    """Boxes of the machine-readable strip (the lowest quarter) for the types that have one."""
    return df.where(F.col(kind).isin(*types)).withColumn("strip", F.struct(F.col("x").alias("x"), (F.col("y") + 0.75 * F.col("h")).alias("y"), F.col("w").alias("w"), (0.25 * F.col("h")).alias("h")))


def write_coco(images: DataFrame, annotations: DataFrame, path: str, categories: DataFrame | None = None) -> None:
    """One COCO document for each ``split``, whole or not there (see sources.annotations)."""
    register(images.sparkSession)
    coco_rows(images, annotations, categories).write.format("coco").mode("overwrite").option("path", path).save()


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Images and annotations of COCO documents, one row each."""
    doc = spark.read.option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))
    return doc.select("file", F.explode("images").alias("i")).select("file", "i.*"), doc.select("file", F.explode("annotations").alias("a")).select("file", "a.*")


def read_yolo(spark: SparkSession, path: str) -> DataFrame:
    """Label text files: one box a line; short, garbled or out-of-range lines are left out."""
    lines = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("image"), F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") >= 5)
    v = lines.select("image", F.get("p", F.lit(0)).try_cast("int").alias("label"), *[F.get("p", F.lit(i + 1)).try_cast("double").alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))])
    return v.where("label IS NOT NULL AND cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1 AND w > 0 AND w <= 1 AND h > 0 AND h <= 1")


def read_regions(spark: SparkSession, path: str, name: str = "doc_quad") -> DataFrame:
    """Polygon annotation files: file name and points of the wanted region."""
    kind = "map<string,struct<filename:string,regions:array<struct<shape_attributes:struct<all_points_x:array<double>,all_points_y:array<double>>,region_attributes:struct<field_name:string>>>>>"
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("k", "v"))
    regions = doc.select("v.filename", F.explode("v.regions").alias("r")).where(F.col("r.region_attributes.field_name") == name)
    return regions.select("filename", F.arrays_zip(F.col("r.shape_attributes.all_points_x").alias("x"), F.col("r.shape_attributes.all_points_y").alias("y")).alias("points"))


def read_quads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("quad array<array<double>>").option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))


def newest_evidence(spark: SparkSession, glob: str, dotted: str) -> DataFrame:
    """The newest file of a pattern and the value at a dotted key in it."""
    files = spark.read.text(glob, wholetext=True).select("value", F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_name").alias("file"))
    newest = files.agg(F.max_by(F.struct("file", "value"), F.struct("t", "file")).alias("x"))
    return newest.select("x.file", F.get_json_object("x.value", f"$.{dotted}").alias("value"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files per source, split and class, from paths alone (contents are not read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    part = lambda i: F.element_at(F.split("path", "/"), -i)
    return files.groupBy(part(4).alias("source"), part(3).alias("split"), part(2).alias("class")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def difference_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Difference hashes of PNG and binary grey PGM images: each of 8 x 8 area means against its right neighbour."""

    def run(batches):
        for d in batches:
            yield pd.DataFrame({"path": d["path"], "hash": [difference_hash(grey(bytes(x))) for x in d["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, hash long")
