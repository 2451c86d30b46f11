"""Data sources for annotation files: COCO documents, YOLO label files and VIA polygon files.

``register(spark)`` makes them known; then ``spark.read.format("coco").option("table", "images")`` and
so on.  A file is a partition.  The writer of COCO documents commits in two phases: tasks write
parts, and only when all of them are done are the parts strung together to one document for each
split.  Paths must be ones that the driver and the executors can open, in a folder that they share.
"""

from __future__ import annotations

import glob
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

TABLES = {"image": "images", "annotation": "annotations", "category": "categories"}


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    """One partition a file; files of a folder by their ending, in order."""

    ending = ".json"

    def __init__(self, options: dict[str, str]):
        self.options, self.path = options, _local(options["path"])

    def partitions(self) -> list[File]:
        found = glob.glob(os.path.join(self.path, "**", f"*{self.ending}"), recursive=True) if os.path.isdir(self.path) else glob.glob(self.path)
        return [File(p) for p in sorted(found)] or [File("")]

    def read(self, partition: File) -> Iterator[tuple]:
        if partition.path:
            with open(partition.path, encoding="utf-8") as f:
                yield from self.rows(os.path.basename(partition.path), f.read())

    def rows(self, name: str, text: str) -> Iterator[tuple]:
        raise NotImplementedError


class CocoReader(_Reader):
    def rows(self, name: str, text: str) -> Iterator[tuple]:
        doc = json.loads(text)
        number = lambda v: None if v is None else int(v)
        if self.options.get("table", "annotations") == "images":
            yield from ((name, number(i.get("id")), i.get("file_name"), number(i.get("width")), number(i.get("height"))) for i in doc.get("images") or [])
        else:
            for a in doc.get("annotations") or []:
                yield name, number(a.get("id")), number(a.get("image_id")), number(a.get("category_id")), [float(x) for x in a.get("bbox") or []], None if a.get("area") is None else float(a["area"]), number(a.get("iscrowd"))


class YoloReader(_Reader):
    """Boxes of label files; short, garbled and out-of-range lines are left out."""

    ending = ".txt"

    def rows(self, name: str, text: str) -> Iterator[tuple]:
        for line in text.splitlines():
            try:
                label, *box = line.split()[:5]
                x, y, w, h = map(float, box)
                if 0 <= x <= 1 and 0 <= y <= 1 and 0 < w <= 1 and 0 < h <= 1:
                    yield name.removesuffix(".txt"), int(label), x, y, w, h
            except ValueError:
                continue


class ViaReader(_Reader):
    """Polygons of the regions named by the option ``region``."""

    def rows(self, name: str, text: str) -> Iterator[tuple]:
        for entry in json.loads(text).values():
            for region in entry.get("regions") or []:
                shape = region.get("shape_attributes") or {}
                if (region.get("region_attributes") or {}).get("field_name") == self.options.get("region", "doc_quad"):
                    yield entry.get("filename"), [float(x) for x in shape.get("all_points_x") or []], [float(y) for y in shape.get("all_points_y") or []]


@dataclass
class Parts(WriterCommitMessage):
    files: list[tuple[str, str, str]]  # split, kind, file


class CocoWriter(DataSourceWriter):
    """Rows (split, kind, doc) to one document a split; nothing is seen of a write that fails.

    A task appends each split's entries to files of its own, with a name that no other attempt has.  The
    commit strings the parts named by the successful attempts together, line by line, under a
    hidden name, and moves the document into place when it is whole; then all parts go, those of lost
    attempts too.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = _local(path), overwrite
        self.parts = os.path.join(self.path, f"_parts-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Parts:
        os.makedirs(self.parts, exist_ok=True)
        mark, files = uuid.uuid4().hex, {}
        try:
            for row in iterator:
                key = row["split"], row["kind"]
                if key not in files:
                    files[key] = open(os.path.join(self.parts, f"{mark}-{len(files)}"), "w", encoding="utf-8")
                json.loads(row["doc"])  # a part holds whole entries only
                files[key].write(row["doc"].replace("\n", " ") + "\n")
        finally:
            for f in files.values():
                f.close()
        return Parts([(split, kind, f.name) for (split, kind), f in files.items()])

    def commit(self, messages: list[Parts | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        parts = [p for m in messages if m for p in m.files]
        done = []
        for split in sorted({p[0] for p in parts}):
            hidden = os.path.join(self.path, f".{split}-{uuid.uuid4().hex}")
            with open(hidden, "w", encoding="utf-8") as out:
                for i, (kind, name) in enumerate(TABLES.items()):
                    out.write(("{" if i == 0 else ",\n") + json.dumps(name) + ": [")
                    first = True
                    for _, _, file in sorted(p for p in parts if p[:2] == (split, kind)):
                        with open(file, encoding="utf-8") as f:
                            for line in f:
                                out.write(("\n" if first else ",\n") + line.rstrip("\n"))
                                first = False
                    out.write("]")
                out.write("}\n")
            done.append((hidden, os.path.join(self.path, f"{split}.json")))
        if self.overwrite:
            for old in glob.glob(os.path.join(glob.escape(self.path), "*.json")):
                os.remove(old)
        for hidden, place in done:
            os.replace(hidden, place)
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list[Parts | None]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)
        if os.path.isdir(self.path) and not os.listdir(self.path):
            os.rmdir(self.path)


class Coco(DataSource):
    @classmethod
    def name(cls) -> str:
        return "coco"

    def schema(self) -> str:
        if self.options.get("table", "annotations") == "images":
            return "file string, id long, file_name string, width long, height long"
        return "file string, id long, image_id long, category_id long, bbox array<double>, area double, iscrowd long"

    def reader(self, schema: StructType) -> CocoReader:
        return CocoReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> CocoWriter:
        return CocoWriter(self.options["path"], overwrite)


class Yolo(DataSource):
    @classmethod
    def name(cls) -> str:
        return "yolo"

    def schema(self) -> str:
        return "image string, label int, cx double, cy double, w double, h double"

    def reader(self, schema: StructType) -> YoloReader:
        return YoloReader(dict(self.options))


class Via(DataSource):
    @classmethod
    def name(cls) -> str:
        return "via"

    def schema(self) -> str:
        return "filename string, xs array<double>, ys array<double>"

    def reader(self, schema: StructType) -> ViaReader:
        return ViaReader(dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (Coco, Yolo, Via):
        spark.dataSource.register(source)


def coco_rows(images: DataFrame, annotations: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """(split, kind, doc) of tables that have a column ``split``; the other columns are the entries' fields, nulls left out."""
    entry = lambda df, kind: df.select("split", F.lit(kind).alias("kind"), F.to_json(F.struct(*[c for c in df.columns if c != "split"])).alias("doc"))
    rows = entry(images, "image").unionByName(entry(annotations, "annotation"))
    return rows if categories is None else rows.unionByName(entry(categories, "category"))
