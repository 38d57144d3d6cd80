"""ESRI shapefiles: binary files read by Spark, records unpacked on the executors.

Defined cases: null shapes have no rings and no box; deleted attribute records keep their number and have nulls; missing measures are null.
"""

from __future__ import annotations

import glob
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Shape types of the format, plain, with Z and M values, with M values.
POINT, POLYLINE, POLYGON, MULTIPOINT = (1, 11, 21), (3, 13, 23), (5, 15, 25), (8, 18, 28)
ATTRIBUTES = "path string, record bigint, `values` map<string,string>"
#: Records of a pandas frame.
BATCH = 10_000
SHAPES = "path string, record bigint, shape_type int, bbox array<double>, rings array<array<struct<x:double,y:double,z:double,m:double>>>"


def _values(body: bytes, at: int, n: int) -> tuple[list[float | None], int]:
    """n doubles behind their range, if the body goes on so far."""
    if at + 16 + 8 * n > len(body):
        return [None] * n, at
    return list(struct.unpack_from(f"<{n}d", body, at + 16)), at + 16 + 8 * n


def _shape(body: bytes) -> tuple[int, list[float] | None, list]:
    (kind,) = struct.unpack_from("<i", body)
    if kind == 0:
        return kind, None, []
    if kind in POINT:
        numbers = struct.unpack_from(f"<{(len(body) - 4) // 8}d", body, 4)
        z = numbers[2] if kind == 11 else None
        m = numbers[3] if kind == 11 and len(numbers) > 3 else numbers[2] if kind == 21 and len(numbers) > 2 else None
        return kind, None, [[(numbers[0], numbers[1], z, m)]]
    box = list(struct.unpack_from("<4d", body, 4))
    if kind in MULTIPOINT:
        (n,), starts, at = struct.unpack_from("<i", body, 36), [0], 40
    else:
        parts, n = struct.unpack_from("<2i", body, 36)
        starts, at = list(struct.unpack_from(f"<{parts}i", body, 44)), 44 + 4 * parts
    xy = struct.unpack_from(f"<{2 * n}d", body, at)
    at += 16 * n
    z, at = _values(body, at, n) if kind in (13, 15, 18) else ([None] * n, at)
    m, at = _values(body, at, n) if kind > 10 else ([None] * n, at)
    points = list(zip(xy[::2], xy[1::2], z, m, strict=True))
    return kind, box, [points[a:b] for a, b in zip(starts, [*starts[1:], n], strict=True)]


def _shapes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, raw in zip(frame["path"], frame["content"], strict=True):
            rows, at, names = [], 100, ["path", "record", "shape_type", "bbox", "rings"]
            while at + 8 <= len(raw):
                number, words = struct.unpack_from(">2i", raw, at)
                kind, box, rings = _shape(raw[at + 8 : at + 8 + 2 * words])
                rows.append((path, number, kind, box, [[dict(zip("xyzm", p, strict=True)) for p in r] for r in rings]))
                at += 8 + 2 * words
                if len(rows) == BATCH:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of .shp files: record (from 1), shape_type, bbox and rings of points; a file is one task."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_shapes, SHAPES)


def points_of(shapes: DataFrame) -> DataFrame:
    """path, record, ring, pos, x, y, z, m."""
    rings = shapes.select("path", "record", F.posexplode("rings").alias("ring", "r"))
    return rings.select("path", "record", "ring", F.posexplode("r").alias("pos", "p")).select("path", "record", "ring", "pos", "p.*")


def _fields(raw: bytes) -> tuple[int, int, int, list[tuple[str, str, int]]]:
    n, head, size = struct.unpack_from("<IHH", raw, 4)
    fields = []
    for at in range(32, head - 1, 32):
        if raw[at : at + 1] == b"\r":
            break
        fields.append((raw[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(raw[at + 11]), raw[at + 16]))
    return n, head, size, fields


def _record(raw: bytes, fields: list[tuple[str, str, int]]) -> dict[str, str | None]:
    """Values of a record of a .dbf file by name; of a deleted one nulls."""
    at, values, gone = 1, {}, raw[:1] == b"*"
    for field, _, width in fields:
        values[field] = None if gone else raw[at : at + width].decode("latin-1").strip()
        at += width
    return values


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """path, record (from 1) and values (name to text) of .dbf files; deleted records keep their number and have nulls."""

    def records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                n, head, size, fields = _fields(raw)
                for first in range(0, n, BATCH):
                    rows = [(name, i + 1, _record(raw[head + i * size : head + (i + 1) * size], fields)) for i in range(first, min(n, first + BATCH))]
                    yield pd.DataFrame(rows, columns=["path", "record", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(records, ATTRIBUTES)


def attribute(name: str, kind: str = "double") -> Column:
    """A value of ``read_attributes`` as a type, null if it isn't one."""
    return F.col("values")[name].try_cast(kind)


def read_coordinate_system(spark: SparkSession, path: str) -> DataFrame:
    """path and the name of the geographic coordinate system of .prj files."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("value", r'GEOGCS\["([^"]+)"', 1).alias("gcs"))


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Shapes with their attributes and coordinate system, by record; files belong together by their name without suffix."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    shapes = read_shapes(spark, f"{folder}/*.shp").withColumn("layer", stem).drop("path")
    values = read_attributes(spark, f"{folder}/*.dbf").withColumn("layer", stem).drop("path")
    systems = read_coordinate_system(spark, f"{folder}/*.prj").withColumn("layer", stem).drop("path")
    return shapes.join(values, ["layer", "record"], "left").join(systems, "layer", "left")


# ---------------------------------------------------------------- files in parts


@dataclass
class FilePart(InputPartition):
    """Records ``first`` (from 1) up to ``first + count`` of a file, from byte ``start`` on."""

    path: str
    first: int
    count: int
    start: int


def _plain(path: str) -> str:
    """A path of the file system; others can't be opened in parts."""
    plain = path.removeprefix("file://").removeprefix("file:")
    if "://" in plain:
        raise ValueError(f"{path} isn't in a folder that is mounted")
    return plain


def record_offsets(path: str) -> list[int]:
    """Where the records of a .shp file begin: from its .shx file, or by one pass over the headers of the records."""
    index = re.sub(r"\.shp$", ".shx", path)
    if index != path and os.path.exists(index):
        with open(index, "rb") as f:
            raw = f.read()
        return [2 * at for (at, _) in struct.iter_unpack(">2i", raw[100 : len(raw) - (len(raw) - 100) % 8])]
    out, at, size = [], 100, os.path.getsize(path)
    with open(path, "rb") as f:
        while at + 8 <= size:
            f.seek(at + 4)
            (words,) = struct.unpack(">i", f.read(4))
            out.append(at)
            at += 8 + 2 * words
    return out


def _apart(body: bytes, box: tuple[float, ...]) -> bool:
    """Whether a record has nothing inside of ``box``, as its first bytes tell."""
    (kind,) = struct.unpack_from("<i", body)
    if kind == 0:
        return True
    lx, ly, ux, uy = struct.unpack_from("<2d", body, 4) * 2 if kind in POINT else struct.unpack_from("<4d", body, 4)
    return lx > box[2] or ux < box[0] or ly > box[3] or uy < box[1]


class _Reader(DataSourceReader):
    """Parts of ``records`` records each, of all files that the path names."""

    def __init__(self, options: dict[str, str]):
        self.paths = sorted(glob.glob(_plain(options["path"])))
        self.records = int(options.get("records", 50_000))
        self.box = tuple(map(float, options["box"].split(","))) if options.get("box") else None

    def split(self, path: str, offsets: list[int]) -> list[InputPartition]:
        return [FilePart(path, k + 1, min(self.records, len(offsets) - k), offsets[k]) for k in range(0, len(offsets), self.records)]


class ShapeReader(_Reader):
    def partitions(self) -> list[InputPartition]:
        return [part for p in self.paths for part in self.split(p, record_offsets(p))]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            for _ in range(partition.count):
                number, words = struct.unpack(">2i", f.read(8))
                body = f.read(2 * words)
                if self.box and _apart(body, self.box):
                    continue
                kind, box, rings = _shape(body)
                yield f"file:{partition.path}", number, kind, box, [[tuple(p) for p in r] for r in rings]


class AttributeReader(_Reader):
    def partitions(self) -> list[InputPartition]:
        out = []
        for p in self.paths:
            with open(p, "rb") as f:
                n, head, size, _ = _fields(f.read(32 + 32 * 256))
            out += [FilePart(p, k + 1, min(self.records, n - k), head + k * size) for k in range(0, n, self.records)]
        return out

    def read(self, partition: FilePart) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            _, _, size, fields = _fields(f.read(32 + 32 * 256))
            f.seek(partition.start)
            for k in range(partition.count):
                yield f"file:{partition.path}", partition.first + k, _record(f.read(size), fields)


class ShapeParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shape_parts"

    def schema(self) -> str:
        return SHAPES

    def reader(self, schema) -> DataSourceReader:
        return ShapeReader(self.options)


class AttributeParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "attribute_parts"

    def schema(self) -> str:
        return ATTRIBUTES

    def reader(self, schema) -> DataSourceReader:
        return AttributeReader(self.options)


def read_shapes_in_parts(spark: SparkSession, path: str, records: int = 50_000, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """As ``read_shapes``, ``records`` records to a task and one at a time in memory; with ``box`` (low x, low y, high x, high y) only those that may reach into it.

    For files in folders that the driver and all executors see as their own (others are read by ``read_shapes``).
    """
    spark.dataSource.register(ShapeParts)
    reader = spark.read.format("shape_parts").option("records", str(records))
    return (reader.option("box", ",".join(map(repr, box))) if box else reader).load(path)


def read_attributes_in_parts(spark: SparkSession, path: str, records: int = 50_000) -> DataFrame:
    """As ``read_attributes``, ``records`` records to a task: they are of one width, so each task begins where its first one does."""
    spark.dataSource.register(AttributeParts)
    return spark.read.format("attribute_parts").option("records", str(records)).load(path)


def write_points(points: DataFrame, folder: str, attributes: tuple[str, ...] = (), width: int = 20) -> None:
    """A .shp and a .dbf file for each partition of ``points`` (x, y and ``attributes``, as text of ``width`` characters), in a folder that the driver and all executors see as their own.

    Rows with a null coordinate are null shapes. A file appears whole or not at all, under a name that a repeated task replaces.
    """
    plain = _plain(folder)
    os.makedirs(plain, exist_ok=True)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, n, own, at = TaskContext.get().partitionId(), 0, f".{os.getpid()}", 100
        stem = f"{plain}/part-{part:05d}"
        fields = b"".join(a.upper().encode("latin-1")[:10].ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width]) + b"\0" * 15 for a in attributes)
        with open(f"{stem}.shp{own}", "wb") as shapes, open(f"{stem}.dbf{own}", "wb") as table:
            shapes.write(bytes(100))
            table.write(bytes(32) + fields + b"\r")
            for frame in frames:
                for row in frame.itertuples(index=False):
                    n += 1
                    body = struct.pack("<i", 0) if pd.isna(row.x) or pd.isna(row.y) else struct.pack("<i2d", 1, row.x, row.y)
                    shapes.write(struct.pack(">2i", n, len(body) // 2) + body)
                    at += 8 + len(body)
                    table.write(b" " + b"".join(("" if pd.isna(v) else str(v)).encode("latin-1", "replace")[:width].ljust(width) for v in (getattr(row, a) for a in attributes)))
            shapes.seek(0)
            shapes.write(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, at // 2) + struct.pack("<2i", 1000, 1))
            table.seek(0)
            table.write(struct.pack("<4BIHH", 3, 0, 0, 0, n, 32 + len(fields) + 1, 1 + width * len(attributes)))
        for kind in ("shp", "dbf"):
            os.replace(f"{stem}.{kind}{own}", f"{stem}.{kind}")
        yield pd.DataFrame({"n": [n]})

    points.select("x", "y", *attributes).mapInPandas(write, "n bigint").write.format("noop").mode("overwrite").save()
