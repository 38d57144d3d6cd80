"""Files that are read in parts give what whole files give."""

import random
import struct

import pytest

from fieldloom.sources import shapefile


def write(path, n, index):
    rng = random.Random(n)
    bodies = []
    for k in range(n):
        x, y = rng.uniform(0, 10), rng.uniform(0, 10)
        if k % 7 == 0:
            bodies.append(struct.pack("<i", 0))
        elif k % 3 == 0:
            bodies.append(struct.pack("<i2d", 1, x, y))
        else:
            m = 2 + k % 5
            flat = [v for j in range(m) for v in (x + j, y + j % 2)]
            bodies.append(struct.pack("<i4d2ii", 3, x, y, x + m - 1, y + 1, 1, m, 0) + struct.pack(f"<{2 * m}d", *flat))
    out, offsets, at = [], [], 100
    for k, b in enumerate(bodies):
        offsets.append(struct.pack(">2i", at // 2, len(b) // 2))
        out.append(struct.pack(">2i", k + 1, len(b) // 2) + b)
        at += 8 + len(b)
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, at // 2) + bytes(72)
    path.write_bytes(head + b"".join(out))
    if index:
        path.with_suffix(".shx").write_bytes(head + b"".join(offsets))


@pytest.mark.parametrize("index", [True, False])
def test_shapes_in_parts(spark, tmp_path, index):
    write(tmp_path / "a.shp", 103, index)
    write(tmp_path / "b.shp", 7, index)
    (tmp_path / "empty.shp").write_bytes(bytes(100))
    whole = shapefile.read_shapes(spark, str(tmp_path / "*.shp"))
    parts = shapefile.read_shapes_in_parts(spark, str(tmp_path / "*.shp"), records=10)
    assert parts.rdd.getNumPartitions() == 12
    rows = lambda df: sorted(((r.path.split("/")[-1], r.record, r.shape_type, r.bbox, r.rings) for r in df.collect()), key=lambda r: r[:2])
    assert rows(parts) == rows(whole) and len(rows(parts)) == 110
    box = (2.0, 3.0, 4.0, 6.0)
    inside = lambda r: r[4] and max(p.x for g in r[4] for p in g) >= 2 and min(p.x for g in r[4] for p in g) <= 4 and max(p.y for g in r[4] for p in g) >= 3 and min(p.y for g in r[4] for p in g) <= 6
    found = rows(shapefile.read_shapes_in_parts(spark, f"file:{tmp_path}/a.shp", records=10, box=box))
    assert {r[1] for r in found} >= {r[1] for r in rows(whole) if r[0] == "a.shp" and inside(r)} and 0 < len(found) < 60


def test_points_written_and_read(spark, tmp_path):
    points = spark.range(500).selectExpr("id AS pid", "CASE WHEN id % 11 <> 0 THEN id / 7D END AS x", "id % 13 * 1D AS y", "CASE WHEN id % 5 > 0 THEN concat('n', id) END AS name").repartition(3)
    folder = str(tmp_path / "made")
    shapefile.write_points(points, folder, ("pid", "name"))
    shapes = shapefile.read_shapes_in_parts(spark, f"{folder}/*.shp", records=50)
    values = shapefile.read_attributes_in_parts(spark, f"{folder}/*.dbf", records=40)
    assert values.rdd.getNumPartitions() >= 13
    whole = {(r.path.split("/")[-1], r.record): r["values"] for r in shapefile.read_attributes(spark, f"{folder}/*.dbf").collect()}
    assert whole == {(r.path.split("/")[-1], r.record): r["values"] for r in values.collect()}
    at = {(r.path.split("/")[-1][:-4], r.record): (r.rings[0][0].x, r.rings[0][0].y) if r.rings else (None, None) for r in shapes.collect()}
    found = {int(v["PID"]): (*at[p[:-4], k], v["NAME"]) for (p, k), v in whole.items()}
    assert found == {r.pid: (r.x, r.y if r.x is not None else None, r.name or "") for r in points.collect()}


def test_stores_that_are_not_mounted(spark):
    with pytest.raises(ValueError):
        shapefile.write_points(spark.range(1).selectExpr("1D AS x", "1D AS y"), "hdfs://store/points")
    with pytest.raises(Exception, match="mounted"):
        shapefile.read_shapes_in_parts(spark, "hdfs://store/*.shp").count()
