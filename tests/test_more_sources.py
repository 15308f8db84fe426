import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from parcelforge.functions import geo
from parcelforge.functions.similarity import alike, dashed
from parcelforge.operators import entity
from parcelforge.sources.shapefile import read_shapefiles


def shp(records):
    out = b""
    for i, body in enumerate(records, 1):
        out += struct.pack(">2i", i, len(body) // 2) + body
    return b"\0" * 100 + out


def dbf(names, rows, width=12):
    head = struct.pack("<B3BiHH20x", 3, 26, 1, 1, len(rows), 32 + 32 * len(names) + 1, 1 + width * len(names))
    for n in names:
        head += n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width]) + b"\0" * 15
    return head + b"\r" + b"".join(b" " + b"".join(v.encode("latin-1").ljust(width) for v in r) for r in rows)


def test_shapefiles(spark, tmp_path):
    point = struct.pack("<i2d", 1, -113.5, 53.5)
    line = struct.pack("<i4d2ii4d", 3, 0, 0, 0, 0, 1, 2, 0, -1.0, 2.0, -3.0, 4.0)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/Roads.shp", shp([point, line, struct.pack("<i", 0)]))
        z.writestr("x/Roads.dbf", dbf(["name", "kind"], [("Café", "a"), ("Elm", "b"), ("", "")]))
        z.writestr("other.shp", shp([point]))
    rows = {(r.layer, r.ordinal): r for r in read_shapefiles(spark, str(tmp_path)).collect()}
    assert len(rows) == 4
    assert rows["roads", 0].geometry_type == "Point" and rows["roads", 0].properties == {"name": "Café", "kind": "a"}
    assert [(p.lat, p.lon) for p in rows["roads", 1].points] == [(2.0, -1.0), (4.0, -3.0)]
    assert rows["roads", 2].geometry_type is None and rows["other", 0].properties == {}
    assert read_shapefiles(spark, str(tmp_path), "roads").count() == 3


def test_similarity(spark):
    df = spark.createDataFrame([("ELM ST NW", "ELM STRET NW", "École  St."), (None, "x", None)], "a string, b string, c string")
    rows = df.select(alike("a", "b").alias("r"), dashed("c").alias("d")).collect()
    assert rows[0].r == pytest.approx(0.857, abs=0.01) and rows[0].d == "ecole-st" and rows[1].r is None and rows[1].d is None


def test_status_of_searches(spark):
    found = spark.createDataFrame([("a", "p1", 53.5, -113.5), ("b", "p1", 53.5, -113.5), ("b", "p2", 53.5, -113.5), ("c", None, None, None), ("d", "p9", 10.0, 10.0)], "query string, location_id string, lat double, lon double")
    got = {r.query: (r.status, r.location_id) for r in entity.resolve_status(found, geo.CITY_BOX).collect()}
    assert got == {"a": ("resolved", "p1"), "b": ("ambiguous", None), "c": ("not_found", None), "d": ("unsupported_region", None)}


def test_segment(spark):
    lit = lambda *v: [F.lit(x) for x in v]
    r = spark.range(1).select(geo.to_segment(*lit(53.5, -113.5, 53.501, -113.51, 53.501, -113.49)).alias("s")).first().s
    assert r.metres == pytest.approx(111.3, abs=0.5) and r.share == pytest.approx(0.5)
