import json
import math
import random
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_more_sources import dbf, shp

from parcelforge.functions import shapes
from parcelforge.functions.projection import ALBERTA_3TM_114, TransverseMercator, WebMercator, from_prj
from parcelforge.operators import features
from parcelforge.sources.shapefile import read_shapefiles

#: Published example of the transverse Mercator method: the British grid, 50.5 north, 0.5 east.
BRITISH = TransverseMercator(lat0=49, lon0=-2, k0=0.9996012717, east0=400000, north0=-100000, a=6377563.396, inverse_flattening=299.32496)
ESRI = 'PROJCS["NAD_1983_3TM_114",GEOGCS["GCS",DATUM["D",SPHEROID["GRS_1980",6378137.0,298.257222101]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",500000.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",-114.0],PARAMETER["Scale_Factor",0.9999],PARAMETER["Latitude_Of_Origin",0.0],UNIT["%s",%s]]'


def test_published_point(spark):
    assert BRITISH.forward(50.5, 0.5, math) == pytest.approx((577274.99, 69740.50), abs=0.01)
    assert BRITISH.inverse(577274.99, 69740.50, math) == pytest.approx((50.5, 0.5), abs=1e-7)  # a centimetre
    x, y = BRITISH.forward(F.lit(50.5), F.lit(0.5))
    assert tuple(spark.range(1).select(x, y).first()) == pytest.approx((577274.99, 69740.50), abs=0.01)


@pytest.mark.parametrize("grid", [ALBERTA_3TM_114, BRITISH, TransverseMercator(lon0=-111, k0=0.9996, east0=500000, unit=0.3048), WebMercator()])
def test_there_and_back(grid):
    rng = np.random.default_rng(1)
    lat, lon = rng.uniform(-70, 70, 200), getattr(grid, "lon0", 0) + rng.uniform(-6, 6, 200)
    back = grid.inverse(*grid.forward(lat, lon, np), np)
    assert np.allclose(back, (lat, lon), atol=1e-9, rtol=0)


def test_prj_texts():
    assert from_prj(None) is None and from_prj(" ") is None and from_prj('GEOGCS["x"]') is None
    assert from_prj(ESRI % ("Meter", 1.0)) == TransverseMercator(lon0=-114, k0=0.9999, east0=500000)
    feet = from_prj(ESRI % ("Foot_US", 0.3048006096))
    assert feet.unit == 0.3048006096 and feet.forward(0.0, -114.0, math)[0] == pytest.approx(500000)
    new = 'PROJCRS["x",BASEGEOGCRS["y",DATUM["z",ELLIPSOID["GRS 1980",6378137,298.257222101,LENGTHUNIT["metre",1]]]],CONVERSION["c",METHOD["Transverse Mercator"],PARAMETER["Latitude of natural origin",0],PARAMETER["Longitude of natural origin",-114],PARAMETER["Scale factor at natural origin",0.9999],PARAMETER["False easting",0],PARAMETER["False northing",0]],CS[Cartesian,2],LENGTHUNIT["metre",1]]'
    assert from_prj(new) == ALBERTA_3TM_114
    assert from_prj('PROJCS["w",PROJECTION["Mercator_Auxiliary_Sphere"]]') == WebMercator()
    with pytest.raises(ValueError, match="albers"):
        from_prj('PROJCS["a",PROJECTION["Albers"]]')


def test_shapefiles_in_grids(spark, tmp_path):
    x, y = from_prj(ESRI % ("Meter", 1.0)).forward(53.5, -113.5, math)
    line = struct.pack("<i4d2ii4d", 3, x, y, x, y, 1, 2, 0, x, y, x, y)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name in ("grid", "plain"):
            z.writestr(f"{name}.shp", shp([struct.pack("<i2d", 1, x, y), line, struct.pack("<i", 0)]))
            z.writestr(f"{name}.dbf", dbf(["n"], [("a",), ("b",), ("c",)]))
        z.writestr("grid.prj", ESRI % ("Meter", 1.0))
    rows = {(r.layer, r.ordinal): r.points for r in read_shapefiles(spark, str(tmp_path)).collect()}
    for i in (0, 1):
        assert all((p.lat, p.lon) == pytest.approx((53.5, -113.5), abs=1e-9) for p in rows["grid", i]) and len(rows["grid", i]) == i + 1
    assert (rows["plain", 0][0].lon, rows["plain", 0][0].lat) == (x, y) and rows["grid", 2] == []
    seen = read_shapefiles(spark, str(tmp_path), "grid", bbox=(x - 2, y - 2, x - 1, y - 1)).collect()
    assert sorted(r.ordinal for r in seen) == [0, 2]  # points and empty records have no box of their own
    assert read_shapefiles(spark, str(tmp_path), "grid", bbox=(x - 2, y - 2, x, y)).count() == 3


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")


def test_what_is_a_geometry(spark):
    none = [None, "", "{", "[1,2]", "7", '"x"', "{}", '{"type":"Point"}', '{"type":"Point","coordinates":null}', '{"type":"","coordinates":[1,2]}', '{"coordinates":[1,2]}']
    df = texts(spark, *none, '{"type":"Odd","coordinates":{}}')
    got = df.select("i", shapes.geometry(F.col("t")).isNotNull().alias("g"), shapes.decoded(F.col("t"), F.lit(1.5), F.lit(None).cast("double")).alias("d")).orderBy("i").collect()
    assert [r.g for r in got] == [False] * len(none) + [True]
    assert json.loads(got[0].d) == {"type": "Point", "coordinates": [None, 1.5]} and json.loads(got[-1].d) == {"type": "Odd", "coordinates": {}}


def walked(value):
    """Positions by the plain rule."""
    if isinstance(value, list):
        if len(value) > 1 and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in value[:2]):
            yield float(value[1]), float(value[0])
        else:
            for v in value:
                yield from walked(v)


def test_positions_at_any_depth(spark):
    rng = random.Random(2)

    def nest(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice([[rng.randrange(-9, 9), rng.random() * 1e-7], [1.5, -2, 700], [], [3], ["[1,2", 4], [True, 1], "x [5,6]", None, 12])
        return [nest(depth - 1) for _ in range(rng.randrange(4))]

    found = [nest(rng.randrange(7)) for _ in range(200)]
    df = texts(spark, *[json.dumps({"type": "Any", "coordinates": c}) for c in found])
    for r in df.select("i", F.col("t"), shapes.positions(shapes.geometry(F.col("t"))).alias("p"), shapes.centre(shapes.geometry(F.col("t"))).alias("c")).collect():
        want = list(walked(found[r.i]))
        assert [(p.lat, p.lon) for p in r.p or []] == want
        assert (r.c is None) == (not want) and (not want or (r.c.lat, r.c.lon) == pytest.approx(tuple(sum(v) / len(want) for v in zip(*want, strict=True)), rel=1e-12, abs=1e-12))


def test_centres(spark):
    point, odd, ring, open_, one, broken = ('{"type":"Point","coordinates":["1.5", 2]}', '{"type":"Point","coordinates":["x", 2]}', '{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,4],[0,0]]]}', '{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,4]]]}', '{"type":"Polygon","coordinates":[[[5,6],[5,6]]]}', '{"type":"Polygon","coordinates":[[[5,6],["a",6]]]}')
    g = shapes.geometry(F.col("t"))
    rows = texts(spark, point, odd, ring, open_, one, broken, '{"type":"Polygon","coordinates":[]}').select("i", shapes.centre(g).alias("c"), shapes.ring_centre(g).alias("r")).orderBy("i").collect()
    assert (rows[0].c.lat, rows[0].c.lon) == (2.0, 1.5) and rows[1].c is None
    assert (rows[2].r.lon, rows[2].r.lat) == pytest.approx((4 / 3, 4 / 3)) == (rows[3].r.lon, rows[3].r.lat) and (rows[2].c.lon, rows[2].c.lat) == (1.0, 1.0)
    assert tuple(rows[4].r) == (6.0, 5.0) and rows[5].r is None and rows[6].r is None and rows[6].c is None


def square(x, y, s, back=False):
    ring = [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    return ring[::-1] if back else ring


def test_areas(spark):
    km2 = lambda y, s: s * s * 110.574 * 111.32 * math.cos(math.radians(y + 2 * s / 5))
    cases = [
        ("Polygon", [square(1, 50, 2)], km2(50, 2)), ("Polygon", [square(1, 50, 2, True), square(1.5, 50.5, 1)], km2(50, 2) - km2(50.5, 1)), ("Polygon", [square(0, 0, 1), square(0, 0, 3)], 0.0),
        ("MultiPolygon", [[square(1, 50, 2), square(1, 50, 1)], [square(9, 50, 1)]], km2(50, 2)), ("MultiPolygon", [[], [square(0, 10, 1), []]], km2(10, 1)), ("Polygon", [[[0, 0], [1, 1]]], 0.0), ("Polygon", [], 0.0),
        ("Polygon", [[[0, 0], [1, "a"], [1, 1], [0, 0]]], None), ("LineString", [[0, 0], [1, 1]], 0.0), ("MultiPolygon", None, None),
    ]
    df = texts(spark, *[json.dumps({"type": k, "coordinates": c}) for k, c, _ in cases])
    got = [r.a for r in df.select("i", shapes.area_km2(shapes.geometry(F.col("t"))).alias("a")).orderBy("i").collect()]
    assert got == [want if want is None else pytest.approx(want, rel=1e-9) for _, _, want in cases]


def test_area_on_the_grid(spark):
    # a small block about the central meridian: lengths of the ellipsoid's arcs, times the grid's scale twice
    a, e2, lat, half = 6378137.0, 2 / 298.257222101 - 1 / 298.257222101**2, math.radians(53.5), 0.005
    meridian = a * (1 - e2) / (1 - e2 * math.sin(lat) ** 2) ** 1.5
    across = a / math.sqrt(1 - e2 * math.sin(lat) ** 2) * math.cos(lat)
    want = meridian * across * math.radians(2 * half) ** 2 * 0.9999**2 / 1e6
    text = json.dumps({"type": "Polygon", "coordinates": [square(-114 - half, 53.5 - half, 2 * half)]})
    assert texts(spark, text).select(shapes.area_km2(shapes.geometry(F.col("t")), ALBERTA_3TM_114)).first()[0] == pytest.approx(want, rel=1e-6)


def test_areas_of_neighbourhoods(spark):
    shape = lambda s: json.dumps({"type": "Polygon", "coordinates": [square(0, 0, s)]})
    rows = [("7", None, shape(1), 2), ("7.0", "B", shape(2), 3), ("7", "A", "{", 1), ("x", "C", shape(1), 4), (None, "D", shape(1), 5), ("8", "E", None, 6)]
    df = spark.createDataFrame(rows, "number string, name string, geometry_json string, ordinal long")
    got = features.neighbourhood_areas(df).collect()
    assert [(r.neighbourhood_number, r.neighbourhood) for r in got] == [(7.0, "B")] and got[0].area_sq_km == pytest.approx(110.574 * 111.32 * math.cos(math.radians(0.4)))
    assert features.neighbourhood_areas(df.limit(0)).count() == 0


def test_payloads(spark):
    points = F.expr("array(struct(2D as lat, 1D as lon), struct(4D as lat, 3D as lon))")
    kinds = F.explode(F.array(*map(F.lit, ("roads", "boundaries", "schools"))))
    df = spark.range(1).select(kinds.alias("k"), points.alias("p"))
    got = {r.k: (json.loads(r.a), json.loads(r.b), json.loads(r.c)) for r in df.select("k", shapes.payload(F.lit(None).cast("string"), F.col("k"), F.col("p")).alias("a"), shapes.payload(F.lit("{"), F.col("k"), F.lit(None).cast("array<struct<lat:double,lon:double>>")).alias("b"), shapes.payload(F.lit('{"type":"X","coordinates":[1]}'), F.col("k"), F.col("p")).alias("c")).collect()}
    assert got["roads"][:2] == ({"type": "MultiLineString", "coordinates": [[[1, 2], [3, 4]]]}, {"type": "MultiLineString", "coordinates": [[]]})
    assert got["boundaries"][0] == {"type": "Polygon", "coordinates": [[[1, 2], [3, 4]]]}
    assert got["schools"][:2] == ({"type": "Point", "coordinates": [1, 2]}, {"type": "Point", "coordinates": [0, 0]})
    assert all(c == {"type": "X", "coordinates": [1]} for _, _, c in got.values())
