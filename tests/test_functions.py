import math

import pytest
from pyspark.sql import functions as F

from parcelforge.functions import geo, ids, text


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_numbers(spark):
    got = one(spark, *[text.to_double(F.lit(x)) for x in ("$1,234.5", " 7 ", "", "x", None)], *[text.to_int(F.lit(x)) for x in ("12.5", " 12 ", "")])
    assert got == (1234.5, 7.0, None, None, None, None, 12, None)


def test_text(spark):
    got = one(spark, text.tidy(F.lit("  a \n b ")), text.tidy(F.lit(" ")), text.slug(F.lit("Main St. NW")), text.slug(F.lit("--")), text.display(F.lit("dog_park  area")), text.first_known(F.lit(" "), F.lit(None).cast("string"), F.lit("x")))
    assert got == ("a b", None, "mainstnw", None, "Dog Park Area", "x")
    assert one(spark, text.to_bool(F.lit("Yes")), text.to_bool(F.lit("0")), text.leading_year(F.lit("2021-05")), text.leading_year(F.lit("2020/2021"))) == (True, False, 2021, 2020)


def test_roads_and_addresses(spark):
    assert one(spark, text.road_name(F.lit("52 Avenue NW")), text.road_name(F.lit("St.Albert-Trail")), text.road_name(F.lit(" "))) == ("52 AVE NW", "ST ALBERT TRL", None)
    assert one(spark, *[text.is_placeholder_name(F.lit(a), F.lit(b)) for a, b in ((None, "1"), ("1001", "1001"), ("1001", "7"), ("Main", "7"))]) == (True, True, True, False)
    assert one(spark, text.road_names(F.lit("A Street"), F.lit("a st"), F.lit(None).cast("string"), F.lit("B Rd"))) == (["A ST", "B RD"],)
    parts = one(spark, text.address_parts(F.lit("12-345 Main St NW")), text.address_parts(F.lit("345 Main St, Unit 7")), text.address_parts(F.lit("345 Main St")))
    assert [tuple(p) for p in parts] == [("12", "345", "MAIN ST NW"), ("7", "345", "MAIN ST"), (None, "345", "MAIN ST")]
    assert one(spark, text.street_key(F.lit("Elm Strret North West")), text.street_key(F.lit("elm street NW"))) == ("ELM ST NW", "ELM ST NW")
    assert one(spark, text.search_text(F.lit("10 st., Edmonton"))) == ("10 ST",)


def test_permits(spark):
    got = one(spark, *[text.permit_rooms(F.lit(x)) for x in ("3 bedroom 2 bathroom", "add half bath", "2 baths and half-bath", "deck")])
    assert [tuple(r) for r in got] == [(3, 2.0, 0.82), (None, 0.5, 0.72), (None, 2.5, 0.72), (None, None, None)]


def test_ids(spark):
    assert one(spark, ids.stable_id("loc", F.lit("address"), F.lit("100|mainstnw"))) == ("loc-" + __import__("hashlib").sha1(b"address|100|mainstnw").hexdigest()[:16],)
    key = lambda *a: tuple(one(spark, ids.location_key(*[F.lit(x) for x in a]))[0])
    assert key("2", "100", "Main St", 53.5, -113.5, "r") == ("address", "2|100|mainst")
    assert key(None, None, "Main St", 53.5, -113.5, "r") == ("spatial", "53.5|-113.5")
    assert key(None, None, None, None, -113.5, "r") == ("record", "r")


def test_geometry(spark):
    d = one(spark, geo.haversine(*[F.lit(x) for x in (53.5, -113.5, 53.6, -113.4)]), geo.two_legs(*[F.lit(x) for x in (53.5, -113.5, 53.6, -113.4)]), geo.two_legs(*[F.lit(x) for x in (53.6, -113.4, 53.5, -113.5)]))
    assert d[0] == pytest.approx(12950, rel=0.01) and d[1] != d[2] and d[1] > d[0]
    assert one(spark, geo.repaired_point(F.lit(-113.5), F.lit(53.5)))[0].asDict() == {"lat": 53.5, "lon": -113.5, "status": "swapped"}
    assert one(spark, geo.repaired_point(F.lit(999.0), F.lit(53.5)))[0].status == "invalid"
    ring = F.expr("array(struct(53.0D as lat, -113.0D as lon), struct(53.0D as lat, -112.99D as lon), struct(53.01D as lat, -112.99D as lon), struct(53.01D as lat, -113.0D as lon))")
    area, length, centre = one(spark, geo.ring_area_km2(ring), geo.polyline_length(ring), geo.vertex_mean(ring))
    assert area == pytest.approx(1.1132 * 1.1132 * math.cos(math.radians(53.005)), rel=1e-6)
    assert length > 2000 and centre.lat == pytest.approx(53.005)
    assert one(spark, geo.cell_id(F.lit(53.555), F.lit(-113.495), 0.01)) == ("-11350_5355",)


def test_street_types_and_half_baths(spark):
    keys = one(spark, *[text.street_key(F.lit(x)) for x in ("Elm Court", "Elm Terace", "elm way", "Elm Laen North West", "Elm CLOSE", "Elm Avenuee")])
    assert keys == ("ELM CRT", "ELM TER", "ELM WAY", "ELM LN NW", "ELM CLOSE", "ELM AVE")
    got = one(spark, *[text.permit_rooms(F.lit(x)) for x in ("add 1/2 bath", "2 Bathrooms + 1/2 bath", "4 BEDS", "")])
    assert [r.bathrooms for r in got] == [2.5, 2.5, None, None]
    assert [r.bedrooms for r in got] == [None, None, 4, None]


def test_distance_to_nowhere_is_null(spark):
    from pyspark.sql import functions as F

    from parcelforge.functions import geo

    row = spark.sql("select 53.5D as a, -113.5D as b, cast(null as double) as n").select(geo.haversine(F.col("a"), F.col("b"), F.col("n"), F.col("b")).alias("x"), geo.haversine(F.col("a"), F.col("b"), -F.col("a"), F.col("b") + 180).alias("y")).first()
    assert row.x is None and abs(row.y - 20015086.796) < 1
