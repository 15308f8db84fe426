import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelforge.operators import entity, ingest, listings, models, nearest, transit, validation, valuation
from parcelforge.plans.adapters import view


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_property_fold_keeps_year_without_values(spark):
    rows = spark.createDataFrame([("a", None, 2001, "s1", 0.5, " ", 0), ("a", None, 2005, "s2", 0.5, "RF1", 1), ("b", 5.0, 2003, "s1", None, "x", 2), ("b", 6.0, 2003, "s2", 0.0, "y", 3), ("b", None, 2009, "s3", 0.9, "z", 4)], "location_id string, value double, year long, source_id string, confidence double, zoning string, ordinal long")
    got = {r.location_id: (r.zoning, r.year, r.value, r.source_id) for r in ingest.merge_properties(rows, ["zoning"]).collect()}
    assert got == {"a": ("RF1", 2001, None, "s2"), "b": ("x", 2003, 6.0, "s3")}


def test_promotion_rules(spark):
    schema = "location_id string, bedrooms long, bathrooms double, bedrooms_estimated long, bathrooms_estimated double, confidence double, source_type string"
    old = spark.createDataFrame([("a", 2, 1.0, None, 1.0, 0.5, "observed"), ("b", 2, 1.0, 4, 1.0, 0.5, "imputed"), ("c", 2, 1.0, 4, 1.0, 0.9, "inferred")], schema)
    new = spark.createDataFrame([("a", 5, 3.0, 5, 3.0, 0.99, "inferred"), ("b", 5, 3.0, 5, 3.0, 0.2, "inferred"), ("c", 5, 3.0, 5, 3.0, 0.1, "inferred"), ("d", 5, 3.0, None, None, 0.1, "imputed")], schema)
    got = {r.location_id: tuple(r)[1:] for r in entity.promote(old, new).collect()}
    assert got["a"] == (2, 1.0, 5, 1.0, 0.5, "observed")
    assert got["b"] == (5, 3.0, 4, 1.0, 0.2, "inferred")
    assert got["c"][0] == 2 and got["d"][0] == 5


def test_census_pivot_priorities(spark):
    rows = spark.createDataFrame([("x", "Population", 10.0, 0), ("x", "Population", 11.0, 1), ("x", "Private dwellings occupied by usual residents", 4.0, 2), ("x", "Total dwellings", 9.0, 3), ("y", "Land area in square kilometres", 2.0, 0)], "area string, label string, amount double, ordinal int")
    got = {r.area: (r.population, r.households, r.area_km2) for r in ingest.census_pivot(rows).collect()}
    assert got == {"x": (11.0, 4.0, None), "y": (None, None, 2.0)}


def test_valuation_rules(spark):
    lit = F.lit
    assert one(spark, valuation.compared(lit(100000.0), lit(200000.0), "matching"), valuation.compared(lit(100000.0), lit(None).cast("double"), "nearby")) == (12000.0, 0.0)
    assert one(spark, valuation.amenity_adjustment(lit(100000.0), lit(0.0), "parks"))[0] == pytest.approx(100000 * 0.018 * 0.65)
    assert one(spark, *[valuation.step_factor(lit(float(d))) for d in (100, 700, 1500, 5000)], valuation.step_factor(lit(100.0), -1)) == (5000.0, 2000.0, 500.0, 0.0, -5000.0)
    assert one(spark, *[valuation.confidence_label(lit(x)) for x in (80, 60, 40, 39)]) == ("high", "medium", "low", "very_low")
    census = one(spark, valuation.census_adjustment(lit(1e6), lit(2.0), lit(2.0), lit(1.0), lit(2.0), lit(False)), valuation.census_adjustment(lit(1e6), lit(2.0), lit(2.0), lit(1.0), lit(2.0), lit(True)))
    assert census == pytest.approx((12000.0, 6000.0))
    assert one(spark, models.model_adjustment(lit(400000.0), lit(500000.0), lit(None).cast("double")), models.model_adjustment(lit(400000.0), lit(None).cast("double")), models.model_adjustment(lit(400000.0), lit(9e6))) == pytest.approx((15000.0, 0.0, 20000.0))


def test_ridge_against_numpy(spark):
    p = view(spark, "/root/testdata/sf0.01", "properties").filter("value is not null")
    rows = models.design(p, ["gross_area", "lot_size"], {"zoning": ["RF1"]}, "ward")
    fitted = models.fit_ridge(rows, "ward", "value", 3)
    assert fitted.count() == 5
    for m in fitted.collect():
        got = rows.filter(F.col("ward") == m.ward).select("x", "value").toPandas()
        x, y = np.stack(got.x.to_numpy()), got.value.to_numpy()
        xc, yc = x - x.mean(0), y - y.mean()
        beta = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
        assert np.allclose(m.coefficients, beta, rtol=1e-5)
        assert m.intercept == pytest.approx(y.mean() - x.mean(0) @ beta, rel=1e-6)
        assert m.r2 == pytest.approx(1 - ((yc - xc @ beta) ** 2).sum() / (yc**2).sum(), abs=1e-6)
    assert models.predict(rows, fitted, "ward").filter("prediction is null").count() == 0


def test_polygons(spark):
    ring = lambda *p: F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in p])
    reason = lambda kind, r: [i.reason for i in one(spark, validation.polygon_issues(F.lit(kind), r))[0]]
    square = ((0, 0), (0, 1), (1, 1), (1, 0), (0, 0))
    assert reason("Polygon", ring(*square)) == []
    assert reason("Point", ring(*square)) == ["invalid_format"]
    assert reason("polygon", ring(*square[:3])) == ["too_few_points"]
    assert reason("polygon", ring(*square[:4])) == ["not_closed"]
    assert reason("polygon", ring((0, 0), (1, 1), (0, 1), (1, 0), (0, 0))) == ["self_intersection"]
    assert reason("polygon", ring((0, 0), (99, 1), (0, 1), (0, 0))) == ["out_of_range"]
    issues = one(spark, validation.address_issues(F.lit("ab")), validation.detail_issues({"beds": F.lit("x"), "area": F.lit("-1"), "baths": F.lit(None).cast("string")}))
    assert [i.reason for i in issues[0]] == ["too_short", "no_house_number"] and [(i.field, i.reason) for i in issues[1]] == [("beds", "not_numeric"), ("area", "out_of_range")]


def test_listings(spark):
    card = "For sale\n$450,000\n12-345 Elm Street NW, Edmonton\n3 beds 2.5 baths 1,250 sqft"
    assert tuple(one(spark, listings.card_fields(F.lit(card)))[0]) == (450000.0, 1250.0, 3, 2.5, "12-345 Elm Street NW, Edmonton")
    l = spark.createDataFrame([("l1", "12-345 Elm Strret NW, Edmonton"), ("l2", "9 Oak Rd")], "listing_id string, address string")
    a = spark.createDataFrame([("p1", "345 Elm St NW"), ("p2", "345 ELM STREET NW"), ("p3", "77 Oak Rd")], "location_id string, address string")
    assert [(r.listing_id, r.location_id) for r in listings.resolve(l, a).collect()] == [("l1", "p1")]


def test_transit(spark):
    trips = spark.createDataFrame([("r1", [{"lat": 53.5, "lon": -113.5}, {"lat": 53.51, "lon": -113.5}, {"lat": 53.52, "lon": -113.5}])], "route_id string, points array<struct<lat:double,lon:double>>")
    stops = spark.createDataFrame([("b", 53.5199, -113.5), ("a", 53.5001, -113.5), ("far", 53.7, -113.5)], "stop_id string, lat double, lon double")
    got = sorted((r.position, r.stop_id) for r in transit.route_stops(trips, stops).collect())
    assert got == [(0, "a"), (2, "b")]
    assert [(r.route_id, r.trips) for r in transit.routes(trips).collect()] == [("r1", 1)]
    pois = view(spark, "/root/testdata/sf0.001", "pois")
    assert transit.find_pois(pois, source="POIS_A", category="promo", centre=(53.5461, -113.4938), radius=5000.0).filter("source_id != 'pois_a'").count() == 0


def test_nearest_one_is_not_hidden_by_many_points_of_lesser_l1(spark):
    points = [(f"unit{i}", 53.51, -113.5) for i in range(40)] + [("house", 53.5, -113.488)]
    t = spark.createDataFrame([("t", 53.5, -113.5)], "target_id string, t_lat double, t_lon double")
    p = spark.createDataFrame(points, "point_id string, p_lat double, p_lon double")
    assert nearest.nearest_one(t, p, scaled=True).first().point_id == "house"
    assert nearest.nearest_one(t, p, scaled=False).first().point_id == "unit0"


def test_duplicate_confidence_counts_equal_ids_and_plain_names(spark):
    rows = [("a", "s1", "St. Anne", 53.5), ("a", "s2", "St Anne", 53.5), ("b", "s1", " Elm Park ", 53.6), ("c", "s2", "elm park", 53.6)]
    pois = spark.createDataFrame([(i, s, n, "c", lat, -113.5) for i, s, n, lat in rows], "entity_id string, source_id string, name string, category string, lat double, lon double")
    got = {(r.a, r.b): round(r.confidence, 4) for r in entity.duplicate_pairs(pois).collect()}
    assert got == {("a", "a"): 0.55 + 0.35 * 0.4 + 0.1, ("b", "c"): 0.9}


def test_comparables_need_what_the_target_tells(spark):
    told = ("year_built", "bedrooms", "bathrooms", "gross_area", "lot_size", "tax_class")
    target = (2000, 3, 2.0, 1000.0, 500.0, "res")
    others = [((2004, 4, 2.5, 1200.0, 400.0, "RES "), True), ((2006, 3, 2.0, 1000.0, 500.0, "RES"), False), ((2000, 5, 2.0, 1000.0, 500.0, "RES"), False), ((2000, None, 2.0, 1000.0, 500.0, "RES"), False),
              ((2000, 3, 3.0, 1000.0, 500.0, "RES"), False), ((2000, 3, 2.0, 1201.0, 500.0, "RES"), False), ((None, 3, 2.0, 1000.0, 500.0, "RES"), False), ((2000, 3, 2.0, 1000.0, 500.0, None), False)]
    kinds = "int, {0}bedrooms int, {0}bathrooms double, {0}gross_area double, {0}lot_size double, {0}tax_class string"
    schema = ", ".join(f"{p}year_built " + kinds.format(p) for p in ("t_", ""))
    df = spark.createDataFrame([(*target, *o) for o, _ in others], schema)
    assert [r[0] for r in df.select(valuation.comparable_rule()).collect()] == [w for _, w in others]
    nothing = spark.createDataFrame([(*[None] * 6, *target)], schema)
    assert nothing.select(valuation.comparable_rule()).first()[0] is False
    assert len(told) * 2 == len(df.columns)
