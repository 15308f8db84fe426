import pytest
from pyspark.sql import Row

from parcelforge.operators import appraisal

PROPERTIES = [
    ("loc-1", 450000.0, "DOWNTOWN", "1090", "DC1", 350.0, 180.0, 2005, "Residential", "Y", 53.5460, -113.4930, 2, 2.0), ("loc-2", 470000.0, "DOWNTOWN", "1090", "DC1", 360.0, 182.0, 2006, "Residential", "Y", 53.5460, -113.4940, 2, 2.5),
    ("loc-3", 430000.0, "DOWNTOWN", "1090", "DC1", 340.0, 176.0, 2002, "Residential", "N", 53.5460, -113.4920, 3, 1.0), ("loc-4", 520000.0, "OLIVER", "1020", "RF3", 420.0, 210.0, 2010, "Residential", "Y", 53.5470, -113.4910, 4, 3.0),
    ("loc-5", 410000.0, "STRATHCONA", "5480", "RF1", 300.0, 160.0, 1998, "Residential", "N", 53.5450, -113.4950, 1, 1.0), ("loc-6", 560000.0, "GLENORA", "1180", "RF4", 480.0, 230.0, 2012, "Residential", "Y", 53.5480, -113.4940, 5, 4.0),
    ("loc-7", 390000.0, "WESTMOUNT", "3440", "RF2", 290.0, 150.0, 1995, "Residential", "N", 53.5440, -113.4940, None, None),
]
SCHEMA = "location_id string, value double, neighbourhood string, neighbourhood_id string, zoning string, lot_size double, gross_area double, year_built int, tax_class string, garage string, lat double, lon double, bedrooms int, bathrooms double"
HUB = (53.5460, -113.4940)
ROADS = [((53.5460, -113.4950), HUB), (HUB, (53.5460, -113.4930)), ((53.5460, -113.4930), (53.5460, -113.4920)), (HUB, (53.5470, -113.4910)), (HUB, (53.5450, -113.4950)), (HUB, (53.5480, -113.4940)), (HUB, (53.5440, -113.4940))]
PLACES = {
    "parks": [(53.5460, -113.4920), (53.5480, -113.4940), (53.5440, -113.4940)], "playgrounds": [(53.5450, -113.4950), (53.5460, -113.4950), (53.5470, -113.4910)],
    "schools": [(53.5460, -113.4950), (53.5470, -113.4910), (53.5440, -113.4940)], "libraries": [(53.5465, -113.4930)],
}
HERE, OFF = (53.5460, -113.4930), (53.5430, -113.4900)
CENTRES = [("downtown", 53.5461, -113.4938, 1.0)]


@pytest.fixture(scope="module")
def tables(spark):
    properties = spark.createDataFrame(PROPERTIES, SCHEMA)
    amenities = spark.createDataFrame([(k, f"{k}-{i}", *p) for k, places in PLACES.items() for i, p in enumerate(places)], "kind string, entity_id string, lat double, lon double")
    roads = spark.createDataFrame([(f"seg-{i}", [Row(lat=a[0], lon=a[1]), Row(lat=b[0], lon=b[1])]) for i, (a, b) in enumerate(ROADS)], "segment_id string, points array<struct<lat: double, lon: double>>")
    census = spark.createDataFrame([("N1090", 25000, 11000, 2.0, 12500.0, 0), ("N2000", 5000, 2800, 3.0, 1666.67, 0)], "area_id string, population int, households int, area_sq_km double, population_density double, limited_accuracy int")
    return properties, amenities, roads, census


def ask(spark, points, columns=""):
    return spark.createDataFrame(points, f"request_id string, lat double, lon double{columns}")


def test_with_roads_and_census(spark, tables):
    properties, amenities, roads, census = tables
    points = ask(spark, [("here", *HERE, 2005.0, "Y", "Residential"), ("off", *OFF, None, None, None)], ", year_built double, garage string, tax_class string")
    rows = appraisal.appraise(points, properties, amenities, roads, census=census, centres=CENTRES)
    got = {r.request_id: r for r in rows.collect()}
    here, off = got["here"], got["off"]
    assert (here.status, here.baseline_type, here.matched_property, here.base) == ("ok", "matched_property_assessment", "loc-1", 450000.0)
    assert 0 < here.low <= here.estimate <= here.high
    assert (here.n_parks, here.n_playgrounds, here.n_schools, here.n_libraries) == (3, 3, 3, 1)
    assert here.estimate_minus_assessed == pytest.approx(here.estimate - 450000.0)
    codes = [a.code for a in here.adjustments]
    assert "census_indicators" in codes and "commute_accessibility" in codes and codes == [a.code for a in sorted(here.adjustments, key=lambda a: (abs(a.value), a.code), reverse=True)]
    assert here.top_positive == [a.code for a in here.adjustments if a.value > 0][:3] and here.top_negative == [a.code for a in here.adjustments if a.value < 0][:3]
    assert here.estimate == pytest.approx(450000.0 + sum(a.value for a in here.adjustments), abs=0.1)
    assert "census_unavailable" not in here.warnings and "crime_unavailable" in here.warnings and "straight_line_fallback" not in here.warnings
    # 12 + 10 + 12 + 8 + 10 + 14 + 8 (census) + 18 of 100; 14 for the match, 6 for comparables that agree, 4 less for crime
    assert here.completeness == 92.0 and here.missing_factors == ["crime_statistics"] and here.fallback_flags == []
    assert here.confidence == 99.0 and here.label == "high"
    assert set(here.comparables_matching) == {"loc-1", "loc-2", "loc-4"} and "loc-3" in here.comparables_other
    # density 12500 against a mean of 7083.335, households 25/11 against a mean of 2.0292: 0.012 * 0.7647 + 0.008 * 0.12 of the baseline
    census_value = next(a.value for a in here.adjustments if a.code == "census_indicators")
    assert census_value == pytest.approx(450000 * (0.012 * (12500 - 7083.335) / 7083.335 + 0.008 * ((25 / 11) / ((25 / 11 + 50 / 28) / 2) - 1)), abs=0.01)
    assert (off.status, off.baseline_type, off.matched_property, off.estimate_minus_assessed) == ("ok", "nearest_neighbour_assessment", None, None)
    assert "baseline_nearest_neighbour" in off.fallback_flags and "baseline_nearest_neighbour" in off.warnings
    again = {r.request_id: r for r in appraisal.appraise(points, properties, amenities, roads, census=census, centres=CENTRES).collect()}
    assert again == got


def test_what_is_not_there_is_told(spark, tables):
    properties, amenities, _, _ = tables
    crime = spark.createDataFrame([("Downtown", 12.0)], "neighbourhood string, incidents double")
    r = appraisal.appraise(ask(spark, [("p", *HERE)]), properties, amenities.filter("kind != 'libraries'"), crime=crime, use_models=False, centres=[]).first()
    assert r.missing_factors == ["census_indicators", "commute_accessibility", "library_access"]
    assert r.fallback_flags == ["neighbourhood_value_model_disabled", "straight_line_distance"]
    assert {"libraries_unavailable", "census_unavailable", "straight_line_fallback", "employment_centers_unavailable"} <= set(r.warnings) and "crime_unavailable" not in r.warnings
    assert r.completeness == 12 + 10 + 12 + 14 + 8 + 18 and r.confidence == r.completeness + 14 - 12 - 7 + 2 and r.label == "medium"
    assert r.commute_label == "neutral" and r.comparables_matching == []


def test_rooms_split_comparables(spark, tables):
    properties, amenities, roads, _ = tables
    r = appraisal.appraise(ask(spark, [("p", *HERE, 2.0, 2.0)], ", bedrooms double, bathrooms double"), properties, amenities, roads, centres=CENTRES).first()
    assert {"loc-1", "loc-2"} <= set(r.comparables_matching) and "loc-3" not in r.comparables_matching and "loc-3" in r.comparables_other


def test_models_and_points_without_an_estimate(spark, tables):
    properties, amenities, _, _ = tables
    predictions = spark.createDataFrame([("loc-1", 500000.0, None)], "location_id string, ridge double, forest double")
    points = ask(spark, [("a", *HERE), ("b", 95.0, 0.0), ("c", None, 1.0), ("d", *OFF)])
    got = {r.request_id: r for r in appraisal.appraise(points, properties, amenities, predictions=predictions, centres=CENTRES).collect()}
    assert next(a.value for a in got["a"].adjustments if a.code == "neighbourhood_value_model") == pytest.approx(0.15 * 50000.0)
    assert not any(a.code == "neighbourhood_value_model" for a in got["d"].adjustments)
    assert [got[k].status for k in "abcd"] == ["ok", "invalid_point", "invalid_point", "ok"] and got["b"].estimate is None and got["b"].warnings is None
    bare = spark.createDataFrame([("x", None, "A", "1", 53.5, -113.5)], "location_id string, value double, neighbourhood string, neighbourhood_id string, lat double, lon double")
    assert appraisal.appraise(points.filter("request_id = 'a'"), bare, amenities, centres=CENTRES).first().status == "no_baseline"
    assert appraisal.appraise(points.filter("request_id = 'a'"), bare.limit(0), amenities, centres=CENTRES).first().status == "no_property"


def test_guard_rails(spark, tables):
    """Neighbours worth far more than the baseline: the estimate stops at the rail and says so."""
    properties, amenities, _, _ = tables
    rich = properties.selectExpr("location_id", "case when location_id = 'loc-1' then 1000.0 else -value * 1e3 end as value", "neighbourhood", "neighbourhood_id", "lat", "lon")
    predictions = spark.createDataFrame([("loc-1", 1e9, 1e9)], "location_id string, ridge double, forest double")
    r = appraisal.appraise(ask(spark, [("a", *HERE)]), rich, amenities, predictions=predictions, centres=CENTRES).first()
    assert r.estimate == pytest.approx(1350.0) and "valuation_guardrail" in r.fallback_flags and "valuation_guardrail" in r.warnings
