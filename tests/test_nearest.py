"""Nearest neighbours against all pairs, and that crowds are not paired."""

import math
import random

import pytest
from pairs import most_joined
from pyspark.sql import functions as F

from parcelforge.operators import appraisal, nearest, records, valuation

TARGETS, POINTS = "target_id string, t_lat double, t_lon double", "point_id string, p_lat double, p_lon double"


def metres(a, b):
    def one(p, q):
        h = math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * 6_371_000.0 * math.asin(math.sqrt(min(1.0, h)))

    return one(a, (a[0], b[1])) + one((a[0], b[1]), b)


def first(target, points, most):
    """Of (id, lat, lon, ...) the nearest by L1 degrees, ties by id."""
    return sorted(points, key=lambda p: (abs(target[1] - p[1]) + abs(target[2] - p[2]), p[0]))[:most]


def by_metres(target, points):
    return sorted(points, key=lambda p: (round(metres(target[1:3], p[1:3]), 6), p[0]))


def scattered(rng, name, n):
    """Some points on a coarse grid (with ties and copies), some dense, some alone, far away or at another place of the earth."""
    spots = [lambda: (53.5 + rng.randrange(12) / 100, -113.5 + rng.randrange(12) / 100), lambda: (53.5 + rng.random() / 1000, -113.4 + rng.random() / 1000), lambda: (53.3, -113.9), lambda: (rng.uniform(-80, 80), rng.uniform(-179, 179))]
    return [(f"{name}{i}", *rng.choices(spots, [6, 8, 2, 1])[0]()) for i in range(n)]


def crowd(name, n):
    """Points of one block of streets, each at its own place, no two equally far from a third."""
    rng = random.Random(9)
    return [(f"{name}{i}", 53.501 + rng.random() / 100, -113.499 + rng.random() / 100) for i in range(n)]


@pytest.mark.parametrize("points", [0, 20, 600])
def test_nearest_by_both_stages_against_all_pairs(spark, points):
    rng = random.Random(points)
    t, p = scattered(rng, "t", 150), scattered(rng, "p", points)
    got = {}
    for r in nearest.knn(spark.createDataFrame([*t, ("none", None, 1.0)], TARGETS), spark.createDataFrame([*p, ("none", 1.0, None)], POINTS), k=3).collect():
        got.setdefault(r.target_id, []).append((r["rank"], round(r.distance, 3)))
    want = {x[0]: [(i + 1, round(metres(x[1:3], y[1:3]), 3)) for i, y in enumerate(by_metres(x, first(x, p, 25))[:3])] for x in t if p}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_nearest_of_each_kind_against_all_pairs(spark):
    rng = random.Random(3)
    t = scattered(rng, "t", 60)
    p = [(*x, "few" if i < 9 else "many" if i % 3 else "some") for i, x in enumerate(scattered(rng, "p", 500))]
    rows = nearest.knn(spark.createDataFrame(t, TARGETS), spark.createDataFrame([*p, ("x", 53.5, -113.5, None)], POINTS + ", kind string"), k=2, by="kind").collect()
    want = {(x[0], kind, i + 1, round(metres(x[1:3], y[1:3]), 3)) for x in t for kind in ("few", "many", "some") for i, y in enumerate(by_metres(x, first(x, [q for q in p if q[3] == kind], 25))[:2])}
    assert {(r.target_id, r.kind, r["rank"], round(r.distance, 3)) for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("scaled", [True, False])
def test_nearest_by_squares_against_all_pairs(spark, scaled):
    rng = random.Random(7)
    t, p = scattered(rng, "t", 200), scattered(rng, "p", 400)
    def square(a, b):
        wide = (a[2] - b[2]) * (math.cos(math.radians(a[1])) if scaled else 1.0)
        return (a[1] - b[1]) * (a[1] - b[1]) + wide * wide

    got = {r.target_id: r.point_id for r in nearest.nearest_one(spark.createDataFrame(t, TARGETS), spark.createDataFrame(p, POINTS), scaled).collect()}
    assert got == {x[0]: min(p, key=lambda y: (square(x, y), y[0]))[0] for x in t}


def test_nearest_stop_in_a_crowd_is_found_without_pairing_it(spark):
    t, p = crowd("t", 1500), crowd("p", 2000)
    rows, most = most_joined(spark, lambda: nearest.knn(spark.createDataFrame(t, TARGETS), spark.createDataFrame(p, POINTS), k=1).collect())
    assert {r.target_id: r.point_id for r in rows} == {x[0]: by_metres(x, first(x, p, 25))[0][0] for x in t}
    assert most < 100_000  # 3,000,000 pairs


def test_many_schools_at_one_place_are_not_all_paired(spark):
    t = crowd("t", 1000)
    p = [(f"p{i}", 53.5 + i % 40 / 10_000, -113.5) for i in range(4000)]
    rows, most = most_joined(spark, lambda: nearest.knn(spark.createDataFrame(t, TARGETS), spark.createDataFrame(p, POINTS), k=3).collect())
    assert {(r.target_id, r["rank"], r.point_id) for r in rows} == {(x[0], i + 1, y[0]) for x in t for i, y in enumerate(by_metres(x, first(x, p, 25))[:3])}
    assert most < 100_000  # 4,000,000 pairs


def test_nearest_by_scaled_squares_in_a_crowd_is_found_without_pairing_it(spark):
    t, p = crowd("t", 1500), crowd("p", 2000)
    rows, most = most_joined(spark, lambda: nearest.nearest_one(spark.createDataFrame(t, TARGETS), spark.createDataFrame(p, POINTS), scaled=True).collect())
    assert {r.target_id: r.point_id for r in rows} == {f"t{i}": f"p{i}" for i in range(1500)}
    assert most < 100_000  # 3,000,000 pairs


def test_nearest_by_unscaled_squares_in_a_crowd_is_found_without_pairing_it(spark):
    t, p = crowd("t", 1500), crowd("p", 2000)
    rows, most = most_joined(spark, lambda: nearest.nearest_one(spark.createDataFrame(t, TARGETS), spark.createDataFrame(p, POINTS), scaled=False).collect())
    assert {r.target_id: r.point_id for r in rows} == {f"t{i}": f"p{i}" for i in range(1500)}
    assert most < 100_000  # 3,000,000 pairs


def test_nearest_on_a_long_street_is_found_without_pairing_the_street(spark):
    p = [(*x, "long" if i < 1500 else "twin" if i % 2 else None) for i, x in enumerate([*crowd("p", 1504), ("p9", 53.501, -113.499)])]
    df = spark.createDataFrame(p, POINTS + ", street string")
    t = df.selectExpr("point_id as target_id", "p_lat as t_lat", "p_lon as t_lon", "street")
    rows, most = most_joined(spark, lambda: nearest.same_street(t, df, 3).collect())
    want = {(x[0], i + 1, y[0]) for x in p if x[3] for i, y in enumerate(by_metres(x, first(x, [q for q in p if q[3] == x[3] and q[0] != x[0]], 25))[:3])}
    assert {(r.target_id, r["rank"], r.point_id) for r in rows} == want
    assert most < 100_000  # 2,250,000 pairs


def test_adjustment_by_comparables_in_a_crowd_without_pairing_it(spark):
    p = crowd("p", 1500)
    df = spark.createDataFrame([(*x, float(i)) for i, x in enumerate(p)], POINTS + ", value double")
    t = df.selectExpr("point_id as target_id", "p_lat as t_lat", "p_lon as t_lon", "value as base")
    rows, most = most_joined(spark, lambda: records.comparable_adjustment(t, df).collect())
    value = {x[0]: float(i) for i, x in enumerate(p)}
    for r in rows:
        x = p[int(value[r.target_id])]
        assert r.adjustment == pytest.approx((sum(value[y[0]] for y in by_metres(x, first(x, p, 25))[:5]) / 5 - value[x[0]]) * 0.2)
    assert len(rows) == 1500 and most < 100_000  # 2,250,000 pairs


def test_comparables_in_a_crowd_without_pairing_it(spark):
    p = crowd("p", 1500)
    df = spark.createDataFrame([(*x, i % 10) for i, x in enumerate(p)], POINTS + ", kind int")
    t = df.selectExpr("point_id as target_id", "p_lat as t_lat", "p_lon as t_lon", "kind as t_kind")
    rows, most = most_joined(spark, lambda: nearest.comparables(t, df, F.col("t_kind") == F.col("kind"), 5).collect())
    kind, want = {x[0]: i % 10 for i, x in enumerate(p)}, set()
    for x in p:
        near = by_metres(x, first(x, p, 60))
        for same in (True, False):
            want |= {(x[0], same, i + 1, y[0]) for i, y in enumerate([y for y in near if (kind[y[0]] == kind[x[0]]) == same][:5])}
    assert {(r.target_id, r.matching, r["rank"], r.point_id) for r in rows} == want
    assert most < 100_000  # 2,250,000 pairs


def homes(n):
    columns = "location_id string, lat double, lon double, value double, neighbourhood string, neighbourhood_id long, year_built long, gross_area double, lot_size double, tax_class string"
    return [(*x, float(i % 500), f"N{i % 3}", i % 3, 1950 + i % 70, 900.0 + i, 250.0, "RES") for i, x in enumerate(crowd("h", n))], columns


def test_valuation_of_a_crowd_of_points_without_pairing_it(spark):
    known = spark.createDataFrame(*homes(1500))
    asked = spark.createDataFrame(crowd("a", 1000), "request_id string, lat double, lon double")
    amenities = spark.createDataFrame([(("parks", "schools")[i % 2], *x) for i, x in enumerate(crowd("e", 1500))], "kind string, entity_id string, lat double, lon double")
    rows, most = most_joined(spark, lambda: appraisal.appraise(asked, known, amenities).collect())
    assert {r.request_id: (r.baseline_id, r.n_parks, r.n_schools) for r in rows} == {f"a{i}": (f"h{i}", 3, 3) for i in range(1000)}
    assert most < 100_000  # 1,500,000 pairs of each table


def test_valuation_of_a_crowd_of_properties_without_pairing_it(spark):
    pois = spark.createDataFrame([(*x, ("PROMO", "STANDARD")[i % 2]) for i, x in enumerate(crowd("e", 1500))], "entity_id string, lat double, lon double, category string")
    rows, most = most_joined(spark, lambda: valuation.value_all(spark.createDataFrame(*homes(1200)), pois, {"parks": "PROMO", "schools": "STANDARD"}).collect())
    assert len(rows) == 1200 and all(r.estimate is not None for r in rows)
    assert most < 100_000  # 1,440,000 pairs
