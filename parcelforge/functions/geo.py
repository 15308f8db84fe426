"""Geometry as Column expressions. Distances are metres, angles degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius, kilometres of a degree, the city's box and centre.
EARTH_M = 6_371_000.0
KM_PER_DEGREE = 111.32
CITY_BOX = (-113.7136, 53.3958, -113.2714, 53.7160)
DOWNTOWN = (53.5461, -113.4938)


def haversine(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    half = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    # not least(): that passes over a null, and half the globe's girth would be the distance to nowhere
    return 2 * F.lit(EARTH_M) * F.asin(F.sqrt(F.when(half > 1, 1.0).otherwise(half)))


def two_legs(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """East-west at the first point's latitude, then north-south at the second's longitude; not symmetric."""
    return haversine(lat_a, lon_a, lat_a, lon_b) + haversine(lat_a, lon_b, lat_b, lon_b)


def l1_degrees(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    return F.abs(lat_a - lat_b) + F.abs(lon_a - lon_b)


def squared_degrees(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column, scaled: bool) -> Column:
    dx = (lon_a - lon_b) * (F.cos(F.radians(lat_a)) if scaled else F.lit(1.0))
    return (lat_a - lat_b) * (lat_a - lat_b) + dx * dx


def in_box(lat: Column, lon: Column, west: float, south: float, east: float, north: float) -> Column:
    return lon.between(west, east) & lat.between(south, north)


def repaired_point(lat: Column, lon: Column) -> Column:
    """struct(lat, lon, status): swapped values are put right, impossible ones are refused."""
    fine = lat.between(-90, 90) & lon.between(-180, 180)
    swapped = lon.between(-90, 90) & lat.between(-180, 180)
    return (
        F.when(fine, F.struct(lat.alias("lat"), lon.alias("lon"), F.lit("ok").alias("status")))
        .when(swapped, F.struct(lon.alias("lat"), lat.alias("lon"), F.lit("swapped").alias("status")))
        .otherwise(F.struct(F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit("invalid").alias("status")))
    )


def cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size)).cast("long")


def cell_id(lat: Column, lon: Column, size: float) -> Column:
    return F.concat_ws("_", cell(lon, size).cast("string"), cell(lat, size).cast("string"))


def cell_area_km2(lat_cell: Column, size: float) -> Column:
    """Area of a cell by the length of a degree at its middle latitude."""
    middle = (lat_cell + 0.5) * F.lit(size)
    return F.lit(size * KM_PER_DEGREE) * F.lit(size * KM_PER_DEGREE) * F.greatest(F.cos(F.radians(middle)), F.lit(0.1))


def polyline_length(points: Column) -> Column:
    """Length of an array of struct(lat, lon)."""
    legs = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: haversine(a["lat"], a["lon"], b["lat"], b["lon"]))
    return F.aggregate(legs, F.lit(0.0), lambda s, x: s + x)


def vertex_mean(points: Column) -> Column:
    """struct(lat, lon): mean of the points as they are, a closing point counted again."""
    mean = lambda f: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[f]) / F.size(points)
    return F.when(F.size(points) > 0, F.struct(mean("lat").alias("lat"), mean("lon").alias("lon")))


def ring_area_km2(points: Column) -> Column:
    """Planar area of a ring of struct(lat, lon), by the shoelace rule in kilometres."""
    n = F.size(points)
    middle = F.aggregate(points, F.lit(0.0), lambda s, p: s + p["lat"]) / n
    kx, ky = F.lit(KM_PER_DEGREE) * F.cos(F.radians(middle)), F.lit(KM_PER_DEGREE)
    after = F.concat(F.slice(points, 2, F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, after, lambda a, b: (a["lon"] * b["lat"] - b["lon"] * a["lat"]))
    return F.when(n >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2 * kx * ky).otherwise(0.0)


def to_segment(lat: Column, lon: Column, lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """struct(metres, share): distance to a short segment on a local plane, and where along it the nearest point lies (0 to 1)."""
    k = F.lit(KM_PER_DEGREE * 1000)
    scale = F.cos(F.radians(lat)) * k
    ax, ay = (lon_a - lon) * scale, (lat_a - lat) * k
    bx, by = (lon_b - lon) * scale, (lat_b - lat) * k
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    share = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / length))).otherwise(0.0)
    x, y = ax + share * dx, ay + share * dy
    return F.struct(F.sqrt(x * x + y * y).alias("metres"), share.alias("share"))
