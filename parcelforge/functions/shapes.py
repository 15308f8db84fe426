"""Geometry objects, given as text of any nesting, as Column expressions over VARIANT.

Broken text, objects without type or coordinates, and other values are no geometry (null).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelforge.functions.projection import TransverseMercator

#: Kilometres of a degree north and, at the equator, east, by which areas are reckoned.
KM_NORTH, KM_EAST = 110.574, 111.320
#: How the six types are drawn.
DRAWN = {"Point": "points", "MultiPoint": "points", "LineString": "lines", "MultiLineString": "lines", "Polygon": "polygons", "MultiPolygon": "polygons"}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is reckoned once for a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def geometry(text: Column) -> Column:
    """The object as a variant, if it has a type and coordinates."""
    there = lambda v: F.try_variant_get(v, "$.coordinates", "variant")
    return _let(F.try_parse_json(text), lambda v: F.when((F.length(type_of(v)) > 0) & _let(there(v), lambda c: c.isNotNull() & ~F.is_variant_null(c)), v))


def type_of(shape: Column) -> Column:
    return F.try_variant_get(shape, "$.type", "string")


def drawn_as(shape: Column) -> Column:
    """points, lines or polygons; null for other types."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in DRAWN.items() for x in pair]), type_of(shape))


def positions(shape: Column) -> Column:
    """Array of struct(lat, lon): every array that begins with two numbers, at any depth, in the order of the text."""
    text = F.regexp_replace(F.to_json(F.try_variant_get(shape, "$.coordinates", "variant")), r'"(?:[^"\\]|\\.)*"', '""')
    pairs = F.regexp_extract_all(text, F.lit(r"\[(-?[0-9][-+0-9.eE]*,-?[0-9][-+0-9.eE]*)"), F.lit(1))
    return F.transform(pairs, lambda p: F.struct(F.split(p, ",")[1].cast("double").alias("lat"), F.split(p, ",")[0].cast("double").alias("lon")))


def _mean(points: Column) -> Column:
    mean = lambda ps, f: F.aggregate(ps, F.lit(0.0), lambda s, p: s + p[f]) / F.size(ps)
    return _let(points, lambda ps: F.when(F.size(ps) > 0, F.struct(mean(ps, "lat").alias("lat"), mean(ps, "lon").alias("lon"))))


def centre(shape: Column) -> Column:
    """struct(lat, lon): a point as it is (numbers in quotes too), else the mean of all positions, closing ones counted again."""
    x, y = (F.try_variant_get(shape, f"$.coordinates[{i}]", "double") for i in (0, 1))
    point = F.when(x.isNotNull() & y.isNotNull(), F.struct(y.alias("lat"), x.alias("lon")))
    return F.when(type_of(shape) == "Point", point).otherwise(_mean(positions(shape)))


def ring_centre(shape: Column) -> Column:
    """struct(lat, lon): mean of the first ring's corners, the closing one left out; null unless all of them are numbers."""

    def corners(ring: Column) -> Column:
        closed = (F.size(ring) > 1) & (F.try_element_at(ring, F.lit(1)) == F.try_element_at(ring, F.lit(-1)))
        return F.when(closed, F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))).otherwise(ring)

    def middle(found: Column) -> Column:
        whole = F.forall(found, lambda p: (F.size(p) >= 2) & _lon(p).isNotNull() & _lat(p).isNotNull())
        return F.when(whole, _mean(F.transform(found, lambda p: F.struct(_lat(p).alias("lat"), _lon(p).alias("lon")))))

    return _let(_let(F.try_variant_get(shape, "$.coordinates[0]", "array<array<double>>"), corners), middle)


def _lon(position: Column) -> Column:
    return F.get(position, F.lit(0))


def _lat(position: Column) -> Column:
    return F.get(position, F.lit(1))


def _shoelace(plane: Column) -> Column:
    """Area within a ring of struct(x, y); corners are taken relative to the first, which loses fewer digits."""
    moved = _let(F.get(plane, F.lit(0)), lambda o: F.transform(plane, lambda p: F.struct((p["x"] - o["x"]).alias("x"), (p["y"] - o["y"]).alias("y"))))
    # the leg that closes the ring begins or ends at the first corner, which is (0, 0) here
    legs = lambda m: F.zip_with(m, F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0))), lambda a, b: F.when(b.isNull(), 0.0).otherwise(a["x"] * b["y"] - b["x"] * a["y"]))
    return F.abs(F.aggregate(_let(moved, legs), F.lit(0.0), lambda s, c: s + c)) / 2


def _ring_km2(ring: Column, grid: TransverseMercator | None) -> Column:
    """Area within a ring of [lon, lat]; null where a position isn't two numbers."""
    if grid:
        on_grid = lambda p: F.struct(*[c.alias(k) for k, c in zip("xy", grid.forward(_lat(p), _lon(p)), strict=True)])
        area = _let(F.transform(ring, on_grid), _shoelace) / 1e6
    else:
        middle = F.aggregate(ring, F.lit(0.0), lambda s, p: s + _lat(p)) / F.size(ring)
        area = _let(F.transform(ring, lambda p: F.struct(_lon(p).alias("x"), _lat(p).alias("y"))), _shoelace) * F.lit(KM_EAST * KM_NORTH) * F.cos(F.radians(middle))
    whole = F.forall(ring, lambda p: _lon(p).isNotNull() & _lat(p).isNotNull())
    return F.when(F.size(ring) < 3, 0.0).when(whole, area)


def area_km2(shape: Column, grid: TransverseMercator | None = None) -> Column:
    """Area of a polygon or of several: of each the first ring less the others, never below 0; 0 for other types.

    With ``grid`` on its plane, else by the length of degrees at each ring's mean latitude. Null
    where a position isn't two numbers; rings that are null or empty count nothing.
    """
    get = lambda kind: F.try_variant_get(shape, "$.coordinates", kind)
    polygons = F.when(type_of(shape) == "Polygon", F.array(get("array<array<array<double>>>"))).when(type_of(shape) == "MultiPolygon", get("array<array<array<array<double>>>>"))
    rings = lambda polygon: F.transform(polygon, lambda ring: F.when(ring.isNull(), 0.0).otherwise(_ring_km2(ring, grid)))
    less = lambda areas: F.greatest(F.lit(0.0), 2 * F.get(areas, F.lit(0)) - F.aggregate(areas, F.lit(0.0), lambda s, x: s + x))
    one = lambda polygon: F.when(F.coalesce(F.size(polygon), F.lit(0)) == 0, 0.0).otherwise(_let(rings(polygon), lambda areas: F.when(~F.exists(areas, lambda x: x.isNull()), less(areas))))
    each = F.transform(polygons, one)
    total = lambda areas: F.when(areas.isNull(), 0.0).otherwise(F.aggregate(areas, F.lit(0.0), lambda s, x: s + x))  # noqa: E731  null as soon as one is
    return F.when(shape.isNotNull(), _let(each, total))


def decoded(text: Column, lat: Column, lon: Column) -> Column:
    """Text of the geometry, or of the point (lon, lat) where there is none."""
    point = F.to_json(F.struct(F.array(lon, lat).alias("coordinates"), F.lit("Point").alias("type")))
    return F.coalesce(F.to_json(geometry(text)), point)


def payload(text: Column, dataset: Column, points: Column) -> Column:
    """Text of the geometry that a record carries, else one made of its points (struct(lat, lon)) as its dataset wants it.

    Roads become lines, boundaries a polygon, everything else its first point; without any the point (0, 0).
    """
    pairs = F.transform(F.coalesce(points, F.array().cast("array<struct<lat:double,lon:double>>")), lambda p: F.array(p["lon"], p["lat"]))
    made = lambda kind, xy: F.to_json(F.struct(xy.alias("coordinates"), F.lit(kind).alias("type")))
    first = F.coalesce(F.get(pairs, F.lit(0)), F.array(F.lit(0.0), F.lit(0.0)))
    return F.coalesce(
        F.to_json(geometry(text)), F.when(dataset == "roads", made("MultiLineString", F.array(pairs))).when(dataset == "boundaries", made("Polygon", F.array(pairs))).otherwise(made("Point", first)))
