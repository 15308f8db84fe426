"""Validators that return issue rows: coordinates, addresses, property details, polygons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelforge.functions.text import tidy

ISSUE = "array<struct<field:string,reason:string>>"


def _issue(when: Column, field: str, reason: str) -> Column:
    return F.when(when, F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason")))


def _found(*issues: Column) -> Column:
    return F.array_compact(F.array(*issues)).cast(ISSUE)


def coordinate_issues(lat: Column, lon: Column) -> Column:
    """Texts of a latitude and a longitude."""
    a, o = lat.try_cast("double"), lon.try_cast("double")
    return _found(
        _issue(lat.isNull(), "lat", "missing"), _issue(lat.isNotNull() & a.isNull(), "lat", "not_numeric"), _issue(~a.between(-90, 90), "lat", "out_of_range"),
        _issue(lon.isNull(), "lon", "missing"), _issue(lon.isNotNull() & o.isNull(), "lon", "not_numeric"), _issue(~o.between(-180, 180), "lon", "out_of_range"))


def address_issues(address: Column) -> Column:
    text = tidy(address)
    return _found(_issue(text.isNull(), "address", "missing"), _issue(F.char_length(text) < 5, "address", "too_short"), _issue(~text.rlike("[0-9]"), "address", "no_house_number"))


def detail_issues(details: dict[str, Column]) -> Column:
    """Every given detail must be a number and not below zero."""
    every = []
    for name, value in details.items():
        number = value.try_cast("double")
        every += [_issue(value.isNotNull() & number.isNull(), name, "not_numeric"), _issue(number < 0, name, "out_of_range")]
    return _found(*every)


def _turn(a: Column, b: Column, c: Column) -> Column:
    return (b["lon"] - a["lon"]) * (c["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (c["lon"] - a["lon"])


def _cross(p: Column, q: Column) -> Column:
    """Two legs cut each other in their inside."""
    return (_turn(p["a"], p["b"], q["a"]) * _turn(p["a"], p["b"], q["b"]) < 0) & (_turn(q["a"], q["b"], p["a"]) * _turn(q["a"], q["b"], p["b"]) < 0)


def polygon_issues(kind: Column, ring: Column) -> Column:
    """Issues of an outer ring, an array of struct(lat, lon): type, size, range, closure, self-intersection."""
    n = F.size(ring)
    outside = F.exists(ring, lambda p: ~(p["lat"].between(-90, 90) & p["lon"].between(-180, 180)) | p["lat"].isNull() | p["lon"].isNull())
    closed = (F.try_element_at(ring, F.lit(1))["lat"] == F.try_element_at(ring, F.lit(-1))["lat"]) & (F.try_element_at(ring, F.lit(1))["lon"] == F.try_element_at(ring, F.lit(-1))["lon"])
    legs = F.zip_with(F.slice(ring, 1, F.greatest(n - 1, F.lit(0))), F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    numbered = F.transform(legs, lambda leg, i: F.struct(leg["a"].alias("a"), leg["b"].alias("b"), i.alias("i")))
    beside = lambda p, q: (F.abs(p["i"] - q["i"]) <= 1) | ((p["i"] == 0) & (q["i"] == F.size(legs) - 1))
    cut = F.exists(numbered, lambda p: F.exists(numbered, lambda q: (p["i"] < q["i"]) & ~beside(p, q) & _cross(p, q)))
    wrong_type = F.coalesce(F.lower(kind) != "polygon", F.lit(True))
    small = F.coalesce(n < 4, F.lit(True))
    return F.coalesce(
        F.when(wrong_type, _found(_issue(F.lit(True), "type", "invalid_format"))), F.when(small, _found(_issue(F.lit(True), "coordinates", "too_few_points"))),
        F.when(outside, _found(_issue(F.lit(True), "coordinates", "out_of_range"))), F.when(~closed, _found(_issue(F.lit(True), "coordinates", "not_closed"))),
        F.when(cut, _found(_issue(F.lit(True), "coordinates", "self_intersection"))), F.array().cast(ISSUE))
