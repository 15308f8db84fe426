"""Stable ids and merge keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelforge.functions.text import first_known, slug


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix- and 16 hex digits of the SHA-1 of the parts, joined by bars; null parts count as empty."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha1(joined.cast("binary")), 1, 16))


def point_text(lat: Column, lon: Column, digits: int) -> Column:
    return F.concat_ws("|", F.round(lat, digits).cast("string"), F.round(lon, digits).cast("string"))


def location_key(suite: Column, house: Column, street: Column, lat: Column, lon: Column, record_id: Column) -> Column:
    """struct(kind, value): by address, else by place, else by record."""
    address = F.concat_ws("|", *[x for x in (slug(suite), slug(house), slug(street))])
    has_address = slug(house).isNotNull() & slug(street).isNotNull()
    has_point = lat.isNotNull() & lon.isNotNull()
    return (
        F.when(has_address, F.struct(F.lit("address").alias("kind"), address.alias("value")))
        .when(has_point, F.struct(F.lit("spatial").alias("kind"), point_text(lat, lon, 5).alias("value")))
        .otherwise(F.struct(F.lit("record").alias("kind"), record_id.cast("string").alias("value")))
    )


def poi_key(address: Column, name: Column, lat: Column, lon: Column, entity_id: Column) -> Column:
    """struct(kind, first, second): address and name, name and place, place, or the source's own id."""
    near, exact = point_text(lat, lon, 4), point_text(lat, lon, 5)
    has_point = lat.isNotNull() & lon.isNotNull()

    def key(kind: str, first: Column, second: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), first.alias("first"), second.alias("second"))

    return (
        F.when(slug(address).isNotNull() & slug(name).isNotNull(), key("address_name", slug(address), slug(name)))
        .when(slug(name).isNotNull() & has_point, key("name_spatial", slug(name), near))
        .when(has_point, key("spatial", exact, F.lit("")))
        .otherwise(key("source", entity_id.cast("string"), F.lit("")))
    )


def entity_id(given: Column, category: Column, name: Column, address: Column, lat: Column, lon: Column) -> Column:
    return first_known(given, stable_id("src", slug(category), slug(name), slug(address), point_text(lat, lon, 6)))
