"""Map features and areas of whole tables of geometries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.functions import shapes
from parcelforge.functions.projection import TransverseMercator


def layer_features(rows: DataFrame) -> DataFrame:
    """(entity_id, feature): a row of entity_id, name, raw_category, source_id, address, geometry_json, lat and lon as the text of a feature.

    Properties that are null stay in it; a row without a readable geometry becomes a point.
    """
    row = lambda c: F.col(c)
    geometry = F.parse_json(shapes.decoded(row("geometry_json"), row("lat"), row("lon")))
    properties = F.struct(row("entity_id").alias("id"), row("name"), row("raw_category").alias("category"), row("source_id"), row("address"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))
    return rows.select("entity_id", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def neighbourhood_areas(boundaries: DataFrame, grid: TransverseMercator | None = None) -> DataFrame:
    """(neighbourhood_number, neighbourhood, area_sq_km) of rows of number, name, geometry_json and ordinal.

    Shapes without an area and numbers that are none are left out; of several rows of a number
    the first name and the first area are taken, by ordinal.
    """
    area = shapes.area_km2(shapes.geometry(F.col("geometry_json")), grid)
    rows = boundaries.select(F.col("number").try_cast("double").alias("neighbourhood_number"), "name", "ordinal", area.alias("area")).filter("neighbourhood_number is not null and area > 0")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal")))
    return rows.groupBy("neighbourhood_number").agg(first("name").alias("neighbourhood"), first("area").alias("area_sq_km"))
