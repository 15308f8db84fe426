"""Map viewport queries: clusters, pages, best attributes, suggestions, layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.functions import geo
from parcelforge.functions.text import search_text


def clusters(properties: DataFrame, west: float, south: float, east: float, north: float, bucket: float) -> DataFrame:
    """Points of the box in square buckets; the sample columns come from different rows on purpose (least or greatest of each)."""
    inside = properties.filter(geo.in_box(F.col("lat"), F.col("lon"), west, south, east, north))
    at = lambda c, low: F.floor((F.col(c) - F.lit(low)) / F.lit(bucket)).cast("long")
    return inside.groupBy(at("lon", west).alias("bucket_x"), at("lat", south).alias("bucket_y")).agg(
        F.count("*").alias("point_count"), F.avg("lat").alias("center_lat"), F.avg("lon").alias("center_lng"),
        F.min("lon").alias("min_lng"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lng"), F.max("lat").alias("max_lat"),
        F.min("location_id").alias("sample_id"), F.min("house").alias("sample_house"), F.min("street").alias("sample_street"), F.max("value").alias("sample_value"),
    )


def page(properties: DataFrame, west: float, south: float, east: float, north: float, limit: int, offset: int = 0) -> DataFrame:
    """One page of the box in id order, with one row more that tells whether another page follows."""
    return properties.filter(geo.in_box(F.col("lat"), F.col("lon"), west, south, east, north)).orderBy("location_id").offset(offset).limit(limit + 1)


def best_attributes(properties: DataFrame, attributes: DataFrame) -> DataFrame:
    """Properties with the attributes of greatest confidence; a null confidence never wins and ties stay."""
    top = attributes.filter("confidence is not null").withColumn("_rank", F.rank().over(Window.partitionBy("location_id").orderBy(F.col("confidence").desc()))).filter("_rank = 1")
    chosen = top.select("location_id", F.coalesce("bedrooms", "bedrooms_estimated").alias("bedrooms"), F.coalesce("bathrooms", "bathrooms_estimated").alias("bathrooms"), "confidence")
    return properties.join(chosen, "location_id", "left")


def suggestions(properties: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """(location_id, address, rank, confidence) of the first properties whose house and street contain the query.

    Only what stands before the first comma counts, in upper case, signs as blanks.
    """
    needle = search_text(F.lit(query))
    address = F.upper(F.concat_ws(" ", "house", "street"))
    found = properties.select("location_id", address.alias("address")).filter(F.col("address").contains(needle))
    first = found.orderBy("location_id").limit(limit)
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy("location_id")).cast("long"))  # at most ``limit`` rows
    return ranked.withColumn("confidence", F.when(F.col("rank") == 1, "high").otherwise("medium"))


def layer(points: DataFrame, words: list[str], west: float, south: float, east: float, north: float) -> DataFrame:
    """Points of the box whose category names one of the layer's words."""
    named = F.lit(False)
    for word in words:
        named = named | F.lower("category").contains(word)
    return points.filter(geo.in_box(F.col("lat"), F.col("lon"), west, south, east, north) & named)
