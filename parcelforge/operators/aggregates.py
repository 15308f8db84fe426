"""Aggregates over neighbourhoods, cells, crimes and census rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions import geo

#: A mean outside of these is clamped and flagged.
LEAST_MEAN, MOST_MEAN = 10_000.0, 10_000_000.0


def clamp(mean: Column) -> Column:
    return F.greatest(F.lit(LEAST_MEAN), F.least(mean, F.lit(MOST_MEAN)))


def is_outlier(mean: Column) -> Column:
    return (mean < LEAST_MEAN) | (mean > MOST_MEAN)


def neighbourhood_context(properties: DataFrame) -> DataFrame:
    return properties.filter("neighbourhood is not null and value is not null").groupBy("neighbourhood").agg(
        F.avg("value").alias("average_value"), F.count("*").alias("property_count"), F.avg("lat").alias("center_lat"), F.avg("lon").alias("center_lon"))


def neighbourhood_model(properties: DataFrame) -> DataFrame:
    """Mean (clamped), exact median, size and centre of every named neighbourhood."""
    rows = properties.filter("trim(neighbourhood) <> '' and value is not null and lat is not null and lon is not null")
    found = rows.groupBy(F.trim("neighbourhood").alias("neighbourhood")).agg(
        F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median_value"), F.count("*").alias("property_count"),
        F.avg("lat").alias("centroid_lat"), F.avg("lon").alias("centroid_lon"))
    return found.select("neighbourhood", clamp(F.col("mean")).alias("average_value"), "median_value", "property_count", "centroid_lat", "centroid_lon", is_outlier(F.col("mean")).alias("flagged"))


def steady(mean: Column) -> Column:
    """Four digits; nine first, so that the order of a sum doesn't decide which way a half goes."""
    return F.round(F.round(mean, 9), 4)


def crime_rollup(crimes: DataFrame) -> DataFrame:
    return crimes.groupBy("neighbourhood").agg(
        steady(F.avg(F.coalesce("rate", F.lit(0.0)))).alias("rate_index"), steady(F.avg(F.coalesce("incidents", F.lit(0.0)).cast("double"))).alias("severity_index"))


def crime_by_type(crimes: DataFrame) -> DataFrame:
    return crimes.groupBy("neighbourhood", "crime_type").agg(F.count("*").alias("incidents"))


def within_radius(points: DataFrame, lat: float, lon: float, radius: float) -> DataFrame:
    """Points within metres of a place; the box test comes first and prunes row groups."""
    from math import cos, radians

    dy = radius / 111_000.0
    dx = dy / max(cos(radians(lat)), 0.1)
    box = geo.in_box(F.col("lat"), F.col("lon"), lon - dx, lat - dy, lon + dx, lat + dy)
    return points.filter(box).withColumn("distance", geo.haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).filter(F.col("distance") <= radius)


def grid_features(properties: DataFrame, points: DataFrame, crimes: DataFrame, size: float, digits: int = 4) -> DataFrame:
    """One row for each cell with a property: values, densities, crime (rounded to ``digits``) and the median distance to schools of the same cell."""
    rows = properties.filter("lat is not null and lon is not null and value is not null").withColumns({"gx": geo.cell(F.col("lon"), size), "gy": geo.cell(F.col("lat"), size)})
    there = points.filter("lat is not null and lon is not null").withColumns({"gx": geo.cell(F.col("lon"), size), "gy": geo.cell(F.col("lat"), size), "kind": F.lower("category")})
    index = crime_rollup(crimes).withColumn("neighbourhood_key", F.lower(F.trim("neighbourhood"))).drop("neighbourhood")
    rows = rows.withColumn("neighbourhood_key", F.lower(F.trim("neighbourhood"))).join(index, "neighbourhood_key", "left")
    walk = F.sqrt(F.pow(F.col("lat") - geo.DOWNTOWN[0], 2) + F.pow(F.col("lon") - geo.DOWNTOWN[1], 2))
    cells = rows.groupBy("gx", "gy").agg(
        F.count("*").alias("property_count"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median_value"),
        F.round(F.greatest(F.lit(0.0), 1 - F.avg(walk) * 5), 4).alias("walkability"),
        F.round(F.coalesce(F.avg("rate_index"), F.lit(0.0)), digits).alias("crime_rate_index"), F.round(F.coalesce(F.avg("severity_index"), F.lit(0.0)), digits).alias("crime_severity_index"))
    counts = there.groupBy("gx", "gy").agg(F.count_if(F.col("kind").contains("store")).alias("stores"), F.count_if(F.col("kind").isin("park", "dog_park", "green_space")).alias("parks"))
    stores = there.filter(F.col("kind").contains("store")).groupBy("gx", "gy", "kind").agg(F.count("*").alias("n"))
    types = stores.groupBy("gx", "gy").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", F.col("n").cast("string")))), ",").alias("store_types"))
    schools = there.filter("kind = 'school'").select("gx", "gy", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    to_school = rows.join(schools, ["gx", "gy"]).groupBy("gx", "gy", "location_id").agg(F.min(geo.haversine(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon"))).alias("d"))
    school = to_school.groupBy("gx", "gy").agg(F.round(F.percentile("d", F.lit(0.5)), 2).alias("school_distance"))
    area = F.greatest(geo.cell_area_km2(F.col("gy"), size), F.lit(0.01))
    out = cells.join(counts, ["gx", "gy"], "left").join(types, ["gx", "gy"], "left").join(school, ["gx", "gy"], "left")
    density = lambda c: F.round(F.coalesce(c, F.lit(0)) / area, 4)
    return out.select(
        F.concat_ws("_", F.col("gx").cast("string"), F.col("gy").cast("string")).alias("grid_id"), "property_count", clamp(F.col("mean")).alias("mean_value"), "median_value",
        density(F.col("stores")).alias("store_density"), F.coalesce("store_types", F.lit("")).alias("store_types"), "walkability", density(F.col("parks")).alias("park_density"),
        "crime_rate_index", "crime_severity_index", "school_distance", is_outlier(F.col("mean")).alias("flagged"))


def common_value(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent text of each key, ties to the greatest."""
    return rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n")).groupBy(key).agg(F.max_by(value, F.struct("n", value)).alias(value))


def value_summary(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, median and all modes of each key."""
    rows = rows.filter(F.col(value).isNotNull())
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    most = counts.groupBy(key).agg(F.max("n").alias("n"))
    modes = counts.join(most, [key, "n"]).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.round(value, 2))), lambda x: x.cast("decimal(18,2)").cast("string")), ",").alias("modes"))
    return rows.groupBy(key).agg(F.round(F.avg(value), 2).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median_value")).join(modes, key)


def city_baselines(census: DataFrame) -> DataFrame:
    return census.agg(F.avg(F.try_divide("population", F.nullif("households", F.lit(0)))).alias("household_size"), F.avg(F.try_divide("population", F.nullif("area_km2", F.lit(0.0)))).alias("density"))


def latest(versions: DataFrame, key: str, at: str, id_: str) -> DataFrame:
    return versions.groupBy(key).agg(F.max_by(id_, F.struct(at, id_)).alias(id_), F.max(at).alias(at))
