"""Transit: routes, their stops in order, points of interest by several filters, neighbourhood summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.functions import geo
from parcelforge.operators.aggregates import within_radius


def routes(trips: DataFrame) -> DataFrame:
    return trips.groupBy("route_id").agg(F.count("*").alias("trips")).orderBy("route_id")


def route_stops(trips: DataFrame, stops: DataFrame, reach: float = 60.0, size: float = 0.002) -> DataFrame:
    """(route_id, position, stop_id): stops within metres of a trip's points, in the order in which the trip passes them.

    trips: (route_id, points array<struct<lat, lon>>); stops: (stop_id, lat, lon).
    """
    p = trips.select("route_id", F.posexplode("points").alias("at", "p")).select("route_id", "at", F.col("p.lat").alias("p_lat"), F.col("p.lon").alias("p_lon"))
    p = p.withColumns({"cx": geo.cell(F.col("p_lon"), size), "cy": geo.cell(F.col("p_lat"), size)})
    s = stops.withColumns({"cx": geo.cell(F.col("lon"), size), "cy": geo.cell(F.col("lat"), size)})
    s = s.withColumn("cx", F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1))).withColumn("cy", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)))
    met = p.join(s, ["cx", "cy"]).withColumn("metres", geo.haversine(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))).filter(F.col("metres") <= reach)
    near = met.groupBy("route_id", "stop_id").agg(F.min(F.struct("metres", "at")).alias("m"))
    return near.select("route_id", F.col("m.at").cast("long").alias("position"), "stop_id")


def find_pois(pois: DataFrame, source: str | None = None, category: str | None = None, subcategory: str | None = None, centre: tuple[float, float] | None = None, radius: float | None = None) -> DataFrame:
    for column, value in (("source_id", source), ("category", category), ("subcategory", subcategory)):
        if value is not None:
            pois = pois.filter(F.lower(F.col(column)) == value.lower())
    return within_radius(pois, *centre, radius) if centre and radius else pois


def neighbourhood_summary(properties: DataFrame, this_year: int) -> DataFrame:
    """Mean age, mean area and share of garages of each neighbourhood; null where nothing is known."""
    return properties.groupBy("neighbourhood").agg(
        F.round(F.avg(this_year - F.col("year_built")), 4).alias("mean_age"), F.round(F.avg("gross_area"), 4).alias("mean_area"),
        F.round(100 * F.avg(F.when(F.col("garage").isNotNull(), (F.col("garage") == "Y").cast("int"))), 4).alias("garage_percent"))
