"""Readers of open-data files. All give text columns as they stand in the file; coercion is a later, visible step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelforge.functions import geo

GEOJSON = "type string, features array<struct<properties:map<string,string>, geometry:struct<type:string, coordinates:string>>>"
ARCGIS = "features array<struct<attributes:map<string,string>, geometry:struct<x:double, y:double>>>"
POINTS = "array<struct<lat:double,lon:double>>"


def read_json_source(spark: SparkSession, path: str, record_schema: str) -> DataFrame:
    """Records of a file {metadata, records[]}, each with its number in the file."""
    schema = f"metadata map<string,string>, records array<struct<{record_schema}>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select("metadata", F.posexplode("records").alias("ordinal", "r")).select("r.*", F.col("ordinal").cast("long").alias("ordinal"), "metadata")


def read_csv_source(spark: SparkSession, path: str, wkt_column: str | None = None) -> DataFrame:
    """All columns as text, header names without a byte-order mark; with ``wkt_column`` also points, lat and lon of its geometry."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    if wkt_column:
        points = wkt_points(F.col(f"`{wkt_column}`"))
        df = df.withColumn("points", points)
        first = lambda field, name: F.coalesce(F.col(name).try_cast("double"), F.try_element_at("points", F.lit(1))[field]) if name in df.columns else F.try_element_at("points", F.lit(1))[field]
        df = df.withColumns({"lat": first("lat", "lat"), "lon": first("lon", "lon")})
    return df


def wkt_points(wkt: Column) -> Column:
    """All coordinate pairs of a WKT geometry in their order, as points; null for other text."""
    known = wkt.rlike(r"(?i)^\s*(POINT|LINESTRING|MULTILINESTRING|POLYGON|MULTIPOLYGON)\s*Z?\s*\(")
    pairs = F.regexp_extract_all(wkt, F.lit(r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?\s+-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"), F.lit(1))
    points = F.transform(pairs, lambda p: F.struct(F.split(p, r"\s+")[1].try_cast("double").alias("lat"), F.split(p, r"\s+")[0].try_cast("double").alias("lon")))
    return F.when(known, F.filter(points, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull()))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(properties map, geometry_type, points): points, lines and multi-lines give points, other geometries none."""
    rows = spark.read.schema("features array<struct<properties:map<string,string>, geometry:struct<type:string, coordinates:variant>>>").option("multiLine", True).json(path)
    f = rows.select(F.explode("features").alias("f")).select("f.properties", F.col("f.geometry.type").alias("geometry_type"), F.to_json(F.col("f.geometry.coordinates")).alias("xy"))
    point = F.array(F.from_json("xy", "array<double>"))
    line = F.from_json("xy", "array<array<double>>")
    lines = F.flatten(F.from_json("xy", "array<array<array<double>>>"))
    pairs = F.when(F.col("geometry_type") == "Point", point).when(F.col("geometry_type") == "LineString", line).when(F.col("geometry_type") == "MultiLineString", lines)
    whole = F.filter(pairs, lambda p: F.size(p) >= 2)
    return f.select("properties", "geometry_type", F.transform(whole, lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon"))).cast(POINTS).alias("points"))


def read_arcgis(spark: SparkSession, path: str) -> DataFrame:
    """(attributes map, lat, lon) of an ArcGIS feature file."""
    rows = spark.read.schema(ARCGIS).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return rows.select("f.attributes", F.col("f.geometry.y").alias("lat"), F.col("f.geometry.x").alias("lon"))


def find_column(columns: list[str], wanted: str) -> str | None:
    """The column that a loose name means: the name itself, else the same letters and digits, else one that begins the other."""
    plain = lambda s: "".join(ch for ch in s.lower() if ch.isalnum())
    if wanted in columns:
        return wanted
    equal = [c for c in columns if plain(c) == plain(wanted)]
    close = [c for c in columns if plain(c) and (plain(c).startswith(plain(wanted)) or plain(wanted).startswith(plain(c)))]
    return (equal or close or [None])[0]


def apply_field_map(df: DataFrame, field_map: dict[str, str]) -> DataFrame:
    """target: source column by loose name, or ``=text`` for a constant; a null never replaces a value that is there."""
    out = {}
    for target, source in field_map.items():
        if source.startswith("="):
            value = F.lit(source[1:])
        else:
            name = find_column(df.columns, source)
            value = F.col(f"`{name}`") if name else F.lit(None).cast("string")
        out[target] = F.coalesce(value, F.col(f"`{target}`")) if target in df.columns else value
    return df.withColumns(out)


def passes(df: DataFrame, equal: dict[str, str] | None = None, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Rows whose columns have the given texts and whose point, if they have one, lies in the box."""
    for name, value in (equal or {}).items():
        df = df.filter(F.col(f"`{name}`").cast("string") == str(value))
    if bbox:
        df = df.filter(F.coalesce(geo.in_box(F.col("lat").try_cast("double"), F.col("lon").try_cast("double"), *bbox), F.lit(True)))
    return df


def pick(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """One column for each target: the first alias column of a row that isn't blank."""
    def first(names: list[str]) -> Column:
        there = [c for c in df.columns if c in names]
        return F.coalesce(*[F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", F.col(f"`{c}`").cast("string")) for c in sorted(there, key=names.index)]) if there else F.lit(None).cast("string")

    return df.select(*[first(names).alias(target) for target, names in aliases.items()])


def city_rows(df: DataFrame, place: str, statistics: list[str]) -> DataFrame:
    return df.filter(F.col("GEO").contains(place) & F.col("Statistics").isin(statistics))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, title, links): title and distinct link targets in order of first occurrence."""
    links = F.array_distinct(F.regexp_extract_all("html", F.lit(r"""<a\s[^>]*?href=["']([^"']+)["']"""), F.lit(1)))
    title = F.nullif(F.trim(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)), F.lit(""))
    return pages.select("page_id", title.alias("title"), links.alias("links"))


def listing_details(pages: DataFrame) -> DataFrame:
    """(page_id, bedrooms, bathrooms, price) from JSON-LD where a page has it, else from its plain text."""
    data = F.from_json(F.regexp_extract("html", r"""(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>""", 1), "numberOfBedrooms string, numberOfBathroomsTotal string, offers struct<price:string>")
    plain = F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</\1>|<[^>]+>", " ")
    return pages.select(
        "page_id", F.coalesce(data["numberOfBedrooms"].try_cast("int"), F.regexp_extract(plain, r"(?i)(\d+)\s*bed", 1).try_cast("int")).alias("bedrooms"),
        F.coalesce(data["numberOfBathroomsTotal"].try_cast("double"), F.regexp_extract(plain, r"(?i)(\d+(?:\.\d+)?)\s*bath", 1).try_cast("double")).alias("bathrooms"),
        F.coalesce(data["offers"]["price"].try_cast("double"), F.regexp_replace(F.regexp_extract(plain, r"\$\s*([0-9][0-9,]+)", 1), ",", "").try_cast("double")).alias("price"))


READERS = {".csv": "csv", ".json": "json", ".geojson": "geojson", ".zip": "shapefile", ".shp": "shapefile"}


def technique(path: str) -> str:
    """How a file is read, by its ending; .ivt tables are refused."""
    low = path.lower()
    if low.endswith(".ivt"):
        raise ValueError("IVT tables can't be read; export them as CSV")
    for end, kind in READERS.items():
        if low.endswith(end):
            return kind
    raise ValueError(f"no reader for {path}")


def newest_matching(spark: SparkSession, folder: str, fragments: list[str]) -> str | None:
    """The newest file below a folder whose path has all fragments."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "modificationTime")
    for part in fragments:
        files = files.filter(F.lower("path").contains(part.lower()))
    return files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]


def list_sources(spark: SparkSession, registry: dict[str, dict], pipeline: str | None = None, enabled_only: bool = True) -> DataFrame:
    """The registry as a table, sorted by key."""
    rows = [(k, v.get("pipeline"), v.get("ingestion_technique"), v.get("local_path"), bool(v.get("enabled", True))) for k, v in registry.items()]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("key", "pipeline", "technique", "path")] + [T.StructField("enabled", T.BooleanType())])
    df = spark.createDataFrame(rows, schema)
    if pipeline:
        df = df.filter(F.col("pipeline") == pipeline)
    return (df.filter("enabled") if enabled_only else df).orderBy("key")
