"""Uploaded files: are they of a kind and with fields that a dataset can be read from, and their rows.

Field names are compared by their letters and digits only. Fields are those of a CSV header, or of
the first object of a JSON file (a list, an object, or the properties of a feature collection, whose
point stands for lat and lon). Archives are opened by the shapefile reader.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.functions import shapes
from parcelforge.sources import readers
from parcelforge.sources.shapefile import read_shapefiles

# Endings that are taken, and of each dataset the groups of names of which one must be there.
ENDINGS = ("csv", "json", "geojson", "zip")
_PLACE = [("lat", "latitude"), ("lon", "lng", "longitude")]
REQUIRED = {
    "assessment_properties": [("assessmentvalue", "assessedvalue"), *_PLACE],
    "schools": [("name", "schoolname", "schoolnam"), *_PLACE],
    "parks": [("name", "officialname", "officialn"), *_PLACE],
    "playgrounds": [("name",), *_PLACE],
    "transit_stops": [("stopid", "entityid"), ("name", "stopname"), ("lat", "latitude", "stoplat"), ("lon", "lng", "longitude", "stoplon")],
}
ISSUES = "dataset string, path string, issue string, detail string"


def plain(name: str) -> str:
    return "".join(ch for ch in name.lower() if ch.isalnum())


def ending(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def fields(spark: SparkSession, path: str) -> set[str]:
    """Plain names of the file's fields; none for an empty file. Broken JSON is an error."""
    kind = ending(path)
    if kind == "csv":
        return {plain(c) for c in readers.read_csv_source(spark, path).columns} - {""}
    if kind == "zip":
        rows = read_shapefiles(spark, path).select(F.map_keys("properties").alias("names"), (F.size("points") > 0).alias("placed")).take(1)
        return {plain(n) for r in rows for n in r.names} | ({"lat", "lon"} if rows and rows[0].placed else set()) - {""}
    text = spark.read.text(path, wholetext=True).filter(F.trim("value") != "").select(F.try_parse_json("value").alias("v"))
    feature = F.try_variant_get("v", "$.features[0]", "variant")
    point = F.size(F.try_variant_get(feature, "$.geometry.coordinates", "array<double>")) >= 2
    numbers = F.try_variant_get(feature, "$.geometry.coordinates[0]", "double").isNotNull() & F.try_variant_get(feature, "$.geometry.coordinates[1]", "double").isNotNull()
    first = F.coalesce(F.try_variant_get(feature, "$.properties", "variant"), feature, F.try_variant_get("v", "$[0]", "variant"), F.col("v"))
    found = text.select(F.col("v").isNull().alias("broken"), F.json_object_keys(F.to_json(first)).alias("names"), (point & numbers).alias("placed")).first()
    if found is None:
        return set()
    if found.broken:
        raise ValueError("no JSON")
    return {plain(n) for n in found.names or []} - {""} | ({"lat", "lon"} if found.placed else set())


def issues(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Rows of ISSUES, none for a file that can be read: unknown_dataset, wrong_ending, unreadable, no_fields, missing_field."""
    dataset, kind = dataset.strip().lower(), ending(path)
    found: list[tuple[str, str]] = []
    if dataset not in REQUIRED:
        found.append(("unknown_dataset", ", ".join(sorted(REQUIRED))))
    elif kind not in ENDINGS:
        found.append(("wrong_ending", f".{kind or 'unknown'}"))
    else:
        try:
            there = fields(spark, path)
            if not there:
                found.append(("no_fields", ""))
            else:
                found += [("missing_field", "/".join(sorted(group))) for group in REQUIRED[dataset] if not there & set(group)]
        except (PySparkException, ValueError) as error:
            found.append(("unreadable", str(error).partition("\n")[0]))
    return spark.createDataFrame([(dataset, path, *f) for f in found], ISSUES)


def rows(spark: SparkSession, path: str) -> DataFrame:
    """The file's records as texts under their own names, with lat and lon where they have a point."""
    kind = ending(path)
    if kind == "csv":
        return readers.read_csv_source(spark, path)
    if kind == "zip":
        found = read_shapefiles(spark, path).select(F.col("properties").alias("p"), F.get("points", F.lit(0)).alias("at"))
    else:
        text = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
        many = F.coalesce(F.try_variant_get("v", "$.features", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
        each = text.select(F.explode(many).alias("r"))
        values = F.from_json(F.to_json(F.coalesce(F.try_variant_get("r", "$.properties", "variant"), F.col("r"))), "map<string,string>")
        shape = F.try_variant_get("r", "$.geometry", "variant")
        found = each.select(values.alias("p"), F.get(shapes.positions(shape), F.lit(0)).alias("at"))
    names = sorted(r[0] for r in found.select(F.explode(F.map_keys("p"))).distinct().collect())  # names of fields, not rows
    placed = {c: F.coalesce(F.col("p")[c], F.col(f"at.{c}").cast("string")) for c in ("lat", "lon")}
    return found.select(*[F.col("p")[n].alias(n) for n in names if n not in placed], *[v.alias(c) for c, v in placed.items()])


def ingest(spark: SparkSession, path: str, dataset: str, write, validate_only: bool = False) -> tuple[str, DataFrame, int]:
    """(status, issues, rows): ``refused`` with its issues, ``valid`` or ``ingested``; ``write`` gets the rows.

    Validation alone reads every record and writes nothing.
    """
    found = issues(spark, path, dataset)
    if not found.isEmpty():
        return "refused", found, 0
    records = rows(spark, path)
    n = records.count()
    if not validate_only:
        write(records)
    return ("valid" if validate_only else "ingested"), found, n
