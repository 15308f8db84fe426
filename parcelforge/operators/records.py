"""Small rules over whole tables of records: names, keys, folds of lists, mappings, samples, indicators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.functions.text import display, tidy
from parcelforge.operators.nearest import knn

# The fields that may name a feature, in order.
NAME_FIELDS = ["name", "road_name", "official_n", "common_nam", "branch", "school_nam", "stop_name", "business_n", "code_descr"]
# Road attributes and the fields that may hold them, in order.
ROAD_FIELDS = {
    "municipal_segment_id": ["municipal_segment_id", "centerline"], "official_road_name": ["official_road_name", "street_nam", "road_name", "name"],
    "roadway_category": ["roadway_category", "centerli_2"], "surface_type": ["surface_type", "road_segme"], "jurisdiction": ["jurisdiction", "responsibl"],
    "functional_class": ["functional_class", "functional"], "travel_direction": ["travel_direction", "digitizing"], "quadrant": ["quadrant"],
    "from_intersection_id": ["from_intersection_id", "from_inter"], "to_intersection_id": ["to_intersection_id", "to_interse"],
}
# Words of names that aren't residential neighbourhoods.
NOT_RESIDENTIAL = ["industrial", "energy park", "transportation", "corridor", "northlands", "rampart", "mistatim", "big lake"]
# Cluster width in degrees up to each zoom; the last holds beyond.
CLUSTER_WIDTHS = [(11, 0.03), (12, 0.024), (13, 0.018), (14, 0.012), (15, 0.008), (16, 0.005), (None, 0.003)]


def _there(df: DataFrame, field: str) -> Column:
    return F.col(field).cast("string") if field in df.columns else F.lit(None).cast("string")


def _first_filled(df: DataFrame, fields: list[str]) -> Column:
    """The first field that isn't empty; blanks count as filled here and become null when tidied."""
    return tidy(F.coalesce(*[F.nullif(_there(df, f), F.lit("")) for f in fields]))


def feature_name(df: DataFrame, fallback: Column) -> Column:
    """First name that isn't blank, else "Category at address", else the category, else ``fallback``."""
    category = display(F.coalesce(*[F.nullif(_there(df, f), F.lit("")) for f in ("raw_category", "fclass")]))
    address = _first_filled(df, ["address", "sch_addres", "business_a"])
    return F.coalesce(*[tidy(_there(df, f)) for f in NAME_FIELDS], F.concat(category, F.lit(" at "), address), category, fallback)


def road_attributes(df: DataFrame) -> list[Column]:
    return [_first_filled(df, fields).alias(name) for name, fields in ROAD_FIELDS.items()]


def source_ids(records: DataFrame) -> DataFrame:
    """The second and later records of an id, in arrival order, get their source behind it, and from its second such on also their number."""
    ranked = records.withColumn("nth_", F.row_number().over(Window.partitionBy("record_id").orderBy("ordinal")))
    again = F.row_number().over(Window.partitionBy("record_id", "source_id", F.col("nth_") > 1).orderBy("ordinal"))
    number = F.when(again > 1, again.cast("string"))
    return ranked.withColumn("unique_id", F.when(F.col("nth_") == 1, F.col("record_id")).otherwise(F.concat_ws("__", "record_id", "source_id", number))).drop("nth_")


def training_rows(rows: DataFrame, least: float, kinds: tuple[str, ...] = ("observed", "inferred")) -> DataFrame:
    """Rows to learn rooms from: an allowed source type, not quarantined, sure enough, with one of the two labels."""
    quarantined = F.coalesce(F.col("quarantined"), F.lit(False)) if "quarantined" in rows.columns else F.lit(False)
    labelled = F.col("bedrooms").isNotNull() | F.col("bathrooms").isNotNull()
    return rows.filter(F.col("source_type").isin(*kinds) & ~quarantined & (F.coalesce("confidence", F.lit(0.0)) >= least) & labelled)


def with_required(rows: DataFrame, fields: list[str]) -> DataFrame:
    """All rows if every field is there, else none; a null value counts as there."""
    return rows if set(fields) <= set(rows.columns) else rows.limit(0)


def map_areas(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows with the area of their source area; null where the mapping has none. ``mapping`` has a row for each source area."""
    return rows.join(mapping.select("source_area_id", F.nullif("area_id", F.lit("")).alias("area_id")), "source_area_id", "left")


def realtor_key(address: Column) -> Column:
    """Upper case without city, province and signs other than #."""
    upper = F.regexp_replace(F.upper(F.trim(F.regexp_replace(address, r"\s+", " "))), r"\b(?:EDMONTON|ALBERTA)\b", "")
    return F.trim(F.regexp_replace(F.regexp_replace(upper, "[^A-Z0-9# ]+", " "), r"\s+", " "))


def is_residential(name: Column) -> Column:
    return ~reduce(Column.__or__, [F.lower(name).contains(w) for w in NOT_RESIDENTIAL])


def full_address(house: Column, street: Column) -> Column:
    """"house street, Edmonton, AB"; without a house the street as it is, without a street nothing."""
    h, s = F.trim(F.coalesce(house, F.lit(""))), F.trim(F.coalesce(street, F.lit("")))
    return F.when((h != "") & (s != ""), F.concat(h, F.lit(" "), s, F.lit(", Edmonton, AB"))).otherwise(F.coalesce(street, F.lit("")))


def viewport_key(west: Column, south: Column, east: Column, north: Column, zoom: Column, limit: Column, cursor: Column) -> Column:
    places = [F.format_string("%.4f", c) for c in (west, south, east, north)]
    return F.concat_ws("|", F.lit("properties"), *places, F.format_string("%.2f", zoom), limit.cast("string"), F.coalesce(cursor, F.lit("")))


def estimate_key(lat: Column, lon: Column, location_id: Column, address: Column, version: Column) -> Column:
    """Digest of what an estimate depends on, as one JSON text with sorted keys and no details."""
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    text = F.concat(
        F.lit('{"address": '), quoted(F.upper(F.trim(F.coalesce(address, F.lit(""))))), F.lit(', "canonical_location_id": '), quoted(F.nullif(location_id, F.lit(""))),
        F.lit(', "coords": {"lat": '), F.round(lat, 6).cast("string"), F.lit(', "lng": '), F.round(lon, 6).cast("string"), F.lit('}, "dataset_version": '), quoted(version), F.lit(', "property_details": {}}'))
    return F.concat(F.lit("estimate:"), F.sha2(text, 256))


def truncated_clusters(properties: DataFrame, zoom: float) -> DataFrame:
    """Clusters whose cells are counted toward zero, with the first three properties of each, by id."""
    width = F.lit(next(w for z, w in CLUSTER_WIDTHS if z is None or zoom <= z))
    cells = {"bucket_x": (F.col("lon") / width).cast("long"), "bucket_y": (F.col("lat") / width).cast("long")}
    rows = properties.filter("lat is not null and lon is not null").withColumns(cells)
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("bucket_x", "bucket_y").orderBy("location_id"))).filter("n <= 3")
    samples = first.groupBy("bucket_x", "bucket_y").agg(F.array_join(F.array_sort(F.collect_list("location_id")), ",").alias("samples"))  # three a cluster
    sums = rows.groupBy("bucket_x", "bucket_y").agg(
        F.count("*").alias("count"), F.avg("lat").alias("center_lat"), F.avg("lon").alias("center_lng"), F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))
    return sums.join(samples, ["bucket_x", "bucket_y"])


def top_adjustments(items: Column, positive: bool, most: int = 3) -> Column:
    """Of struct(value, code), the greatest by absolute value, then code, both falling, of one sign."""
    order = F.transform(items, lambda x: F.struct(F.abs(x["value"]).alias("size"), x["code"].alias("code"), x["value"].alias("value")))
    falling = F.sort_array(order, asc=False)
    return F.slice(F.filter(falling, lambda x: (x["value"] > 0) if positive else (x["value"] < 0)), 1, most)


def usual_id(rows: DataFrame) -> DataFrame:
    """(neighbourhood, neighbourhood_id): the most frequent id of each name in any case; of equally frequent ones the least."""
    counted = rows.filter("neighbourhood_id is not null").groupBy(F.upper(F.coalesce("neighbourhood", F.lit(""))).alias("neighbourhood"), "neighbourhood_id").agg(F.count("*").alias("n"))
    return counted.groupBy("neighbourhood").agg(F.max_by("neighbourhood_id", F.struct("n", -F.col("neighbourhood_id"))).alias("neighbourhood_id"))


def census_indicators(names: DataFrame, census: DataFrame) -> DataFrame:
    """Census figures of each neighbourhood by its numeric id, with household size where there are households."""
    area = F.format_string("N%04d", F.col("neighbourhood_id"))
    size = F.when(F.col("households") > 0, F.col("population") / F.col("households"))
    return names.withColumn("area_id", area).join(census, "area_id").withColumn("household_size", size)


def distinct_warnings(warnings: Column) -> Column:
    """The first of each (code, severity, message)."""
    return F.array_distinct(F.transform(warnings, lambda w: F.struct(w["code"].alias("code"), w["severity"].alias("severity"), w["message"].alias("message"))))


def comparable_adjustment(targets: DataFrame, points: DataFrame, k: int = 5) -> DataFrame:
    """(target_id, adjustment): a fifth of what the mean value of the ``k`` nearest lies above the baseline; 0 without values."""
    near = knn(targets, points, k=k)
    mean = near.groupBy("target_id").agg(F.avg("value").alias("mean"))
    return targets.join(mean, "target_id", "left").select("target_id", F.coalesce((F.col("mean") - F.col("base")) * 0.2, F.lit(0.0)).alias("adjustment"))


def boxes_meet(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Two boxes (west, south, east, north) share a point."""
    return ~((a[2] < b[0]) | (a[0] > b[2]) | (a[3] < b[1]) | (a[1] > b[3]))


def geometry_points(points: Column, start_lat: Column, start_lon: Column, end_lat: Column, end_lon: Column, lat: Column, lon: Column) -> Column:
    """The valid points of a list, else start and end, else the single point, else none; struct(lon, lat)."""
    whole = lambda p: p["lon"].isNotNull() & p["lat"].isNotNull()
    listed = F.filter(F.coalesce(points, F.array().cast("array<struct<lon:double,lat:double>>")), whole)
    pair = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    ends = F.array(pair(start_lon, start_lat), pair(end_lon, end_lat))
    return F.when(F.size(listed) > 0, listed).when(start_lat.isNotNull() & start_lon.isNotNull() & end_lat.isNotNull() & end_lon.isNotNull(), ends).when(lat.isNotNull() & lon.isNotNull(), F.array(pair(lon, lat))).otherwise(F.filter(listed, lambda p: F.lit(False)))


def ordered_union(rows: DataFrame, key: str, item: str) -> DataFrame:
    """(key, items): distinct items of each key by first arrival. Repeats are folded before the lists are built."""
    first = rows.filter(F.col(item).isNotNull()).groupBy(key, item).agg(F.min("ordinal").alias("ordinal"))
    listed = F.array_sort(F.collect_list(F.struct("ordinal", item)))
    return first.groupBy(key).agg(F.transform(listed, lambda x: x[item]).alias("items"))


def merged_objects(rows: DataFrame, key: str) -> DataFrame:
    """(key, name, value): entries of all objects of a key; of entries with one name the last to arrive stays."""
    entries = rows.select(key, "ordinal", F.explode("entries").alias("name", "value"))
    return entries.groupBy(key, "name").agg(F.max_by("value", "ordinal").alias("value"))


def library_points(pois: DataFrame) -> DataFrame:
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return pois.filter("lat is not null and lon is not null").filter((low("category") == "library") | low("subcategory").contains("library"))


def by_source_or_category(pois: DataFrame, sources: list[str], categories: list[str]) -> DataFrame:
    """Points of the sources; those of the categories (any case) only where no source has a point."""
    placed = pois.filter("lat is not null and lon is not null")
    preferred = placed.filter(F.col("source_id").isin(*sources))
    if preferred.limit(1).isEmpty():
        return placed.filter(F.lower(F.coalesce("category", F.lit(""))).isin(*[c.lower() for c in categories]))
    return preferred


def reason_counts(records: DataFrame) -> DataFrame:
    return records.groupBy(F.coalesce("reason_code", F.lit("none")).alias("reason_code")).agg(F.count("*").alias("n"))


def top_patterns(addresses: DataFrame, most: int = 10) -> DataFrame:
    """The ``most`` frequent shapes of an address: letters become A, digits 9."""
    shape = F.regexp_replace(F.regexp_replace(F.upper("address"), "[A-Z]+", "A"), "[0-9]+", "9")
    return addresses.groupBy(shape.alias("pattern")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "pattern").limit(most)


def surest(rows: DataFrame, most: int) -> DataFrame:
    return rows.orderBy(F.col("confidence").desc_nulls_last(), "location_id").limit(most)


def detail(properties: DataFrame, assessments: DataFrame, location_id: str) -> DataFrame:
    """One property with the value of its assessment, else its own."""
    return properties.filter(F.col("location_id") == location_id).join(assessments.select("location_id", F.col("value").alias("assessed")), "location_id", "left").withColumn("value", F.coalesce("assessed", "value")).drop("assessed")
