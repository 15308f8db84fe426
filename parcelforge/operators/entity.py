"""Entity resolution: duplicate points of interest, and addresses of listings matched to properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.functions import geo
from parcelforge.functions.text import address_key, slug
from parcelforge.graph.components import connected_components
from parcelforge.session import materialize

#: Weights of nearness, name and id, and the two limits of the decision.
NEAR_M, W_NEAR, W_NAME, W_ID = 250.0, 0.55, 0.35, 0.10
AUTO, REVIEW = 0.85, 0.65
#: No pair further apart can reach REVIEW.
REACH_M = 160.0
#: Metres within which a listing and a property agree in place.
NEARBY_M = 40.0


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal names, 0.8 if one contains the other, else 0.4; both trimmed and in lower case."""
    inside = (F.instr(a, b) > 0) | (F.instr(b, a) > 0)
    return F.when(a == b, 1.0).when(F.coalesce(inside, F.lit(False)), 0.8).otherwise(0.4)


def duplicate_pairs(pois: DataFrame, size: float = 0.003) -> DataFrame:
    """Pairs of two sources and one category that are to be merged or reviewed, with confidence.

    Points meet in the cells around one of them: a cell is wider than REACH_M in both
    directions, so no pair is lost. An id that two sources share counts for the pair.
    """
    p = pois.select("entity_id", "source_id", "category", F.lower(F.trim(F.coalesce("name", F.lit("")))).alias("plain_name"), "lat", "lon").filter("lat is not null and lon is not null")
    p = p.withColumns({"cx": geo.cell(F.col("lon"), size), "cy": geo.cell(F.col("lat"), size)})
    around = p.withColumn("cx", F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1))).withColumn("cy", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)))
    a, b = around.alias("a"), p.alias("b")
    same = (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.category") == F.col("b.category")) & (F.col("a.source_id") != F.col("b.source_id")) & (F.struct("a.entity_id", "a.source_id") < F.struct("b.entity_id", "b.source_id"))
    d = geo.haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    pairs = a.join(b, same).select(F.col("a.entity_id").alias("a"), F.col("b.entity_id").alias("b"), d.alias("distance"), name_similarity(F.col("a.plain_name"), F.col("b.plain_name")).alias("name"))
    score = W_NEAR * F.greatest(F.lit(0.0), 1 - F.col("distance") / NEAR_M) + W_NAME * F.col("name") + F.when(F.col("a") == F.col("b"), W_ID).otherwise(0.0)
    return pairs.withColumn("confidence", score).filter(F.col("confidence") >= REVIEW).withColumn("decision", F.when(F.col("confidence") >= AUTO, "auto_merge").otherwise("review"))


def canonical_entities(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """(entity_id, canonical_id): components over the automatic merges; the least id names its group."""
    edges = pairs.filter("decision = 'auto_merge'").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    found = connected_components(edges)
    return ids.select(F.col("entity_id").cast("long").alias("entity_id")).join(found.withColumnRenamed("id", "entity_id"), "entity_id", "left").select("entity_id", F.coalesce("component", "entity_id").alias("canonical_id"))


def unit_groups(properties: DataFrame) -> DataFrame:
    """Properties with the number of those that share house and street."""
    key = address_key(F.lit(None).cast("string"), F.col("house"), F.col("street"))
    keyed = properties.withColumn("base_key", key)
    sizes = keyed.filter("base_key is not null").groupBy("base_key").agg(F.count("*").alias("units"))
    return keyed.join(sizes, "base_key", "left").withColumn("units", F.coalesce("units", F.lit(0)))


def _cell(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """The cube, wider than NEARBY_M, that holds a place of the globe; places that near are in neighbouring cubes anywhere on earth."""
    flat = F.cos(F.radians(lat))
    along = (flat * F.cos(F.radians(lon)), flat * F.sin(F.radians(lon)), F.sin(F.radians(lat)))
    return tuple(F.floor(c * geo.EARTH_M / (NEARBY_M + 1)).cast("long") for c in along)


def match_listings(properties: DataFrame, listings: DataFrame, gap: float = 0.03) -> DataFrame:
    """(listing_id, location_id, method, confidence, ambiguous): the best property of every listing.

    Candidates share the full address key, or house number and street in one spelling. A
    listing without suite at an address of many units is a suite risk. A runner-up closer
    than ``gap`` makes the match ambiguous. Of candidates that are equally sure two decide,
    those of the least ids, so no more are paired.
    """
    key = address_key(F.col("suite"), F.col("house"), F.col("street"))
    base = address_key(F.lit(None).cast("string"), F.col("house"), F.col("street"))
    p = unit_groups(properties).select("location_id", "units", key.alias("key"), base.alias("base"), "lat", "lon")
    s = listings.select("listing_id", F.col("suite").isNull().alias("no_suite"), key.alias("key"), base.alias("base"), F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"))
    p, s = materialize(p, "listing-properties"), materialize(s, "listings")
    least = lambda keys, n: p.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("location_id"))).filter(F.col("_n") <= n).drop("_n")
    exact = s.join(least(["key"], 2).drop("base"), "key").withColumn("exact", F.lit(True)).drop("key", "base")
    # as far as anything may be, the least ids; where fewer than two are exact, those so near that it counts as well
    loose = s.join(least(["base"], 3).drop("key"), "base").drop("key", "base")
    settled = p.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key")
    open_ = s.join(settled, "key", "left_anti").join(p.select("base", "units").distinct(), "base").filter("not (no_suite and units > 1)").drop("units")
    here, there = _cell(F.col("l_lat"), F.col("l_lon")), _cell(F.col("lat"), F.col("lon"))
    for i, c in enumerate("xyz"):
        open_ = open_.withColumn(f"_{c}", F.explode(F.sequence(here[i] - 1, here[i] + 1)))
    places = least(["base", "lat", "lon"], 3).withColumns({f"_{c}": there[i] for i, c in enumerate("xyz")})
    near = open_.join(places.drop("key"), ["base", "_x", "_y", "_z"]).filter(geo.haversine(F.col("lat"), F.col("lon"), F.col("l_lat"), F.col("l_lon")) <= NEARBY_M)
    loose = loose.unionByName(near.select(loose.columns)).withColumn("exact", F.lit(False))
    both = exact.unionByName(loose).groupBy("listing_id", "location_id").agg(F.max("exact").alias("exact"), F.first("no_suite").alias("no_suite"), F.first("units").alias("units"), F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.first("l_lat").alias("l_lat"), F.first("l_lon").alias("l_lon"))
    metres = geo.haversine(F.col("lat"), F.col("lon"), F.col("l_lat"), F.col("l_lon"))
    agreement = F.when(metres <= 15, 0.20).when(metres <= NEARBY_M, 0.10).otherwise(0.0)
    risk = F.col("no_suite") & (F.col("units") > 1)
    method = F.when(risk, "suite_missing_multi_unit").when(F.col("exact"), "exact_address").otherwise("house_street")
    confidence = F.when(risk, 0.96).when(F.col("exact"), 0.99).otherwise(F.least(F.lit(0.96), 0.70 + 0.15 + agreement))
    scored = both.select("listing_id", "location_id", method.alias("method"), confidence.alias("confidence"))
    order = Window.partitionBy("listing_id").orderBy(F.col("confidence").desc(), "location_id")
    ranked = scored.withColumns({"rank": F.row_number().over(order), "next": F.lead("confidence").over(order)})
    return ranked.filter("rank = 1").select("listing_id", "location_id", "method", "confidence", F.coalesce(F.col("confidence") - F.col("next") < gap, F.lit(False)).alias("ambiguous"))


def one_property_each(matches: DataFrame) -> DataFrame:
    """Of the listings that claim a property the most confident stays; an exact tie quarantines all of them."""
    order = Window.partitionBy("location_id").orderBy(F.col("confidence").desc(), "listing_id")
    ranked = matches.withColumns({"rank": F.row_number().over(order), "next": F.lead("confidence").over(order)})
    return ranked.filter("rank = 1").select("location_id", "listing_id", "method", "confidence", F.coalesce(F.abs(F.col("confidence") - F.col("next")) < 1e-9, F.lit(False)).alias("quarantined"))


PRECEDENCE = {"observed": 400, "inferred": 300, "imputed": 200, "default": 100}


def promote(current: DataFrame, candidates: DataFrame) -> DataFrame:
    """Attribute rows after promotion: the higher precedence, then the higher confidence, holds; estimates fill gaps only.

    Both have (location_id, bedrooms, bathrooms, bedrooms_estimated, bathrooms_estimated,
    confidence, source_type); one row a location on either side.
    """
    weight = F.create_map(*[F.lit(x) for kv in PRECEDENCE.items() for x in kv])
    rank = lambda side: F.coalesce(F.element_at(weight, F.col(f"{side}.source_type")), F.lit(0))
    joined = current.alias("o").join(candidates.alias("n"), F.col("o.location_id") == F.col("n.location_id"), "full_outer")
    fresh = F.col("o.location_id").isNull()
    none = F.col("n.location_id").isNull()
    higher = (rank("n") > rank("o")) | ((rank("n") == rank("o")) & (F.coalesce(F.col("n.confidence"), F.lit(0.0)) >= F.coalesce(F.col("o.confidence"), F.lit(0.0))))
    take = fresh | (~none & higher)
    pick = lambda c: F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    keep_old = take & ~fresh & (F.col("n.source_type") != "imputed")
    guess = lambda c: F.when(keep_old, F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))).when(take, F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))).otherwise(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))).alias(c)
    return joined.select(F.coalesce("o.location_id", "n.location_id").alias("location_id"), pick("bedrooms"), pick("bathrooms"), guess("bedrooms_estimated"), guess("bathrooms_estimated"), pick("confidence"), pick("source_type"))


def grouped_impute(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(location_id, bedrooms, bathrooms) for rows without bedrooms: the group's most frequent number (least on ties) and mean baths to the half."""
    known = rows.filter("bedrooms is not null and bathrooms is not null")
    counts = known.groupBy(*keys, "bedrooms").agg(F.count("*").alias("n"))
    beds = counts.groupBy(*keys).agg(F.max_by("bedrooms", F.struct("n", -F.col("bedrooms"))).alias("g_beds"))
    baths = known.groupBy(*keys).agg((F.bround(F.avg("bathrooms") * 2, 0) / 2).alias("g_baths"))
    groups = beds.join(baths, keys)
    missing = rows.filter("bedrooms is null").select("location_id", *keys)
    return missing.join(groups, keys, "left").select("location_id", F.coalesce("g_beds", F.lit(3)).cast("long").alias("bedrooms"), F.coalesce("g_baths", F.lit(2.0)).alias("bathrooms"))


def resolve_status(found: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """(query, status, location_id) of matches (query, location_id, lat, lon), a query without any having one row of nulls."""
    inside = geo.in_box(F.col("lat"), F.col("lon"), *box)
    n = found.groupBy("query").agg(F.count("location_id").alias("n"), F.count_if(F.coalesce(inside, F.lit(False))).alias("here"), F.min("location_id").alias("location_id"))
    status = F.when(F.col("n") == 0, "not_found").when(F.col("here") == 0, "unsupported_region").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    return n.select("query", status.alias("status"), F.when(status == "resolved", F.col("location_id")).alias("location_id"))
