"""Listing cards: parsing, duplicate choice, address variants, coordinate reuse, enrichment report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.text import clean_address, fold_directions, street_key, tidy


def card_fields(card: Column) -> Column:
    """struct(price, square_feet, bedrooms, bathrooms, address) of a card's text; the address is the line after the price."""
    number = lambda pattern: F.regexp_replace(F.regexp_extract(card, pattern, 1), ",", "")
    return F.struct(
        number(r"\$\s*([0-9][0-9,]*)").try_cast("double").alias("price"), number(r"(?i)([0-9][0-9,]*)\s*(?:sq\.?\s*ft|sqft|square feet)").try_cast("double").alias("square_feet"),
        number(r"(?i)([0-9]+)\s*(?:beds?|bedrooms?|bd)\b").try_cast("int").alias("bedrooms"), number(r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(?:baths?|bathrooms?|ba)\b").try_cast("double").alias("bathrooms"),
        tidy(F.regexp_extract(card, r"\$[^\n]*\n([^\n]+)", 1)).alias("address"))


def best_listing(rows: DataFrame, key: str, columns: list[str], link: str) -> DataFrame:
    """Of each key the row with most filled columns, then one with a link, then the first to arrive."""
    filled = sum((F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "", 1).otherwise(0) for c in columns), F.lit(0))
    has_link = F.coalesce(F.trim(link) != "", F.lit(False)).cast("int")
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(filled, has_link, -F.col("ordinal"))).alias("r")).select(key, "r.*")


def address_variants(address: Column) -> Column:
    """Distinct spellings to look an address up by, best first."""
    body = tidy(F.split(F.upper(address), ",")[0])
    no_suite = tidy(F.regexp_replace(body, r"^#?\s*[0-9A-Z]+\s*-\s*(?=[0-9])|^#[0-9A-Z]+\s+", ""))
    no_quadrant = tidy(F.regexp_replace(no_suite, r"\s+(NW|NE|SW|SE)$", ""))
    return F.array_distinct(F.array_compact(F.array(body, no_suite, street_key(no_suite), fold_directions(clean_address(no_suite)), no_quadrant)))


def resolve(listings: DataFrame, addresses: DataFrame) -> DataFrame:
    """(listing_id, location_id, tier): the property by the best variant that any has; ties to the least id.

    listings: (listing_id, address); addresses: (location_id, address).
    """
    wanted = listings.select("listing_id", F.posexplode(address_variants(F.col("address"))).alias("tier", "spelling"))
    there = addresses.select("location_id", F.explode(address_variants(F.col("address"))).alias("spelling")).distinct()
    met = wanted.join(there, "spelling")
    return met.groupBy("listing_id").agg(F.min(F.struct("tier", "location_id")).alias("m")).select("listing_id", "m.location_id", F.col("m.tier").cast("long").alias("tier"))


def reuse_coordinates(rows: DataFrame, key: str) -> DataFrame:
    """Rows without a place take that of the first row with the same key."""
    known = rows.filter("lat is not null and lon is not null").groupBy(key).agg(F.min_by(F.struct("lat", "lon"), "ordinal").alias("_p"))
    joined = rows.join(known, key, "left")
    return joined.withColumns({"lat": F.coalesce("lat", "_p.lat"), "lon": F.coalesce("lon", "_p.lon")}).drop("_p")


def enrichment_report(staged: DataFrame) -> DataFrame:
    """One row: counts by kind of source and by confidence, and shares of all."""
    kind = lambda k: F.count_if(F.col("source_type") == k)
    sure = F.coalesce("confidence", F.lit(0.0))
    return staged.agg(
        F.count("*").alias("total"), kind("observed").alias("observed"), kind("inferred").alias("inferred"), kind("imputed").alias("imputed"),
        F.count_if(sure >= 0.9).alias("high"), F.count_if((sure >= 0.75) & (sure < 0.9)).alias("medium"), F.count_if(sure < 0.75).alias("low"),
        F.round(100 * F.count_if(F.col("bedrooms").isNotNull()) / F.count("*"), 4).alias("percent_with_bedrooms"))
