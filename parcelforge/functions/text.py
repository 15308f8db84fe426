"""Scalar text rules of the property records, as Column expressions.

Fixed values (word lists and codes that results depend on) stand in tables at the top.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Street-type words of road names and what they are shortened to, in the order of application.
ROAD_SUFFIXES = {
    "AVENUE": "AVE", "STREET": "ST", "ROAD": "RD", "DRIVE": "DR", "BOULEVARD": "BLVD", "COURT": "CT", "PLACE": "PL",
    "TERRACE": "TER", "CRESCENT": "CRES", "LANE": "LN", "TRAIL": "TRL", "PARKWAY": "PKWY", "HIGHWAY": "HWY",
}
# Street-type spellings, right and wrong, and their short forms.
STREET_WORDS = {
    "STREET": "ST", "STRT": "ST", "STRET": "ST", "STRRET": "ST", "AVENUE": "AVE", "AVNUE": "AVE", "AVENEU": "AVE", "AVENUEE": "AVE",
    "ROAD": "RD", "DRIVE": "DR", "DRV": "DR", "BOULEVARD": "BLVD", "BOULVARD": "BLVD", "COURT": "CRT", "CRESCENT": "CRES", "CRESCANT": "CRES",
    "PLACE": "PL", "TERRACE": "TER", "TERACE": "TER", "LANE": "LN", "LAEN": "LN", "TRAIL": "TRL", "TRAL": "TRL",
}
# Compass words.
DIRECTIONS = {"NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W", "NORTHWEST": "NW", "NORTHEAST": "NE", "SOUTHWEST": "SW", "SOUTHEAST": "SE"}


def to_double(text: Column) -> Column:
    """Number of a text with blanks, commas or dollar signs; null where it is none."""
    return F.regexp_replace(F.trim(text), "[,$]", "").try_cast("double")


def to_int(text: Column) -> Column:
    """Whole number of a text; null for fractions and anything else."""
    return F.trim(text).try_cast("int")


def tidy(text: Column) -> Column:
    """Runs of blanks become one, ends are trimmed, empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def slug(text: Column) -> Column:
    """Letters and digits only, in lower case; null for blank."""
    return F.nullif(F.lower(F.regexp_replace(tidy(text), r"[^\p{L}\p{N}]", "")), F.lit(""))


def display(text: Column) -> Column:
    """Underscores become blanks and each word gets a capital."""
    return F.initcap(F.replace(tidy(text), F.lit("_"), F.lit(" ")))


def first_known(*texts: Column) -> Column:
    """The first text that isn't null or blank."""
    return F.coalesce(*[F.when(F.trim(t) != "", t) for t in texts])


def to_bool(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("1", "true", "t", "yes", "y")


def leading_year(text: Column) -> Column:
    """Year before the first hyphen or slash."""
    return F.trim(F.split(text, "[-/]")[0]).try_cast("int")


def road_name(text: Column) -> Column:
    """Road name in one spelling: upper case, short street types, no punctuation."""
    padded = F.concat(F.lit(" "), F.translate(F.upper(tidy(text)), ".-", "  "), F.lit(" "))
    short = reduce(lambda c, kv: F.replace(c, F.lit(f" {kv[0]} "), F.lit(f" {kv[1]} ")), ROAD_SUFFIXES.items(), padded)
    return tidy(F.regexp_replace(short, r"[^\p{L}\p{N}\s]", " "))


def road_names(*texts: Column) -> Column:
    """Distinct spellings in the order given."""
    return F.array_distinct(F.array_compact(F.array(*[road_name(t) for t in texts])))


def is_placeholder_name(name: Column, road_id: Column) -> Column:
    """No name at all, the road's own id, or nothing with a letter."""
    text = tidy(name)
    return text.isNull() | F.coalesce(text == F.trim(road_id), F.lit(False)) | ~text.rlike(r"\p{L}")


def _map(words: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in words.items() for x in kv])


def _by_word(text: Column, words: dict[str, str]) -> Column:
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.coalesce(F.element_at(_map(words), w), w)), " ")


def clean_address(text: Column) -> Column:
    return tidy(F.regexp_replace(F.upper(text), r"[^\p{L}\p{N} ]", " "))


def fold_directions(text: Column) -> Column:
    """Compass words to letters; two neighbours become one code."""
    letters = _by_word(text, DIRECTIONS)
    return F.regexp_replace(letters, r"\b([NS]) ([EW])\b", "$1$2")


def street_key(street: Column) -> Column:
    """One spelling of a street name."""
    return fold_directions(_by_word(clean_address(street), STREET_WORDS))


def address_parts(address: Column) -> Column:
    """struct(suite, house, street) of a written address such as ``12-345 Main St NW`` or ``345 Main St NW Suite 12``."""
    text = tidy(F.upper(address))
    front = F.regexp_extract(text, r"^#?\s*([0-9A-Z]+)\s*-\s*([0-9]+[A-Z]?)\s+(.+)$", 1)
    back = F.regexp_extract(text, r"\b(?:SUITE|UNIT|APT)\s+([0-9A-Z]+)$", 1)
    body = F.regexp_replace(F.regexp_replace(text, r"^#?\s*[0-9A-Z]+\s*-\s*(?=[0-9])", ""), r"\s*,?\s*\b(?:SUITE|UNIT|APT)\s+[0-9A-Z]+$", "")
    return F.struct(
        F.coalesce(F.nullif(front, F.lit("")), F.nullif(back, F.lit(""))).alias("suite"),
        F.nullif(F.regexp_extract(body, r"^([0-9]+[A-Z]?)\s+(.+)$", 1), F.lit("")).alias("house"),
        F.nullif(F.regexp_extract(body, r"^([0-9]+[A-Z]?)\s+(.+)$", 2), F.lit("")).alias("street"),
    )


def address_key(suite: Column, house: Column, street: Column) -> Column:
    """suite|house|street in one spelling; null without house or street."""
    return F.when(house.isNotNull() & street.isNotNull(), F.concat_ws("|", F.coalesce(clean_address(suite), F.lit("")), clean_address(house), street_key(street)))


def search_text(query: Column) -> Column:
    """What is before the first comma, upper case, signs as blanks."""
    return tidy(F.regexp_replace(F.upper(F.split(query, ",")[0]), r"[^\p{L}\p{N}]", " "))


def permit_rooms(text: Column) -> Column:
    """struct(bedrooms, bathrooms, confidence) told by a permit's text."""
    low = F.lower(text)
    beds = F.regexp_extract(low, r"([0-9]+)\s*bed", 1).try_cast("int")
    baths = F.regexp_extract(low, r"([0-9]+(?:\.[0-9]+)?)\s*bath", 1).try_cast("double")
    half = low.rlike(r"half[- ]?bath|1/2\s*bath")
    whole = F.when(half, F.coalesce(baths, F.lit(0.0)) + 0.5).otherwise(baths)
    sure = F.when(beds.isNotNull() & whole.isNotNull(), 0.82).when(beds.isNotNull() | whole.isNotNull(), 0.72)
    return F.struct(beds.alias("bedrooms"), whole.alias("bathrooms"), sure.alias("confidence"))


def money_text(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, 0))


def money(value: Column) -> Column:
    """Never below zero, whole cents."""
    return F.round(F.greatest(F.lit(0.0), value), 2)
