"""Whole merge folds: all rows of a property or a point of interest become one, as if merged one after another.

Arrival order is an explicit ``ordinal``, so every part of a fold is an aggregate that
combines before the shuffle: first known values, the value of the latest year, the surest
link, unions of lists by first arrival, entries of objects by last arrival. Items of lists
and entries of objects are made distinct before any list is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fields that keep the first known value.
PROPERTY_FIELDS = [
    "suite", "house_number", "street_name", "legal_description", "zoning", "lot_size", "total_gross_area", "year_built", "neighbourhood_id", "neighbourhood", "ward", "tax_class", "garage",
    "assessment_class_1", "assessment_class_2", "assessment_class_3", "assessment_class_pct_1", "assessment_class_pct_2", "assessment_class_pct_3", "lat", "lon", "point_location",
]
POI_FIELDS = ["name", "raw_category", "raw_subcategory", "address", "lon", "lat", "neighbourhood", "source_dataset", "source_provider", "source_version"]


def _first(rows: DataFrame, column: str) -> Column:
    c = F.col(column)
    known = c.isNotNull() & (F.trim(c) != "") if dict(rows.dtypes)[column] == "string" else c.isNotNull()
    return F.min_by(F.when(known, c), F.when(known, F.col("ordinal"))).alias(column)


def list_unions(rows: DataFrame, key: str, lists: list[str]) -> DataFrame:
    """(key, lists): of each list column the distinct items of all rows by first arrival; null items go."""
    items = rows.select(key, "ordinal", F.inline(F.array(*[F.struct(F.lit(n).alias("list"), F.col(n).alias("items")) for n in lists])))
    items = items.select(key, "ordinal", "list", F.posexplode("items").alias("place", "item")).filter("item is not null")
    first = items.groupBy(key, "list", "item").agg(F.min(F.struct("ordinal", "place")).alias("at"))
    gathered = [F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == n, F.struct("at", "item")))), lambda x: x["item"]).alias(n) for n in lists]
    return first.groupBy(key).agg(*gathered)


def fold_properties(rows: DataFrame, key: str = "location_id") -> DataFrame:
    """One row for each location, of rows with an ordinal.

    PROPERTY_FIELDS that there are: first known. assessment_year and assessment_value: of the
    latest year among rows with a value (no year counts as 0), later rows win ties; without
    any value the first row's year. link_method and confidence: of the greatest confidence,
    later rows win ties. greatest_confidence: the greatest told, where the surest link has none
    too. source_ids and record_ids: unions. updated_at: the greatest.
    """
    year = F.coalesce("assessment_year", F.lit(0))
    valued = F.when(F.col("assessment_value").isNotNull(), F.struct(year, F.col("ordinal")))
    surest = F.struct(F.coalesce("confidence", F.lit(0.0)), F.col("ordinal"))
    one = rows.groupBy(key).agg(
        *[_first(rows, c) for c in PROPERTY_FIELDS if c in rows.columns],
        F.coalesce(F.max_by("assessment_year", valued), F.when(F.count("assessment_value") == 0, F.min_by("assessment_year", "ordinal"))).alias("assessment_year"), F.max_by("assessment_value", valued).alias("assessment_value"),
        F.max_by("link_method", surest).alias("link_method"), F.max_by("confidence", surest).alias("confidence"), F.max("confidence").alias("greatest_confidence"), F.max("updated_at").alias("updated_at"))
    lists = [c for c in ("source_ids", "record_ids") if c in rows.columns]
    found = one.join(list_unions(rows, key, lists), key, "left") if lists else one
    return found.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in lists})


def _entries(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, ordinal, name, entry) of the objects in a VARIANT column; what isn't an object has no entries."""
    objects = rows.filter(F.schema_of_variant(value).startswith("OBJECT")).select(key, "ordinal", F.col(value).alias("v"))
    exploded = rows.sparkSession.sql(f"select o.{key}, o.ordinal, e.key as name, e.value as entry from {{o}} o, lateral variant_explode(o.v) e", o=objects)
    return exploded


def _as_object(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """(keys, out): (name, json) pairs as the text of one object, names sorted."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("name", "json"))), lambda p: F.concat(_quoted(p["name"]), F.lit(":"), p["json"]))
    return rows.groupBy(*keys).agg(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias(out))


def _quoted(name: Column) -> Column:
    """A name as JSON text."""
    listed = F.to_json(F.array(name))
    return F.substring(listed, F.lit(2), F.char_length(listed) - 2)


def merged_objects(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, column): JSON objects of a key merged by arrival, entries that are objects merged one level deeper.

    A later entry replaces an earlier one of its name; where both are objects, their own
    entries are merged likewise. Texts that are no JSON object add nothing.
    """
    parsed = rows.select(key, "ordinal", F.try_parse_json(F.col(column)).alias("v")).filter("v is not null")
    top = _entries(parsed, key, "v").withColumn("nested", F.schema_of_variant("entry").startswith("OBJECT"))
    by_name = Window.partitionBy(key, "name")
    # a plain entry ends what was merged before it
    top = top.withColumns({"last": F.max("ordinal").over(by_name), "reset": F.max(F.when(~F.col("nested"), F.col("ordinal"))).over(by_name)})
    plain = top.filter("reset = last and ordinal = last").select(key, "name", F.to_json("entry").alias("json"))
    deep = top.filter("nested and (reset is null or ordinal > reset)").withColumn("whole", F.struct(key, "name"))
    inner = _entries(deep.select("whole", "ordinal", "entry"), "whole", "entry").groupBy("whole", "name").agg(F.max_by(F.to_json("entry"), "ordinal").alias("json"))
    inner = _as_object(inner, ["whole"], "json")
    empty = deep.select("whole").distinct()  # objects without entries stay as such
    inner = empty.join(inner, "whole", "left").select(F.col(f"whole.{key}").alias(key), F.col("whole.name").alias("name"), F.coalesce("json", F.lit("{}")).alias("json"))
    return _as_object(plain.unionByName(inner), [key], column)


def fold_pois(rows: DataFrame, key: str = "poi_id") -> DataFrame:
    """One row for each point of interest, of rows with an ordinal.

    POI_FIELDS that there are: first known. source_ids and source_entity_ids: unions.
    metadata, a JSON object: later entries replace earlier ones, only those of ``sources``
    are merged. updated_at: the greatest.
    """
    one = rows.groupBy(key).agg(*[_first(rows, c) for c in POI_FIELDS if c in rows.columns], F.max("updated_at").alias("updated_at"))
    lists = [c for c in ("source_ids", "source_entity_ids") if c in rows.columns]
    if lists:
        one = one.join(list_unions(rows, key, lists), key, "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in lists})
    parsed = rows.select(key, "ordinal", F.try_parse_json(F.col("metadata")).alias("v")).filter("v is not null")
    top = _entries(parsed, key, "v")
    plain = top.filter("name != 'sources'").groupBy(key, "name").agg(F.max_by(F.to_json("entry"), "ordinal").alias("json"))
    sources = _entries(top.filter("name = 'sources'").select(key, "ordinal", "entry"), key, "entry").groupBy(key, "name").agg(F.max_by(F.to_json("entry"), "ordinal").alias("json"))
    inner = _as_object(sources, [key], "json")
    every = rows.select(key).distinct().join(inner, key, "left").select(key, F.lit("sources").alias("name"), F.coalesce("json", F.lit("{}")).alias("json"))
    return one.join(_as_object(plain.unionByName(every), [key], "metadata"), key, "left")
