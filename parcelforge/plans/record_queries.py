"""Queries of the record rules, with the same rows in SQL written from the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelforge.operators import records as R
from parcelforge.plans.adapters import view
from parcelforge.plans.catalog import _points, _targets, legs, query, rounded

_AREA_MAP = "select source_area_id, area_id from (select distinct neighbourhood as source_area_id, case when neighbourhood_id % 4 = 0 then '' when neighbourhood_id % 5 = 0 then null else concat('A', cast(neighbourhood_id as string)) end as area_id from properties)"


@query("select ordinal, case when n = 1 then id else concat_ws('__', id, source_id, case when again > 1 then cast(again as string) end) end as unique_id from (select *, row_number() over (partition by id, source_id, n > 1 order by ordinal) as again from (select ordinal, source_id, location_id as id, row_number() over (partition by location_id order by ordinal) as n from records))", ("records",))
def record_id_by_source(spark, sf):
    """Many records of a location from two sources: ids repeat often."""
    return R.source_ids(view(spark, sf, "records").withColumn("record_id", F.col("location_id"))).select("ordinal", "unique_id")


@query("select location_id, source_type, confidence, bedrooms, bathrooms from attributes where source_type in ('observed', 'inferred') and coalesce(confidence, 0) >= 0.6 and (bedrooms is not null or bathrooms is not null)", ("attributes",))
def room_training_rows(spark, sf):
    return R.training_rows(view(spark, sf, "attributes"), 0.6).select("location_id", "source_type", "confidence", "bedrooms", "bathrooms")


_NAMED = "case when ordinal % 3 = 0 then name else '  ' end as name, case when ordinal % 3 = 1 and ordinal % 2 = 0 then concat('  ', subcategory, '  one ') end as branch, case when ordinal % 5 <> 0 then 'green_space' else '' end as raw_category, case when ordinal % 4 = 0 then concat('1  ', subcategory) end as address, entity_id"


@query(f"""select entity_id, coalesce(nullif(trim(name), ''), nullif(trim(regexp_replace(branch, '\\s+', ' ', 'g')), ''), case when raw_category <> '' then 'Green Space' end || ' at ' || regexp_replace(address, '\\s+', ' ', 'g'), case when raw_category <> '' then 'Green Space' end, entity_id) as name from (select {_NAMED} from pois)""", ("pois",))
def feature_names(spark, sf):
    rows = view(spark, sf, "pois").selectExpr(*[c.strip() for c in _NAMED.replace(", case", "|case").replace(", entity_id", "|entity_id").split("|")])
    return rows.select("entity_id", R.feature_name(rows, F.col("entity_id")).alias("name"))


@query("select entity_id, case when ordinal % 2 = 0 then cast(ordinal as string) else concat('c', cast(ordinal as string)) end as municipal_segment_id, case when ordinal % 3 = 0 then null else name end as official_road_name, subcategory as surface_type from pois", ("pois",))
def road_attribute_aliases(spark, sf):
    p = view(spark, sf, "pois").selectExpr("entity_id", "case when ordinal % 2 = 0 then cast(ordinal as string) end as municipal_segment_id", "concat(' c', cast(ordinal as string)) as centerline", "case when ordinal % 3 = 1 then name else '' end as street_nam", "case when ordinal % 3 = 2 then name when ordinal % 3 = 0 then '  ' end as road_name", "subcategory as road_segme")
    return p.select("entity_id", *[c for c in R.road_attributes(p)]).select("entity_id", "municipal_segment_id", "official_road_name", "surface_type")


@query(f"select p.location_id, m.area_id from properties p left join (select source_area_id, nullif(area_id, '') as area_id from ({_AREA_MAP})) m on m.source_area_id = p.neighbourhood", ("properties",))
def area_mapping(spark, sf):
    p = view(spark, sf, "properties")
    mapping = p.selectExpr("neighbourhood as source_area_id", "case when neighbourhood_id % 4 = 0 then '' when neighbourhood_id % 5 = 0 then null else concat('A', cast(neighbourhood_id as string)) end as area_id").distinct()
    return R.map_areas(p.withColumnRenamed("neighbourhood", "source_area_id"), mapping).select("location_id", "area_id")


@query(f"select source_area_id, count(*) as n from (select p.neighbourhood as source_area_id from properties p left join (select source_area_id, nullif(area_id, '') as area_id from ({_AREA_MAP})) m on m.source_area_id = p.neighbourhood where m.area_id is null) group by 1", ("properties",))
def unmapped_areas(spark, sf):
    p = view(spark, sf, "properties")
    mapping = p.selectExpr("neighbourhood as source_area_id", "case when neighbourhood_id % 4 = 0 then '' when neighbourhood_id % 5 = 0 then null else concat('A', cast(neighbourhood_id as string)) end as area_id").distinct()
    return R.map_areas(p.withColumnRenamed("neighbourhood", "source_area_id"), mapping).filter("area_id is null").groupBy("source_area_id").agg(F.count("*").alias("n"))


@query("select location_id, trim(regexp_replace(concat(coalesce('#' || suite || ' ', ''), house, ' ', upper(street), ' AB'), '\\s+', ' ', 'g')) as address_key from properties", ("properties",))
def realtor_address_keys(spark, sf):
    p = view(spark, sf, "properties")
    written = F.concat(F.coalesce(F.concat(F.lit("#"), F.col("suite"), F.lit(" - ")), F.lit(" ")), F.col("house"), F.lit("  "), F.lower("street"), F.lit(",  Edmonton (AB), Alberta."))
    return p.select("location_id", R.realtor_key(written).alias("address_key"))


@query("select entity_id, not (contains(lower(name), 'corridor') or contains(lower(name), 'industrial') or contains(lower(name), 'big lake')) as residential from (select entity_id, case when ordinal % 5 = 0 then concat(name, ' Corridor') when ordinal % 7 = 0 then concat('INDUSTRIAL ', name) when ordinal % 11 = 0 then 'Big Lake' else name end as name from pois)", ("pois",))
def residential_names(spark, sf):
    p = view(spark, sf, "pois").selectExpr("entity_id", "case when ordinal % 5 = 0 then concat(name, ' Corridor') when ordinal % 7 = 0 then concat('INDUSTRIAL ', name) when ordinal % 11 = 0 then 'Big Lake' else name end as name")
    return p.select("entity_id", R.is_residential(F.col("name")).alias("residential"))


@query("select location_id, case when h is not null and h <> ' ' then concat(h, ' ', s, ', Edmonton, AB') else coalesce(s, '') end as address from (select location_id, case when year_built % 3 = 0 then null when year_built % 3 = 1 then ' ' else house end as h, case when year_built % 6 = 0 then null else street end as s from properties)", ("properties",))
def full_addresses(spark, sf):
    p = view(spark, sf, "properties").selectExpr("location_id", "case when year_built % 3 = 0 then null when year_built % 3 = 1 then ' ' else house end as h", "case when year_built % 6 = 0 then null else street end as s")
    return p.select("location_id", R.full_address(F.col("h"), F.col("s")).alias("address"))


@query("select location_id, printf('properties|%.4f|%.4f|%.4f|%.4f|%.2f|%d|%s', lon, lat, lon + 0.01::double, lat + 0.02::double, 11.5::double, 200, coalesce(suite, '')) as cache_key from properties", ("properties",))
def viewport_keys(spark, sf):
    p = view(spark, sf, "properties")
    key = R.viewport_key(F.col("lon"), F.col("lat"), F.col("lon") + F.lit(0.01), F.col("lat") + F.lit(0.02), F.lit(11.5), F.lit(200), F.col("suite"))
    return p.select("location_id", key.alias("cache_key"))


@query("""select location_id, concat('estimate:', sha256(concat('{"address": "', upper(concat(house, ' ', street)), '", "canonical_location_id": ', case when suite is null then 'null' else concat('"', location_id, '"') end, ', "coords": {"lat": ', cast(round(lat, 6) as string), ', "lng": ', cast(round(lon, 6) as string), '}, "dataset_version": "v7", "property_details": {}}'))) as cache_key from properties""", ("properties",))
def estimate_keys(spark, sf):
    p = view(spark, sf, "properties")
    return p.select("location_id", R.estimate_key(F.col("lat"), F.col("lon"), F.when(F.col("suite").isNotNull(), F.col("location_id")), F.concat(F.lit(" "), "house", F.lit(" "), F.lower("street")), F.lit("v7")).alias("cache_key"))


@query("""select bucket_x, bucket_y, count(*) as count, round(avg(lat), 6) as center_lat, round(avg(lon), 6) as center_lng, round(min(lon), 4) as west, round(min(lat), 4) as south, round(max(lon), 4) as east, round(max(lat), 4) as north, string_agg(location_id, ',' order by location_id) filter (n <= 3) as samples
from (select *, row_number() over (partition by bucket_x, bucket_y order by location_id) as n from (select *, cast(trunc(lon / 0.018::double) as bigint) as bucket_x, cast(trunc(lat / 0.018::double) as bigint) as bucket_y from properties)) group by 1, 2""", ("properties",))
def clusters_truncated(spark, sf):
    r = R.truncated_clusters(view(spark, sf, "properties"), 12.5)
    four = {c: F.round(c, 4) for c in ("west", "south", "east", "north")}
    return r.withColumns({"center_lat": F.round("center_lat", 6), "center_lng": F.round("center_lng", 6), **four})


@query("""with i as (select l_orderkey as order_key, cast(l_linenumber as string) as code, case when l_partkey % 5 = 0 then 0.0::double when l_partkey % 2 = 0 then (l_partkey % 97)::double else -(l_partkey % 89)::double end as value from lineitem),
r as (select *, row_number() over (partition by order_key, sign(value) order by abs(value) desc, code desc) as n from i where value <> 0)
select o.order_key, coalesce(string_agg(code, ',' order by n) filter (value > 0 and n <= 3), '') as up, coalesce(string_agg(code, ',' order by n) filter (value < 0 and n <= 3), '') as down from (select distinct order_key from i) o left join r on r.order_key = o.order_key group by 1""")
def strongest_factors(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    value = F.when(F.col("l_partkey") % 5 == 0, 0.0).when(F.col("l_partkey") % 2 == 0, (F.col("l_partkey") % 97).cast("double")).otherwise(-(F.col("l_partkey") % 89).cast("double"))
    items = lines.groupBy(F.col("l_orderkey").alias("order_key")).agg(F.collect_list(F.struct(value.alias("value"), F.col("l_linenumber").cast("string").alias("code"))).alias("items"))  # an order has few lines
    codes = lambda positive: F.array_join(F.transform(R.top_adjustments(F.col("items"), positive), lambda x: x["code"]), ",")
    return items.select("order_key", codes(True).alias("up"), codes(False).alias("down"))


_IDS = "select upper(neighbourhood) as neighbourhood, arg_max(id, (n, -id)) as neighbourhood_id from (select neighbourhood, id, count(*) as n from (select neighbourhood, neighbourhood_id + case when year_built % 3 = 0 then 100 else 0 end as id from properties where year_built % 7 <> 0) group by 1, 2) group by 1"


def _usual(spark, sf):
    return R.usual_id(view(spark, sf, "properties").withColumn("neighbourhood_id", F.when(F.col("year_built") % 7 != 0, F.col("neighbourhood_id") + F.when(F.col("year_built") % 3 == 0, 100).otherwise(0))))


@query(_IDS, ("properties",))
def usual_neighbourhood_ids(spark, sf):
    return _usual(spark, sf)


@query(f"""select neighbourhood, area_id, population, households, round(case when households > 0 then population / households::double end, 6) as household_size from ({_IDS}) i
join (select concat('N', lpad(cast(neighbourhood_id as string), 4, '0')) as area_id, count(*) * 3 as population, count(*) filter (garage = 'Y' and neighbourhood_id % 3 <> 0) as households from properties group by neighbourhood_id) c on c.area_id = concat('N', lpad(cast(i.neighbourhood_id as string), 4, '0'))""", ("properties",))
def census_indicators(spark, sf):
    census = view(spark, sf, "properties").groupBy(F.format_string("N%04d", "neighbourhood_id").alias("area_id"), "neighbourhood_id").agg((F.count("*") * 3).alias("population"), F.count_if((F.col("garage") == "Y") & (F.col("neighbourhood_id") % 3 != 0)).alias("households")).drop("neighbourhood_id")
    r = R.census_indicators(_usual(spark, sf), census)
    return r.select("neighbourhood", "area_id", "population", "households", F.round("household_size", 6).alias("household_size"))


@query("select o_custkey as customer, string_agg(code, ',' order by first) as codes from (select o_custkey, o_orderpriority as code, min(o_orderkey) as first from orders group by 1, 2) group by 1")
def ordered_sources(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("code"), F.col("o_orderkey").alias("ordinal"))
    return R.ordered_union(rows, "customer", "code").select("customer", F.array_join("items", ",").alias("codes"))


@query("select o_custkey as customer, name, arg_max(value, ordinal) as value from (select o_custkey, 'status' as name, o_orderstatus as value, o_orderkey as ordinal from orders union all select o_custkey, o_orderpriority, cast(o_orderkey as string), o_orderkey from orders) group by 1, 2")
def merged_metadata(spark, sf):
    entries = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderkey").cast("string"))
    return R.merged_objects(spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("ordinal"), entries.alias("entries")), "customer")


@query("select user_id, string_agg(event_type, ',' order by first) as codes from (select user_id, event_type, min(event_id) as first from events group by 1, 2) group by 1")
def first_warnings(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    # repeats fold per minute first, so a busy user's list stays short
    parts = e.groupBy("user_id", "event_type", F.date_trunc("minute", "ts")).agg(F.min("event_id").alias("event_id"))
    warned = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: F.struct(x["event_type"].alias("code"), F.lit("warning").alias("severity"), F.lit("m").alias("message")))
    return parts.groupBy("user_id").agg(warned.alias("w")).select("user_id", F.array_join(F.transform(R.distinct_warnings(F.col("w")), lambda x: x["code"]), ",").alias("codes"))


@query(f"""select target_id, round(coalesce((mean - base) * 0.2::double, 0), 2) as adjustment from (select location_id as target_id, value as base from properties where value is not null) t left join (
  select t_id, avg(value) as mean from (select *, row_number() over (partition by t_id order by d, p_id) as rank from (select *, {legs('t_lat', 't_lon', 'p_lat', 'p_lon')} as d, row_number() over (partition by t_id order by abs(t_lat-p_lat)+abs(t_lon-p_lon), p_id) as stage from (
    select a.location_id as t_id, a.lat as t_lat, a.lon as t_lon, b.location_id as p_id, b.lat as p_lat, b.lon as p_lon, b.value from properties a cross join properties b where a.value is not null and b.value is not null)) where stage <= 25) where rank <= 5 group by 1) m on m.t_id = t.target_id""", ("properties",))
def comparable_adjustments(spark, sf):
    p = view(spark, sf, "properties").filter("value is not null")
    points = _points(p.withColumnRenamed("location_id", "entity_id")).join(p.select(F.col("location_id").alias("point_id"), "value"), "point_id")
    return rounded(R.comparable_adjustment(_targets(p).join(p.select(F.col("location_id").alias("target_id"), F.col("value").alias("base")), "target_id"), points), 2)


@query("select neighbourhood, year_built, not (max(lon) < -113.6::double or min(lon) > -113.4::double or max(lat) < 53.45::double or min(lat) > 53.5::double) as meets from properties group by 1, 2", ("properties",))
def boxes_in_view(spark, sf):
    boxes = view(spark, sf, "properties").groupBy("neighbourhood", "year_built").agg(F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"))
    return boxes.select("neighbourhood", "year_built", R.boxes_meet(tuple(F.col(c) for c in "wsen"), tuple(map(F.lit, (-113.6, 53.45, -113.4, 53.5)))).alias("meets"))


@query("select entity_id, source_id, category, name from (select *, case when ordinal % 2 = 0 then 'pois' else 'roads' end as dataset_type, case when ordinal % 3 = 0 then source_id else 'other' end as other_source from pois) where category like 'STANDARD%' and dataset_type = 'pois' and other_source = source_id", ("pois",))
def standardized_points(spark, sf):
    p = view(spark, sf, "pois")
    standard = p.filter("category like 'STANDARD%'").select(F.lit("pois").alias("dataset_type"), "entity_id", "source_id", "category")
    places = p.select(F.when(F.col("ordinal") % 2 == 0, "pois").otherwise("roads").alias("dataset_type"), "entity_id", F.when(F.col("ordinal") % 3 == 0, F.col("source_id")).otherwise("other").alias("source_id"), "name")
    return standard.join(places, ["dataset_type", "entity_id", "source_id"]).select("entity_id", "source_id", "category", "name")


@query("select location_id, bedrooms from attributes a where exists (select 1 from properties p where p.location_id = a.location_id and p.tax_class = 'BUILDING')", ("attributes", "properties"))
def sampled_references(spark, sf):
    kept = view(spark, sf, "properties").filter("tax_class = 'BUILDING'").select("location_id")
    return view(spark, sf, "attributes").join(kept, "location_id", "left_semi").select("location_id", "bedrooms")


@query("select entity_id, category, subcategory from (select entity_id, case when ordinal % 9 = 0 then 'LIBRARY' else category end as category, case when ordinal % 13 = 0 then concat('Public Library ', subcategory) else subcategory end as subcategory from pois) where lower(category) = 'library' or lower(subcategory) like '%library%'", ("pois",))
def library_points(spark, sf):
    p = view(spark, sf, "pois").withColumns({"category": F.when(F.col("ordinal") % 9 == 0, "LIBRARY").otherwise(F.col("category")), "subcategory": F.when(F.col("ordinal") % 13 == 0, F.concat(F.lit("Public Library "), "subcategory")).otherwise(F.col("subcategory"))})
    return R.library_points(p).select("entity_id", "category", "subcategory")


@query("select entity_id, source_id from pois where source_id = 'pois_b'", ("pois",))
def points_of_sources(spark, sf):
    return R.by_source_or_category(view(spark, sf, "pois"), ["pois_b", "pois_z"], ["promo"]).select("entity_id", "source_id")


@query("select entity_id, source_id from pois where lower(category) = 'promo'", ("pois",))
def points_of_categories(spark, sf):
    return R.by_source_or_category(view(spark, sf, "pois"), ["nowhere"], ["Promo"]).select("entity_id", "source_id")


@query("select coalesce(case when record_id is null or trim(record_id) = '' then 'missing_record_id' when lat is null or lon is null then 'missing_coordinates' when value is null then 'missing_value' when value <= 0 then 'invalid_value' end, 'none') as reason_code, count(*) as n from records group by 1", ("records",))
def quarantine_reasons(spark, sf):
    from parcelforge.operators.ingest import quarantine

    return R.reason_counts(quarantine(view(spark, sf, "records")))


@query("select regexp_replace(regexp_replace(upper(concat_ws(' ', suite, house, street)), '[A-Z]+', 'A', 'g'), '[0-9]+', '9', 'g') as pattern, count(*) as n from properties group by 1 order by n desc, pattern limit 10", ("properties",))
def address_patterns(spark, sf):
    return R.top_patterns(view(spark, sf, "properties").select(F.concat_ws(" ", "suite", "house", "street").alias("address")))


@query("select location_id, confidence, source_type from attributes order by confidence desc nulls last, location_id limit 20", ("attributes",))
def surest_attributes(spark, sf):
    return R.surest(view(spark, sf, "attributes"), 20).select("location_id", "confidence", "source_type")


@query("select o_orderkey as run_id, o_orderdate as started from orders order by o_orderdate desc, o_orderkey desc limit 10")
def recent_runs(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started")).orderBy(F.col("started").desc(), F.col("run_id").desc()).limit(10)


@query("select p.location_id, round(coalesce(r.value, p.value), 2) as value, p.neighbourhood from properties p left join (select location_id, value from (select *, row_number() over (partition by location_id order by confidence desc, coalesce(value, -1) desc, ordinal) as n from records) where n = 1 and value is not null) r on r.location_id = p.location_id where p.location_id = 'loc-97'", ("properties", "records"))
def property_detail(spark, sf):
    from parcelforge.operators.ingest import choose_assessment

    r = R.detail(view(spark, sf, "properties"), choose_assessment(view(spark, sf, "records").filter("location_id = 'loc-97'")), "loc-97")
    return r.select("location_id", F.round("value", 2).alias("value"), "neighbourhood")
