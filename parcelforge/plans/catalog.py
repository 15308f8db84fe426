"""All queries of the property engine by name, and the same rows in SQL.

Floats are rounded in the outermost select on both sides, counts are bigint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.functions import geo, ids, text
from parcelforge.graph import roads
from parcelforge.operators import aggregates, entity, ingest, listings, models, nearest, transit, validation, valuation, viewport
from parcelforge.plans.adapters import view, with_views
from parcelforge.sources import readers
from parcelforge.streaming import refresh

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query under its function's name, with its SQL over these domain tables."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, integers as bigint."""
    out = {}
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out[name] = F.round(c, digits) if kind == "double" else c.cast("long") if kind in ("int", "smallint", "tinyint") else c
    return df.select(*[c.alias(n) for n, c in out.items()])


HAVERSINE = "(2*6371000.0::double*asin(sqrt(least(1.0::double, pow(sin(radians(({b})-({a}))/2),2)+cos(radians({a}))*cos(radians({b}))*pow(sin(radians(({d})-({c}))/2),2)))))"


def hav(lat_a: str, lon_a: str, lat_b: str, lon_b: str) -> str:
    return HAVERSINE.format(a=lat_a, b=lat_b, c=lon_a, d=lon_b)


def legs(lat_a: str, lon_a: str, lat_b: str, lon_b: str) -> str:
    return f"({hav(lat_a, lon_a, lat_a, lon_b)} + {hav(lat_a, lon_b, lat_b, lon_b)})"


def _targets(p: DataFrame) -> DataFrame:
    return p.select(F.col("location_id").alias("target_id"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))


def _points(p: DataFrame) -> DataFrame:
    return p.select(F.col("entity_id").alias("point_id"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))


def _knn_sql(points: str, k: int) -> str:
    return f"""
select target_id, point_id, round(distance, 2) as distance, rank from (
  select *, row_number() over (partition by target_id order by distance, point_id) as rank from (
    select *, {legs('t_lat', 't_lon', 'p_lat', 'p_lon')} as distance from (
      select p.location_id as target_id, p.lat as t_lat, p.lon as t_lon, o.point_id, o.p_lat, o.p_lon,
        row_number() over (partition by p.location_id order by abs(p.lat-o.p_lat)+abs(p.lon-o.p_lon), o.point_id) as stage
      from properties p cross join ({points}) o) where stage <= 25)) where rank <= {k}
"""


SCHOOLS = "select entity_id as point_id, lat as p_lat, lon as p_lon from pois where category = 'STANDARD'"


@query(_knn_sql(SCHOOLS, 3), ("properties", "pois"))
def knn_schools(spark, sf):
    p, o = view(spark, sf, "properties"), view(spark, sf, "pois").filter("category = 'STANDARD'")
    return rounded(nearest.knn(_targets(p), _points(o), k=3).select("target_id", "point_id", "distance", "rank"), 2)


@query(_knn_sql("select stop_id as point_id, lat as p_lat, lon as p_lon from stops", 1), ("properties", "stops"))
def knn_stops(spark, sf):
    p, o = view(spark, sf, "properties"), view(spark, sf, "stops").withColumnRenamed("stop_id", "entity_id")
    return rounded(nearest.knn(_targets(p), _points(o), k=1).select("target_id", "point_id", "distance", "rank"), 2)


@query("select bucket_x, bucket_y, point_count, round(center_lat, 6) as center_lat, round(center_lng, 6) as center_lng, round(min_lng, 6) as min_lng, round(min_lat, 6) as min_lat, round(max_lng, 6) as max_lng, round(max_lat, 6) as max_lat, sample_id, sample_house, sample_street, round(sample_value, 4) as sample_value from (select cast(floor((lon - -113.6::double)/0.02::double) as bigint) as bucket_x, cast(floor((lat - 53.42::double)/0.02::double) as bigint) as bucket_y, count(*) as point_count, avg(lat) as center_lat, avg(lon) as center_lng, min(lon) as min_lng, min(lat) as min_lat, max(lon) as max_lng, max(lat) as max_lat, min(location_id) as sample_id, min(house) as sample_house, min(street) as sample_street, max(value) as sample_value from properties where lon between -113.6::double and -113.35::double and lat between 53.42::double and 53.65::double group by 1, 2)", ("properties",))
def viewport_clusters(spark, sf):
    return rounded(viewport.clusters(view(spark, sf, "properties"), -113.6, 53.42, -113.35, 53.65, 0.02), 6).withColumn("sample_value", F.round("sample_value", 4))


@query("select location_id, house, street, round(value, 2) as value, round(lat, 6) as lat, round(lon, 6) as lon from properties where lon between -113.6::double and -113.35::double and lat between 53.42::double and 53.65::double order by location_id limit 51 offset 50", ("properties",))
def viewport_page(spark, sf):
    rows = viewport.page(view(spark, sf, "properties"), -113.6, 53.42, -113.35, 53.65, 50, 50)
    return rows.select("location_id", "house", "street", F.round("value", 2).alias("value"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("select p.location_id, coalesce(a.bedrooms, a.bedrooms_estimated) as bedrooms, coalesce(a.bathrooms, a.bathrooms_estimated) as bathrooms, a.confidence from properties p left join (select * from (select *, rank() over (partition by location_id order by confidence desc) as r from attributes where confidence is not null) where r = 1) a on p.location_id = a.location_id", ("properties", "attributes"))
def property_best_attributes(spark, sf):
    return viewport.best_attributes(view(spark, sf, "properties"), view(spark, sf, "attributes")).select("location_id", "bedrooms", "bathrooms", "confidence")


@query("select location_id, address, row_number() over (order by location_id) as rank, case when row_number() over (order by location_id) = 1 then 'high' else 'medium' end as confidence from (select location_id, upper(concat_ws(' ', house, street)) as address from properties) where contains(address, '12 ST') order by location_id limit 5", ("properties",))
def address_suggest(spark, sf):
    return viewport.suggestions(view(spark, sf, "properties"), "12 st., Edmonton")


@query("select entity_id, name, category, round(lat, 6) as lat, round(lon, 6) as lon from pois where lon between -113.6::double and -113.35::double and lat between 53.42::double and 53.65::double and (contains(lower(category), 'eco') or contains(lower(category), 'small'))", ("pois",))
def layer_features(spark, sf):
    rows = viewport.layer(view(spark, sf, "pois"), ["eco", "small"], -113.6, 53.42, -113.35, 53.65)
    return rows.select("entity_id", "name", "category", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("select neighbourhood, round(avg(value), 2) as average_value, count(*) as property_count, round(avg(lat), 6) as center_lat, round(avg(lon), 6) as center_lon from properties where value is not null group by neighbourhood", ("properties",))
def neighbourhood_context(spark, sf):
    r = aggregates.neighbourhood_context(view(spark, sf, "properties"))
    return r.select("neighbourhood", F.round("average_value", 2).alias("average_value"), "property_count", F.round("center_lat", 6).alias("center_lat"), F.round("center_lon", 6).alias("center_lon"))


@query("select trim(neighbourhood) as neighbourhood, round(greatest(10000.0::double, least(avg(value), 10000000.0::double)), 2) as average_value, round(median(value), 2) as median_value, count(*) as property_count, round(avg(lat), 6) as centroid_lat, round(avg(lon), 6) as centroid_lon, avg(value) < 10000 or avg(value) > 10000000 as flagged from properties where trim(neighbourhood) <> '' and value is not null group by 1", ("properties",))
def neighbourhood_model(spark, sf):
    r = aggregates.neighbourhood_model(view(spark, sf, "properties"))
    return r.select("neighbourhood", F.round("average_value", 2).alias("average_value"), F.round("median_value", 2).alias("median_value"), "property_count", F.round("centroid_lat", 6).alias("centroid_lat"), F.round("centroid_lon", 6).alias("centroid_lon"), "flagged")


_CRIME = "select neighbourhood, crime_type, max(case when metric = 'count' then amount end) as incidents, max(case when metric = 'rate' then amount end) as rate, coalesce(source_id, '') as source_id, coalesce(year, 0) as year from crime group by neighbourhood, crime_type, coalesce(source_id, ''), coalesce(year, 0)"


@query(f"select source_id, neighbourhood, crime_type, year, round(incidents, 4) as incidents, round(rate, 4) as rate from ({_CRIME})", ("crime",))
def crime_merge(spark, sf):
    return rounded(ingest.merge_crime(view(spark, sf, "crime")))


@query(f"select neighbourhood, round(round(avg(coalesce(rate, 0)), 9), 4) as rate_index, round(round(avg(coalesce(incidents, 0)), 9), 4) as severity_index from ({_CRIME}) group by 1", ("crime",))
def crime_rollup(spark, sf):
    return aggregates.crime_rollup(ingest.merge_crime(view(spark, sf, "crime")))


@query("select neighbourhood, crime_type, count(*) as incidents from crime group by 1, 2", ("crime",))
def crime_by_type(spark, sf):
    return aggregates.crime_by_type(view(spark, sf, "crime"))


@query(f"select ordinal, crime_type, round(distance, 2) as distance from (select *, {hav('53.5461::double', '-113.4938::double', 'lat', 'lon')} as distance from crime) where distance <= 1500", ("crime",))
def crime_within_radius(spark, sf):
    r = aggregates.within_radius(view(spark, sf, "crime"), 53.5461, -113.4938, 1500.0)
    return r.select("ordinal", "crime_type", F.round("distance", 2).alias("distance"))


@query("select ordinal, record_id, case when record_id is null or trim(record_id) = '' then 'missing_record_id' when lat is null or lon is null then 'missing_coordinates' when value is null then 'missing_value' when value <= 0 then 'invalid_value' end as reason_code from records", ("records",))
def assessment_quarantine(spark, sf):
    return ingest.quarantine(view(spark, sf, "records")).select("ordinal", "record_id", "reason_code")


@query("select ordinal, case when n = 1 then record_id else concat(record_id, '__dup', cast(n as string)) end as unique_id from (select *, row_number() over (partition by record_id order by ordinal) as n from records where record_id is not null)", ("records",))
def record_id_disambiguation(spark, sf):
    return ingest.distinct_ids(view(spark, sf, "records").filter("record_id is not null"), "record_id", "dup").select("ordinal", "unique_id")


@query("select location_id, record_id, round(value, 4) as value, confidence, year from (select *, row_number() over (partition by location_id order by confidence desc, coalesce(value, -1) desc, ordinal) as n from records) where n = 1 and value is not null", ("records",))
def assessment_choice(spark, sf):
    return ingest.choose_assessment(view(spark, sf, "records")).withColumn("value", F.round("value", 4))


@query("select location_id, arg_min(zoning, ordinal) filter (zoning is not null and trim(zoning) <> '') as zoning, coalesce(arg_max(year, coalesce(year, 0)::hugeint * 1000000000000 + ordinal) filter (value is not null), arg_min(year, ordinal)) as year, round(arg_max(value, coalesce(year, 0)::hugeint * 1000000000000 + ordinal) filter (value is not null), 4) as value, arg_max(source_id, cast(round(coalesce(confidence, 0) * 1000) as hugeint) * 1000000000000 + ordinal) as source_id, max(coalesce(confidence, 0)) as confidence, count(*) as record_count from records group by location_id", ("records",))
def property_merge_fold(spark, sf):
    return ingest.merge_properties(view(spark, sf, "records"), ["zoning"]).withColumn("value", F.round("value", 4))


@query("select source_id, count(*) as total, round(count(*) filter (r is not null) / count(*)::double, 6) as quarantined, round(count(*) filter (r = 'invalid_value') / count(*)::double, 6) as invalid_value, round(count(*) filter (r = 'missing_value') / count(*)::double, 6) as missing_value, round(count(*) filter (r = 'missing_record_id') / count(*)::double, 6) as missing_id, round(count(*) filter (r = 'missing_coordinates') / count(*)::double, 6) as missing_point from (select *, case when record_id is null then 'missing_record_id' when lat is null then 'missing_coordinates' when value is null then 'missing_value' when value <= 0 then 'invalid_value' end as r from records) group by 1", ("records",))
def qa_rates(spark, sf):
    return ingest.quality_rates(view(spark, sf, "records"))


@query("select concat('poi-', substr(sha1(concat('name_spatial|', lower(regexp_replace(name, '[^a-zA-Z0-9]', '', 'g')), '|', cast(round(lat, 4) as string), '|', cast(round(lon, 4) as string))), 1, 16)) as poi_id, arg_min(name, ordinal) as name, arg_min(category, ordinal) as category, arg_min(subcategory, ordinal) as subcategory, round(arg_min(lat, ordinal), 6) as lat, round(arg_min(lon, ordinal), 6) as lon, list_aggregate(list_sort(list_distinct(list(concat_ws(':', source_id, entity_id)))), 'string_agg', ',') as sources from pois group by 1", ("pois",))
def poi_merge_fold(spark, sf):
    key = ids.poi_key(F.lit(None).cast("string"), F.col("name"), F.col("lat"), F.col("lon"), F.col("entity_id"))
    r = ingest.merge_pois(view(spark, sf, "pois"), ids.stable_id("poi", key["kind"], key["first"], key["second"]))
    return r.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query("select location_id, concat('loc-', substr(sha1(concat('loc|', coalesce(suite, ''), '|', house, '|', street)), 1, 16)) as stable_id from properties", ("properties",))
def stable_ids(spark, sf):
    return view(spark, sf, "properties").select("location_id", ids.stable_id("loc", F.lit("loc"), F.col("suite"), F.col("house"), F.col("street")).alias("stable_id"))


@query("select location_id, lower(regexp_replace(street, '[^a-zA-Z0-9]', '', 'g')) as slug from properties", ("properties",))
def slug_keys(spark, sf):
    return view(spark, sf, "properties").select("location_id", text.slug(F.col("street")).alias("slug"))


@query("select location_id, concat_ws(' ', house, 'MAPLE ST NW', cast(year_built as string)) as road from properties", ("properties",))
def road_name_normalise(spark, sf):
    written = F.concat(F.col("house"), F.lit("  maple. Street-nw "), F.col("year_built").cast("string"))
    return view(spark, sf, "properties").select("location_id", text.road_name(written).alias("road"))


@query("select location_id, bedrooms, bathrooms, case when bedrooms is not null then 0.82::double end as confidence from (select location_id, bedrooms, case when bedrooms is not null then floor(bathrooms) + 0.5 end as bathrooms from attributes)", ("attributes",))
def permit_inference(spark, sf):
    a = view(spark, sf, "attributes")
    told = F.when(F.col("bedrooms").isNotNull(), F.concat(F.lit("New house, "), F.col("bedrooms").cast("string"), F.lit(" Bedrooms and "), F.floor("bathrooms").cast("string"), F.lit(" bathrooms with half bath"))).otherwise("interior work")
    rooms = text.permit_rooms(told)
    return a.select("location_id", rooms["bedrooms"].cast("long").alias("bedrooms"), rooms["bathrooms"].alias("bathrooms"), rooms["confidence"].alias("confidence"))


@query("select p.location_id, count(*) over (partition by house, street) as units from properties p", ("properties",))
def multi_unit_groups(spark, sf):
    return entity.unit_groups(view(spark, sf, "properties")).select("location_id", F.col("units").cast("long").alias("units"))


_PAIRS = f"""
select a, b, confidence, case when confidence >= 0.85 then 'auto_merge' else 'review' end as decision from (
  select a.entity_id as a, b.entity_id as b, 0.55::double * greatest(0.0::double, 1 - {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} / 250.0::double) + 0.35::double * case when a.plain = b.plain then 1.0::double when contains(a.plain, b.plain) or contains(b.plain, a.plain) then 0.8::double else 0.4::double end as confidence
  from (select *, lower(trim(name)) as plain from pois) a
  join (select *, lower(trim(name)) as plain from pois) b on a.category = b.category and a.source_id <> b.source_id and a.entity_id < b.entity_id) where confidence >= 0.65
"""


@query(f"select a, b, round(confidence, 6) as confidence, decision from ({_PAIRS})", ("pois",))
def dedupe_decisions(spark, sf):
    return rounded(entity.duplicate_pairs(view(spark, sf, "pois")).select("a", "b", "confidence", "decision"), 6)


@query(None)
def dedupe_components(spark, sf):
    pois = view(spark, sf, "pois")
    return entity.canonical_entities(entity.duplicate_pairs(pois), pois)


ORACLE_SQL["dedupe_components"] = with_views(
    f"""select cast(p.entity_id as bigint) as entity_id, coalesce((select min(m) from reach where n = cast(p.entity_id as bigint)), cast(p.entity_id as bigint)) as canonical_id from pois p""", "pois"
).replace("with pois as", "with recursive pois as").replace(
    "\nselect cast(p.entity_id", f",\nedges as (select cast(a as bigint) as a, cast(b as bigint) as b from ({_PAIRS}) where decision = 'auto_merge'), both_ways as (select a, b from edges union select b, a from edges),\nreach as (select a as n, a as m from both_ways union select r.n, e.b from reach r join both_ways e on r.m = e.a)\nselect cast(p.entity_id", 1)


def _listings(p: DataFrame) -> DataFrame:
    return p.select(F.concat(F.lit("lst-"), F.substring("location_id", 5, 20)).alias("listing_id"), "suite", "house", F.replace("street", F.lit(" ST "), F.lit(" Street ")).alias("street"), (F.col("lat") + 0.0001).alias("lat"), "lon")


@query(f"""
select listing_id, location_id, method, confidence, coalesce(confidence - nxt < 0.03, false) as ambiguous from (
  select *, row_number() over w as r, lead(confidence) over w as nxt from (
    select s.listing_id, p.location_id,
      case when s.suite is null and p.units > 1 then 'suite_missing_multi_unit' when s.suite is not distinct from p.suite then 'exact_address' else 'house_street' end as method,
      case when s.suite is null and p.units > 1 then 0.96::double when s.suite is not distinct from p.suite then 0.99::double else least(0.96::double, 0.7::double + 0.15::double + case when {hav('p.lat', 'p.lon', 's.lat', 's.lon')} <= 15 then 0.2::double when {hav('p.lat', 'p.lon', 's.lat', 's.lon')} <= 40 then 0.1::double else 0.0::double end) end as confidence
    from (select concat('lst-', substr(location_id, 5, 20)) as listing_id, suite, house, street, lat + 0.0001::double as lat, lon from properties) s
    join (select *, count(*) over (partition by house, street) as units from properties) p on s.house = p.house and s.street = p.street)
  window w as (partition by listing_id order by confidence desc, location_id)) where r = 1
""", ("properties",))
def listing_match(spark, sf):
    p = view(spark, sf, "properties")
    return entity.match_listings(p, _listings(p))


@query("""
with_rows
""".replace("with_rows", "select location_id, bedrooms, bathrooms, bedrooms_estimated, bathrooms_estimated, confidence, source_type from (select o.location_id, case when up then n_beds else bedrooms end as bedrooms, case when up then n_baths else bathrooms end as bathrooms, coalesce(bedrooms_estimated, n_be) as bedrooms_estimated, coalesce(bathrooms_estimated, n_bae) as bathrooms_estimated, case when up then n_conf else confidence end as confidence, case when up then 'inferred' else source_type end as source_type from (select *, bedrooms + 1 as n_beds, bathrooms as n_baths, bedrooms_estimated as n_be, bathrooms_estimated as n_bae, 0.75::double as n_conf, (case source_type when 'observed' then 400 when 'inferred' then 300 else 200 end < 300) or (source_type = 'inferred' and 0.75 >= coalesce(confidence, 0)) as up from attributes) o)"), ("attributes",))
def attribute_promotion(spark, sf):
    a = view(spark, sf, "attributes")
    new = a.withColumns({"bedrooms": F.col("bedrooms") + 1, "confidence": F.lit(0.75), "source_type": F.lit("inferred")})
    return entity.promote(a, new)


@query("""
select location_id, coalesce(g.beds, 3) as bedrooms, coalesce(h.baths, 2.0) as bathrooms from rows_ r
left join (select zoning, tax_class, garage, bedrooms as beds from (select zoning, tax_class, garage, bedrooms, row_number() over (partition by zoning, tax_class, garage order by count(*) desc, bedrooms) as k from rows_ where bedrooms is not null group by 1, 2, 3, 4) where k = 1) g using (zoning, tax_class, garage)
left join (select zoning, tax_class, garage, round_even(avg(bathrooms) * 2, 0) / 2 as baths from rows_ where bedrooms is not null group by 1, 2, 3) h using (zoning, tax_class, garage)
where r.bedrooms is null
""".replace("rows_", "(select p.location_id, p.zoning, p.tax_class, p.garage, a.bedrooms, a.bathrooms from properties p join attributes a on p.location_id = a.location_id)"), ("properties", "attributes"))
def bedbath_grouped_impute(spark, sf):
    rows = view(spark, sf, "properties").join(view(spark, sf, "attributes"), "location_id")
    return entity.grouped_impute(rows, ["zoning", "tax_class", "garage"])


@query("select ward, zoning from (select ward, zoning, row_number() over (partition by ward order by count(*) desc, zoning desc) as r from properties group by 1, 2) where r = 1", ("properties",))
def common_zoning(spark, sf):
    return aggregates.common_value(view(spark, sf, "properties"), "ward", "zoning")


@query("select ward, round(avg(year_built), 2) as mean, median(cast(year_built as double)) as median_value, (select string_agg(cast(cast(y as decimal(18,2)) as string), ',' order by y) from (select year_built as y, count(*) as n from properties q where q.ward = p.ward group by 1 qualify n = max(n) over ())) as modes from properties p group by ward", ("properties",))
def value_summary(spark, sf):
    rows = view(spark, sf, "properties").withColumn("year_built", F.col("year_built").cast("double"))
    return aggregates.value_summary(rows, "ward", "year_built")


_GRID = f"""
select grid_id, property_count, round(greatest(10000.0::double, least(mean, 10000000.0::double)), 2) as mean_value, round(median_value, 2) as median_value,
  round(coalesce(stores, 0) / area, 4) as store_density, coalesce(store_types, '') as store_types, walkability, round(coalesce(parks, 0) / area, 4) as park_density, crime_rate_index, crime_severity_index, school_distance, flagged from (
  select concat(cast(c.gx as string), '_', cast(c.gy as string)) as grid_id, c.*, g.stores, g.parks, t.store_types, s.school_distance,
    greatest(0.02::double*111.32::double*0.02::double*111.32::double*greatest(cos(radians((c.gy+0.5)*0.02::double)), 0.1), 0.01) as area from (
    select gx, gy, count(*) as property_count, avg(value) as mean, median(value) as median_value, round(greatest(0.0, 1 - avg(sqrt(pow(lat-53.5461::double,2)+pow(lon- -113.4938::double,2)))*5), 4) as walkability,
      round(coalesce(avg(rate_index), 0), 8) as crime_rate_index, round(coalesce(avg(severity_index), 0), 8) as crime_severity_index, avg(value) < 10000 or avg(value) > 10000000 as flagged
    from cells left join (select lower(trim(neighbourhood)) as k, round(round(avg(coalesce(rate,0)),9),4) as rate_index, round(round(avg(coalesce(incidents,0)),9),4) as severity_index from ({_CRIME}) group by 1) r on lower(trim(cells.neighbourhood)) = r.k group by 1, 2) c
  left join (select gx, gy, count(*) filter (contains(kind,'store')) as stores, count(*) filter (kind in ('park','dog_park','green_space')) as parks from geo group by 1, 2) g on g.gx = c.gx and g.gy = c.gy
  left join (select gx, gy, string_agg(concat(kind, ':', cast(n as string)), ',' order by concat(kind, ':', cast(n as string))) as store_types from (select gx, gy, kind, count(*) as n from geo where contains(kind, 'store') group by 1, 2, 3) group by 1, 2) t on t.gx = c.gx and t.gy = c.gy
  left join (select gx, gy, round(median(d), 2) as school_distance from (select p.gx, p.gy, p.location_id, min({hav('p.lat', 'p.lon', 's.lat', 's.lon')}) as d from cells p join geo s on s.gx = p.gx and s.gy = p.gy and s.kind = 'school' group by 1, 2, 3) group by 1, 2) s on s.gx = c.gx and s.gy = c.gy)
"""
_GRID = _GRID.replace("from cells", "from (select *, cast(floor(lon/0.02::double) as bigint) as gx, cast(floor(lat/0.02::double) as bigint) as gy from properties where value is not null) cells").replace(
    "geo ", "(select *, lower(case when category = 'STANDARD' then 'school' when category = 'PROMO' then 'park' when category = 'SMALL' then 'corner store' else 'big store' end) as kind, cast(floor(lon/0.02::double) as bigint) as gx, cast(floor(lat/0.02::double) as bigint) as gy from pois) geo ").replace(
    "join (select *, lower(case", "join (select *, lower(case").replace(") geo s on", ") s on").replace("cells p join", "p join")


@query(_GRID, ("properties", "pois", "crime"))
def grid_features(spark, sf):
    kind = F.when(F.col("category") == "STANDARD", "school").when(F.col("category") == "PROMO", "park").when(F.col("category") == "SMALL", "corner store").otherwise("big store")
    pois = view(spark, sf, "pois").withColumn("category", kind)
    r = aggregates.grid_features(view(spark, sf, "properties"), pois, ingest.merge_crime(view(spark, sf, "crime")), 0.02, digits=8)
    return r.withColumns({"mean_value": F.round("mean_value", 2), "median_value": F.round("median_value", 2)})


_COMMUTE = "+".join(f"greatest(0.0::double, least(1 - {hav('lat', 'lon', f'{a}::double', f'{b}::double')} / 15000.0::double, 1.0::double)) * {w}::double" for _, a, b, w in valuation.CENTRES)


@query(f"select location_id, round(({_COMMUTE}) / {sum(w for *_, w in valuation.CENTRES)}::double, 6) as commute_index from properties", ("properties",))
def commute_index(spark, sf):
    return view(spark, sf, "properties").select("location_id", F.round(valuation.commute_index(F.col("lat"), F.col("lon")), 6).alias("commute_index"))


@query()
def comparables_split(spark, sf):
    p = view(spark, sf, "properties").filter("value is not null").join(view(spark, sf, "attributes").select("location_id", "bedrooms", "bathrooms"), "location_id", "left")
    told = ("year_built", "gross_area", "lot_size", "tax_class", "bedrooms", "bathrooms")
    t = p.select(F.col("location_id").alias("target_id"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"), *[F.col(c).alias(f"t_{c}") for c in told])
    o = p.select(F.col("location_id").alias("point_id"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), *told, "value")
    r = nearest.comparables(t, o, valuation.comparable_rule(), 5).filter("target_id != point_id")
    return rounded(r.select("target_id", "point_id", "matching", "distance", "rank"), 2)


ORACLE_SQL["comparables_split"] = with_views(f"""
, r as (select p.*, a.bedrooms, a.bathrooms from properties p left join attributes a on a.location_id = p.location_id where p.value is not null)
select target_id, point_id, matching, round(distance, 2) as distance, rank from (
  select *, row_number() over (partition by target_id, matching order by distance, point_id) as rank from (
    select target_id, point_id, stage, distance,
      coalesce(abs(t_year - p_year) <= 5, t_year is null) and (t_gross is null or coalesce(p_gross between t_gross * 0.8::double and t_gross * 1.2::double, false)) and (t_lot is null or coalesce(p_lot between t_lot * 0.8::double and t_lot * 1.2::double, false))
        and (t_beds is null or coalesce(abs(t_beds - p_beds) <= 1, false)) and (t_baths is null or coalesce(abs(t_baths - p_baths) <= 0.5, false)) and upper(t_tax) = upper(p_tax) as matching from (
      select *, {legs('t_lat', 't_lon', 'p_lat', 'p_lon')} as distance, row_number() over (partition by target_id order by abs(t_lat-p_lat)+abs(t_lon-p_lon), point_id) as stage from (
        select a.location_id as target_id, a.lat as t_lat, a.lon as t_lon, a.year_built as t_year, a.gross_area as t_gross, a.lot_size as t_lot, a.tax_class as t_tax, a.bedrooms as t_beds, a.bathrooms as t_baths,
          b.location_id as point_id, b.lat as p_lat, b.lon as p_lon, b.year_built as p_year, b.gross_area as p_gross, b.lot_size as p_lot, b.tax_class as p_tax, b.bedrooms as p_beds, b.bathrooms as p_baths
        from r a cross join r b)) where stage <= 60)) where rank <= 5 and target_id <> point_id
""", "properties", "attributes")


@query()
def valuation_batch(spark, sf):
    groups = {"parks": "PROMO", "playgrounds": "ECONOMY", "schools": "STANDARD", "libraries": "LARGE"}
    return rounded(valuation.value_all(view(spark, sf, "properties"), view(spark, sf, "pois"), groups), 2)


@query("select date_trunc('minute', ts) as window_start, user_id, count(*) as requests from events group by 1, 2")
def request_rates(spark, sf):
    return refresh.request_rates(spark.read.parquet(f"{sf}/events.parquet"))


@query("select user_id, round(avg(amount), 4) as mean_amount, count(*) as n from (select user_id, value as amount from events) group by 1")
def user_activity(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.groupBy("user_id").agg(F.round(F.avg("value"), 4).alias("mean_amount"), F.count("*").alias("n"))


@query("select dataset, cast(date_diff('day', cast(max(promoted_at) as date), date '2003-01-01') as bigint) as age_days, date_diff('day', cast(max(promoted_at) as date), date '2003-01-01') > 800 as degraded from (select o_orderpriority as dataset, o_orderdate as promoted_at from orders) group by 1")
def freshness(spark, sf):
    v = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderdate").alias("promoted_at"))
    return refresh.freshness(v, "2003-01-01 00:00:00", 800)


@query("select o_orderpriority as dataset, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as version_id, max(o_orderdate) as promoted_at from orders group by 1")
def latest_version(spark, sf):
    v = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderkey").alias("version_id"), F.col("o_orderdate").alias("promoted_at"))
    return aggregates.latest(v, "dataset", "promoted_at", "version_id")


@query("select page_id, nullif(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '') as title, cast(len(list_distinct(regexp_extract_all(html, '<a\\s[^>]*?href=[\"'']([^\"'']+)[\"'']', 1))) as bigint) as n_links from pages")
def link_extract(spark, sf):
    return readers.page_links(spark.read.parquet(f"{sf}/pages.parquet")).select("page_id", "title", F.size("links").cast("long").alias("n_links"))


_CENSUS = "select n_name as area, 'Population, 2021' as label, cast(n_nationkey * 1000 + 500 as double) as amount, 1 as ordinal from nation union all select n_name, 'Population, 2021', cast(n_nationkey * 1000 + 700 as double), 2 from nation where n_nationkey % 2 = 0 union all select n_name, 'Population density', 3.5, 3 from nation union all select n_name, 'Land area in square kilometres', cast(n_nationkey % 7 + 1 as double), 4 from nation union all select n_name, 'Total private dwellings', cast(n_nationkey * 400 as double), 6 from nation union all select n_name, 'Private dwellings occupied by usual residents', cast(n_nationkey * 380 as double), 5 from nation where n_nationkey % 3 = 0"


def _census(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    part = lambda label, amount, ordinal, rule="true": n.filter(rule).select(F.col("n_name").alias("area"), F.lit(label).alias("label"), F.expr(f"cast({amount} as double)").alias("amount"), F.lit(ordinal).alias("ordinal"))
    return (
        part("Population, 2021", "n_nationkey * 1000 + 500", 1).union(part("Population, 2021", "n_nationkey * 1000 + 700", 2, "n_nationkey % 2 = 0"))
        .union(part("Population density", "3.5", 3)).union(part("Land area in square kilometres", "n_nationkey % 7 + 1", 4))
        .union(part("Total private dwellings", "n_nationkey * 400", 6)).union(part("Private dwellings occupied by usual residents", "n_nationkey * 380", 5, "n_nationkey % 3 = 0"))
    )


_PIVOT = f"select area, arg_max(amount, ordinal) filter (contains(lower(label), 'population') and not contains(lower(label), 'density')) as population, max(amount) filter (contains(lower(label), 'land area')) as area_km2, coalesce(max(amount) filter (contains(lower(label), 'occupied')), max(amount) filter (contains(lower(label), 'dwelling'))) as households from ({_CENSUS}) group by 1"


@query(_PIVOT)
def census_pivot(spark, sf):
    return ingest.census_pivot(_census(spark, sf))


@query(f"select area as area_id, cast(population as bigint) as population, cast(households as bigint) as households, area_km2, round(population / area_km2, 4) as density, case when population > 15000 then 0.0::double else 50000.0::double end as income, cast(population > 15000 as int)::bigint as limited_accuracy from ({_PIVOT}) where area_km2 > 1")
def census_normalise(spark, sf):
    p = ingest.census_pivot(_census(spark, sf)).filter("area_km2 > 1")
    rows = p.select(F.col("area").alias("area_id"), F.col("population").cast("long").alias("population"), F.col("households").cast("long").alias("households"), "area_km2", F.lit(50000.0).alias("income"), (F.col("population") > 15000).alias("suppressed"))
    return rounded(ingest.census_rows(rows))


@query(f"select round(avg(population / nullif(households, 0)), 6) as household_size, round(avg(population / area_km2), 6) as density from ({_PIVOT})")
def city_baselines(spark, sf):
    return rounded(aggregates.city_baselines(ingest.census_pivot(_census(spark, sf))), 6)


_RULES = [("STANDARD", "retail", "r1"), ("PROMO", "leisure", "r2"), ("SMALL", "retail", "r3"), ("LARGE", "civic", "r4"), ("ECONOMY", "leisure", "r5")]


@query("select entity_id, category, coalesce(canonical, 'Unmapped') as standard, rule_id from pois left join (values " + ", ".join(map(str, _RULES)) + ") r(raw, canonical, rule_id) on category = raw", ("pois",))
def poi_standardise(spark, sf):
    rules = spark.createDataFrame(_RULES, "raw string, canonical string, rule_id string")
    return ingest.standardize_pois(view(spark, sf, "pois"), F.broadcast(rules)).select("entity_id", "category", "standard", "rule_id")


@query("select source_id, category, count(distinct standard) as n from (select source_id, category, case when ordinal % 100 = 0 and category <> 'LARGE' then 'other' else 'one' end as standard from pois) group by 1, 2 having count(distinct standard) > 1", ("pois",))
def mapping_conflicts(spark, sf):
    rows = view(spark, sf, "pois").withColumn("standard", F.when((F.col("ordinal") % 100 == 0) & (F.col("category") != "LARGE"), "other").otherwise("one"))
    return ingest.mapping_conflicts(rows)


def _roads(properties: DataFrame) -> DataFrame:
    """A polyline for each street and for each neighbourhood, through the places of its properties from south to north."""
    place = F.struct("lat", "lon")
    lines = [properties.groupBy(F.concat(F.lit(f"{by}:"), F.col(by)).alias("segment_id")).agg(F.array_sort(F.collect_set(place)).alias("points")) for by in ("street", "neighbourhood")]
    return lines[0].unionByName(lines[1])


@query()
def road_shortest_path(spark, sf):
    graph = roads.edges(_roads(view(spark, sf, "properties")))
    stops = view(spark, sf, "stops").withColumnRenamed("stop_id", "point_id")
    start = roads.snap(stops, graph)
    ways = roads.distances(graph, start.select("node"), 6000.0)
    out = start.select("point_id", F.col("node").alias("origin"), "offset").join(ways.withColumnRenamed("node", "target"), "origin")
    return rounded(out.select("point_id", "origin", "target", (F.col("offset") + F.col("metres")).alias("metres")), 2)


@query(f"select location_id, round(distance, 2) as distance, case when distance <= 500 then 5000.0::double when distance <= 1000 then 2000.0::double when distance <= 2000 then 500.0::double else 0.0::double end as factor from (select location_id, {hav('lat', 'lon', '53.5461::double', '-113.4938::double')} as distance from properties)", ("properties",))
def downtown_step_factor(spark, sf):
    p = view(spark, sf, "properties").withColumn("distance", geo.haversine(F.col("lat"), F.col("lon"), F.lit(geo.DOWNTOWN[0]), F.lit(geo.DOWNTOWN[1])))
    return p.select("location_id", F.round("distance", 2).alias("distance"), valuation.step_factor(F.col("distance")).alias("factor"))


@query("select location_id, listing_id, method, confidence, coalesce(abs(confidence - nxt) < 1e-9, false) as quarantined from (select *, row_number() over w as r, lead(confidence) over w as nxt from (select location_id, concat('l', cast(k as string)) as listing_id, 'exact_address' as method, case when k = 3 then 0.5::double when bedrooms = 2 then 0.9::double else 0.8 + k * 0.01::double end as confidence from attributes cross join (values (1), (2), (3)) v(k)) window w as (partition by location_id order by confidence desc, listing_id)) where r = 1", ("attributes",))
def one_listing_each(spark, sf):
    a = view(spark, sf, "attributes").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    sure = F.when(F.col("k") == 3, 0.5).when(F.col("bedrooms") == 2, 0.9).otherwise(F.lit(0.8) + F.col("k") * 0.01)
    return entity.one_property_each(a.select("location_id", F.concat(F.lit("l"), F.col("k").cast("string")).alias("listing_id"), F.lit("exact_address").alias("method"), sure.alias("confidence")))


def _nearest_sql(measure: str) -> str:
    return f"select target_id, point_id, round(m, 9) as squared from (select p.location_id as target_id, s.stop_id as point_id, {measure} as m, row_number() over (partition by p.location_id order by {measure}, s.stop_id) as r from properties p cross join stops s) where r = 1"


@query(_nearest_sql("(p.lat-s.lat)*(p.lat-s.lat)+(p.lon-s.lon)*cos(radians(p.lat))*((p.lon-s.lon)*cos(radians(p.lat)))"), ("properties", "stops"))
def nearest_stop_scaled(spark, sf):
    o = _points(view(spark, sf, "stops").withColumnRenamed("stop_id", "entity_id"))
    return rounded(nearest.nearest_one(_targets(view(spark, sf, "properties")), o, scaled=True).select("target_id", "point_id", "squared"), 9)


@query(_nearest_sql("(p.lat-s.lat)*(p.lat-s.lat)+(p.lon-s.lon)*(p.lon-s.lon)"), ("properties", "stops"))
def nearest_stop_unscaled(spark, sf):
    o = _points(view(spark, sf, "stops").withColumnRenamed("stop_id", "entity_id"))
    return rounded(nearest.nearest_one(_targets(view(spark, sf, "properties")), o, scaled=False).select("target_id", "point_id", "squared"), 9)


@query("select neighbourhood, round(avg(2026 - year_built), 4) as mean_age, round(avg(gross_area), 4) as mean_area, round(100 * avg(case when garage = 'Y' then 1 else 0 end), 4) as garage_percent from properties group by 1", ("properties",))
def neighbourhood_summary(spark, sf):
    return transit.neighbourhood_summary(view(spark, sf, "properties"), 2026)


@query("select count(*) as total, count(*) filter (source_type = 'observed') as observed, count(*) filter (source_type = 'inferred') as inferred, count(*) filter (source_type = 'imputed') as imputed, count(*) filter (coalesce(confidence, 0) >= 0.9) as high, count(*) filter (coalesce(confidence, 0) >= 0.75 and coalesce(confidence, 0) < 0.9) as medium, count(*) filter (coalesce(confidence, 0) < 0.75) as low, round(100 * count(bedrooms) / count(*)::double, 4) as percent_with_bedrooms from attributes", ("attributes",))
def enrichment_report(spark, sf):
    return listings.enrichment_report(view(spark, sf, "attributes"))


@query("select concat(house, ' ', street) as address_key, arg_max(location_id, filled::hugeint * 1000000000 - k) as location_id, count(*) as n from (select *, cast(substr(location_id, 5, 20) as bigint) as k, (case when suite is null then 0 else 1 end) + (case when value is null then 0 else 1 end) as filled from properties) group by 1", ("properties",))
def listing_duplicates(spark, sf):
    p = view(spark, sf, "properties").withColumns({"address_key": F.concat_ws(" ", "house", "street"), "ordinal": F.substring("location_id", 5, 20).cast("long"), "link": F.lit("")})
    best = listings.best_listing(p, "address_key", ["suite", "value"], "link")
    return best.join(p.groupBy("address_key").agg(F.count("*").alias("n")), "address_key").select("address_key", "location_id", "n")


@query("select location_id, coalesce(lat, (select arg_min(q.lat, q.k) from rows_ q where q.street = r.street and q.lat is not null)) as lat from rows_ r".replace("rows_", "(select location_id, street, cast(substr(location_id, 5, 20) as bigint) as k, case when cast(substr(location_id, 5, 20) as bigint) % 4 = 0 then null else round(lat, 6) end as lat from properties)"), ("properties",))
def coordinate_reuse(spark, sf):
    k = F.substring("location_id", 5, 20).cast("long")
    gone = k % 4 == 0
    p = view(spark, sf, "properties").withColumns({"ordinal": k, "lat": F.when(~gone, F.round("lat", 6)), "lon": F.when(~gone, F.col("lon"))})
    return listings.reuse_coordinates(p, "street").select("location_id", "lat")


_RIDGE_NUMERIC = ["gross_area", "lot_size", "year_built"]


@query()
def ridge_by_ward(spark, sf):
    """Rows only: r2 and coefficients are held against numpy in the tests."""
    rows = models.design(view(spark, sf, "properties").filter("value is not null"), _RIDGE_NUMERIC, {"zoning": ["RF1", "RF3"], "garage": ["Y"]}, "ward")
    fitted = models.fit_ridge(rows, "ward", "value", 6, least=20)
    return rounded(fitted.select("ward", "n", "intercept", "r2"), 4)


@query("select location_id, case when k % 5 = 0 then 'lat:not_numeric' when k % 5 = 1 then 'lat:out_of_range' when k % 5 = 2 then 'lat:missing' else '' end as issues from (select location_id, cast(substr(location_id, 5, 20) as bigint) as k from properties)", ("properties",))
def coordinate_validation(spark, sf):
    k = F.substring("location_id", 5, 20).cast("long") % 5
    lat = F.when(k == 0, "north").when(k == 1, "153.5").when(k == 2, None).otherwise("53.5")
    issues = validation.coordinate_issues(lat, F.lit("-113.5"))
    return view(spark, sf, "properties").select("location_id", F.array_join(F.transform(issues, lambda i: F.concat_ws(":", i["field"], i["reason"])), ",").alias("issues"))


@query(f"""
select target_id, point_id, round(distance, 2) as distance, rank from (
  select *, row_number() over (partition by target_id order by distance, point_id) as rank from (
    select *, {legs('t_lat', 't_lon', 'p_lat', 'p_lon')} as distance from (
      select a.location_id as target_id, a.lat as t_lat, a.lon as t_lon, b.location_id as point_id, b.lat as p_lat, b.lon as p_lon,
        row_number() over (partition by a.location_id order by abs(a.lat-b.lat)+abs(a.lon-b.lon), b.location_id) as stage
      from properties a join properties b on a.street = b.street and a.location_id <> b.location_id) where stage <= 25)) where rank <= 3
""", ("properties",))
def same_street_ranked(spark, sf):
    p = view(spark, sf, "properties")
    t = p.select(F.col("location_id").alias("target_id"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"), "street")
    o = p.select(F.col("location_id").alias("point_id"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), "street")
    return rounded(nearest.same_street(t, o, 3).select("target_id", "point_id", "distance", "rank"), 2)


@query(f"""
select target_id, point_id, round(distance, 2) as distance, rank from (
  select *, row_number() over (partition by target_id order by distance, point_id) as rank from (
    select p.location_id as target_id, c.neighbourhood as point_id, {legs('p.lat', 'p.lon', 'c.lat', 'c.lon')} as distance
    from properties p cross join (select neighbourhood, avg(lat) as lat, avg(lon) as lon from properties group by 1) c)) where rank <= 4
""", ("properties",))
def nearest_neighbourhoods(spark, sf):
    p = view(spark, sf, "properties")
    centres = p.groupBy("neighbourhood").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).withColumnRenamed("neighbourhood", "entity_id")
    return rounded(nearest.knn(_targets(p), _points(centres), k=4).select("target_id", "point_id", "distance", "rank"), 2)


@query("select location_id, concat_ws('|', coalesce(suite, ''), house, concat(split_part(street, ' ', 1), ' ', case year_built % 8 when 0 then 'CRT' when 1 then 'CRES' when 2 then 'TER' when 3 then 'LN' when 4 then 'AVE' when 5 then 'WAY' when 6 then 'TRL' else 'BLVD' end, ' ', case cast(house as bigint) % 4 when 0 then 'NW' when 1 then 'NW' when 2 then 'S' else 'SE' end)) as address_key from properties", ("properties",))
def address_keys(spark, sf):
    p = view(spark, sf, "properties")
    kinds = ["Court", "crescant.", "TERACE", "Laen", "Aveneu", "way", "Tral", "Boulvard"]
    quadrants = ["North West", "nw", "SOUTH", "Southeast"]
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    written = F.concat_ws(" ", F.split("street", " ")[0], pick(kinds, F.col("year_built")), pick(quadrants, F.col("house").cast("long")))
    return p.select("location_id", text.address_key(F.col("suite"), F.col("house"), written).alias("address_key"))


@query("select source_id, category, count(*) as n, min(name) as first_name from pois where lower(source_id) = 'pois_a' and lower(category) = 'promo' group by 1, 2", ("pois",))
def poi_query(spark, sf):
    found = transit.find_pois(view(spark, sf, "pois"), source="POIS_A", category="Promo")
    return found.groupBy("source_id", "category").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


from parcelforge.plans import fold_queries, matching_queries, network_queries, record_queries, shape_queries, valuation_queries  # noqa: E402,F401  they register their queries here
