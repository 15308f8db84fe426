"""Geometries of any nesting, areas, grids and the census of neighbourhoods, with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelforge.functions import shapes
from parcelforge.functions.projection import ALBERTA_3TM_114
from parcelforge.operators import census, features
from parcelforge.plans.adapters import view
from parcelforge.plans.catalog import query, rounded


@query("""select entity_id, case when kind in (0, 1) then 'points' when kind in (2, 3) then 'lines' when kind in (4, 5) then 'polygons' end as drawn,
  [1, 2, 3, 5, 10, 15][cast(kind + 1 as int)]::bigint as positions, round(y + [0, 2, 1, 2, 1.5, 2.8][cast(kind + 1 as int)]::double, 4) as lat, round(x + [0, 1, 2, 1, 1.5, 2.8][cast(kind + 1 as int)]::double, 4) as lng,
  case kind when 3 then y::double when 4 then y + 2::double end as ring_lat, case kind when 3 then x + 1::double when 4 then x + 2::double end as ring_lng from outlines""", ("outlines",))
def shape_centres(spark, sf):
    rows = view(spark, sf, "outlines").withColumn("shape", shapes.geometry(F.col("geometry_json")))
    s = F.col("shape")
    found = rows.select("entity_id", shapes.drawn_as(s).alias("drawn"), F.when(s.isNotNull(), F.size(shapes.positions(s))).alias("positions"), shapes.centre(s).alias("c"), shapes.ring_centre(s).alias("r"))
    return rounded(found.select("entity_id", "drawn", "positions", F.col("c.lat").alias("lat"), F.col("c.lon").alias("lng"), F.col("r.lat").alias("ring_lat"), F.col("r.lon").alias("ring_lng")))


_SQUARE = "({s} * {s} * 110.574::double * 111.320::double * cos(radians(y + {at} + 2 * {s} / 5.0::double)))"
_OUTER, _HOLE, _SMALL, _BESIDE = (_SQUARE.format(s=s, at=at) for s, at in ((4, 0), (1, 1), (3, 0), (2, 5)))


@query(f"""select number::double as neighbourhood_number, arg_min(name, ordinal) filter (name is not null) as neighbourhood, round(arg_min(case kind when 4 then {_OUTER} - {_HOLE} else {_SMALL} - {_HOLE} + {_BESIDE} end, ordinal), 4) as area_sq_km
from outlines where kind in (4, 5) and number <> 'none' group by number""", ("outlines",))
def shape_areas(spark, sf):
    return rounded(features.neighbourhood_areas(view(spark, sf, "outlines")))


_READ = "'{\"coordinates\":' || json_extract(geometry_json, '$.coordinates')::varchar || ',\"type\":\"' || json_extract_string(geometry_json, '$.type') || '\"}'"
_DECODED = f"case when kind < 6 then {_READ} else '{{\"coordinates\":[' || lon || ',' || lat || '],\"type\":\"Point\"}}' end"


@query(f"""select entity_id, '{{"type":"Feature","geometry":' || {_DECODED} || ',"properties":{{"id":"' || entity_id || '","name":' || coalesce('"' || name || '"', 'null') || ',"category":"' || raw_category || '","source_id":"' || source_id || '","address":' || coalesce(to_json(address)::varchar, 'null') || '}}}}' as feature from outlines""", ("outlines",))
def layer_features(spark, sf):
    return features.layer_features(view(spark, sf, "outlines"))


@query(f"""select entity_id, case when kind < 6 then {_READ} when dataset = 'roads' then '{{"coordinates":[[' || p || ',' || q || ']],"type":"MultiLineString"}}' when dataset = 'boundaries' then '{{"coordinates":[[' || p || ',' || q || ']],"type":"Polygon"}}'
  when ordinal % 11 = 0 then '{{"coordinates":[0.0,0.0],"type":"Point"}}' else '{{"coordinates":' || p || ',"type":"Point"}}' end as payload
from (select *, '[' || x::double || ',' || y::double || ']' as p, '[' || (x + 1)::double || ',' || y::double || ']' as q from outlines)""", ("outlines",))
def geometry_payloads(spark, sf):
    point = lambda dx: F.struct(F.col("y").cast("double").alias("lat"), (F.col("x") + dx).cast("double").alias("lon"))
    points = F.when((F.col("ordinal") % 11 > 0) | F.col("dataset").isin("roads", "boundaries"), F.array(point(0), point(1)))
    return view(spark, sf, "outlines").select("entity_id", shapes.payload(F.col("geometry_json"), F.col("dataset"), points).alias("payload"))


# the classical series about the central meridian, with the length of the meridian to the tenth power of the eccentricity
_E2 = "(2/298.257222101::double - 1/298.257222101::double/298.257222101::double)"


@query(f"""select entity_id, round(0.9999::double * n * (a + (1 - t + c) * a**3 / 6 + (5 - 18*t + t*t + 72*c - 58*p) * a**5 / 120), 1) as x,
  round(0.9999::double * (m + n * sqrt(t) * (a*a/2 + (5 - t + 9*c + 4*c*c) * a**4 / 24 + (61 - 58*t + t*t + 600*c - 330*p) * a**6 / 720)), 1) as y, round(lat, 6) as lat, round(lon, 6) as lon
from (select *, 6378137.0::double / sqrt(1 - e * sin(f) * sin(f)) as n, tan(f) * tan(f) as t, e / (1 - e) * cos(f) * cos(f) as c, e / (1 - e) as p, radians(lon + 114) * cos(f) as a,
  6378137.0::double * ((1 - e/4 - 3*e**2/64 - 5*e**3/256 - 175*e**4/16384 - 441*e**5/65536) * f - (3*e/8 + 3*e**2/32 + 45*e**3/1024 + 105*e**4/4096 + 2205*e**5/131072) * sin(2*f) + (15*e**2/256 + 45*e**3/1024 + 525*e**4/16384 + 1575*e**5/65536) * sin(4*f) - (35*e**3/3072 + 175*e**4/12288 + 3675*e**5/262144) * sin(6*f) + (315*e**4/131072 + 2205*e**5/524288) * sin(8*f) - 693*e**5/1310720 * sin(10*f)) as m
  from (select *, radians(lat) as f, {_E2} as e from outlines))""", ("outlines",))
def grid_places(spark, sf):
    x, y = ALBERTA_3TM_114.forward(F.col("lat"), F.col("lon"))
    plane = view(spark, sf, "outlines").select("entity_id", x.alias("x"), y.alias("y"))
    lat, lon = ALBERTA_3TM_114.inverse(F.col("x"), F.col("y"))
    return plane.select("entity_id", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"), F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


_LABEL = "lower(trim(regexp_replace(characteristic, '\\s+', ' ', 'g')))"
_BEST = "arg_min({c}, (rank, characteristic, ordinal)) filter ({c} is not null)"
_SHAPE_AREA = f"case kind when 4 then {_OUTER} - {_HOLE} else {_SMALL} - {_HOLE} + {_BESIDE} end"


@query(f""", p as (select try_cast(number as double) as number, {_BEST.format(c="v")} as population_2021, {_BEST.format(c="characteristic")} as population_characteristic
  from (select *, try_cast(value as double) as v, case {_LABEL} when 'population, 2021' then 0 when 'population' then 1 when 'total population' then 3 else 50 end as rank from census_counts where lower(characteristic) like '%population%' and lower(gender) like '%total%' and question_type like 'Population%') group by 1),
i as (select try_cast(number as double) as number, {_BEST.format(c="v")} as median_household_income_2020_cad, {_BEST.format(c="characteristic")} as income_characteristic
  from (select *, try_cast(value as double) as v, case characteristic when 'Median total income of household' then 1 when 'Household total income, median' then 10 when 'Average household income' then 20 else 50 end as rank from census_counts where characteristic ilike '%income%' and coalesce(gender, 'total') ilike '%total%') group by 1),
h as (select number::double as number, coalesce(sum(try_cast(value as double)), 0) as households_2021 from household_counts where question_type = 'Household Size' and lower(characteristic) in ('1 person', '2 persons', '4 persons', '5 or more persons') group by 1),
a as (select number::double as number, round(arg_min({_SHAPE_AREA}, ordinal), 4) as area_sq_km from outlines where kind in (4, 5) and number <> 'none' group by 1),
q as (select number::double as number, arg_min(neighbourhood, ordinal) as neighbourhood, arg_min(coalesce(ward, ''), ordinal) as ward from quarters group by 1)
select 'N' || case when q.number < 10 then '00' when q.number < 100 then '0' else '' end || q.number::bigint as source_area_id, 'neighbourhood' as geography_level, q.number as neighbourhood_number, q.neighbourhood, nullif(q.ward, '') as ward, population_2021, households_2021, median_household_income_2020_cad, area_sq_km,
  population_characteristic, case when h.number is not null then 'sum_household_size_distribution' end as households_characteristic, income_characteristic
from q left join p using (number) left join i using (number) left join h using (number) left join a using (number)""", ("census_counts", "household_counts", "outlines", "quarters"))
def neighbourhood_census(spark, sf):
    areas = features.neighbourhood_areas(view(spark, sf, "outlines"))
    found = census.build(view(spark, sf, "quarters"), view(spark, sf, "census_counts"), view(spark, sf, "household_counts"), areas)
    return found.withColumn("area_sq_km", F.round("area_sq_km", 4))
