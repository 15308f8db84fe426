"""Valuation of points, with the same rows in SQL by looking at all properties and amenities."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelforge.operators import appraisal
from parcelforge.operators import valuation as V
from parcelforge.plans.adapters import view
from parcelforge.plans.catalog import hav, legs, query, rounded

KINDS = {"parks": "PROMO", "playgrounds": "ECONOMY", "schools": "STANDARD", "libraries": "LARGE"}
#: Points are the stops, every second one moved onto a property; half of them tell something of themselves.
POINTS = (
    "select s.stop_id as request_id, case when cast(s.stop_id as bigint) % 2 = 0 then p.lat + 0.0001::double else s.lat end as lat, case when cast(s.stop_id as bigint) % 2 = 0 then p.lon else s.lon end as lon, "
    "case when cast(s.stop_id as bigint) % 4 < 2 then cast(p.year_built as double) end as year_built, case when cast(s.stop_id as bigint) % 4 = 1 then p.tax_class end as tax_class from stops s join properties p on p.location_id = concat('loc-', s.stop_id)"
)
_CENSUS = "select concat('N', lpad(cast(neighbourhood_id as string), 4, '0')) as area_id, count(*) * 37 as population, 1 + count(*) * (10 + neighbourhood_id % 7) as households, 1.5::double + neighbourhood_id as area_sq_km, count(*) * 37 / (1.5::double + neighbourhood_id) as population_density, cast(neighbourhood_id % 3 = 0 as int) as limited_accuracy from properties where neighbourhood_id % 5 <> 4 group by neighbourhood_id"


def _clip(x: str, low: str, high: str) -> str:
    return f"case when {x} is not null then greatest({low}, least({x}, {high})) end"


def _compared(other: str, kind: str) -> str:
    cap, pull = V.COMPARED[kind]
    return f"coalesce({_clip(f'({other} - base) * {pull}::double', f'-{cap}::double * base', f'{cap}::double * base')}, 0)"


def half_up(x: str) -> str:
    """Two decimals of a double as it is written, halves up: DuckDB's own rounding scales the binary value first."""
    return f"cast(round(cast(cast({x} as varchar) as decimal(38, 18)), 2) as double)"


def _sql() -> str:
    score = "+".join(f"round(greatest(0.0::double, least(1.0::double, 1 - {half_up(half_up(f"least(30000.0::double, {hav('lat', 'lon', f'{a}::double', f'{b}::double')}) / 12.5::double") + ' / 60')} / 35.0::double)) * {w}::double, 9)" for _, a, b, w in V.CENTRES)
    amenities = ", ".join(f"max(metres) filter (kind = '{k}' and place = 1) as d_{k}, cast(count(*) filter (kind = '{k}' and place <= {n}) as bigint) as n_{k}" for k, n in appraisal.AMENITY_LIMIT.items())
    access = {k: f"coalesce(base * {share}::double * (greatest(0.0::double, least(1.0::double, 1 - d_{k} / {far}::double)) - 0.35::double), 0)" for k, (far, share) in V.AMENITIES.items()}
    census = "case when c_density > 0 and c_household > 0 then (case when limited_accuracy = 1 then 0.5::double else 1.0::double end) * greatest(-60000.0::double, least(60000.0::double, greatest(-0.025::double * base, least(0.025::double * base, base * (0.012::double * greatest(-1.0::double, least(1.0::double, (c_density - city_density) / city_density)) + 0.008::double * greatest(-1.0::double, least(1.0::double, (c_household - city_household) / city_household))))))) else 0.0::double end"
    matching = "(t_year is not null or t_tax is not null) and (t_year is null or coalesce(abs(t_year - p_year) <= 5, false)) and (t_tax is null or upper(trim(p_tax)) = upper(trim(t_tax)))"
    w = V.COMPLETENESS
    complete = " + ".join([f"case when n_{k} > 0 then {w[k]}::double else 0 end" for k in KINDS] + [f"{w['commute']}::double", f"case when area_mean is not null then {w['neighbourhood']}::double else 0 end", f"{w['crime']}::double", f"case when c_density is not null then {w['census']}::double else 0 end", f"case when c_count > 0 then {w['comparables']}::double else 0 end"])
    raw = " + ".join(["base", _compared("m_median", "matching"), _compared("n_median", "nearby"), _compared("round(area_mean, 2)", "neighbourhood"), census, *access.values(), "base * 0.03::double * (commute - 0.35::double)"])
    return f"""
, points as ({POINTS}), asked as materialized (select request_id, round(lat, 6) as lat, round(lon, 6) as lon, year_built, tax_class from points),
census as materialized ({_CENSUS}), city as (select avg(population_density) as city_density, avg(population::double / households) as city_household from census where area_sq_km > 0 and households > 0 and population > 0),
base as materialized (select request_id, location_id as baseline_id, round(value, 2) as base, m as baseline_m, m <= 35 as matched, neighbourhood as b_area from (
  select a.request_id, p.*, round({hav('a.lat', 'a.lon', 'p.lat', 'p.lon')}, 2) as m, row_number() over (partition by a.request_id order by (p.lat-a.lat)*(p.lat-a.lat)+(p.lon-a.lon)*cos(radians(a.lat))*((p.lon-a.lon)*cos(radians(a.lat))), p.location_id) as r from asked a cross join properties p) where r = 1),
areas as (select upper(neighbourhood) as k, min(neighbourhood) as area, avg(value) as area_mean, avg(lat) as c_lat, avg(lon) as c_lon, min(neighbourhood_id) as number from properties group by 1),
mine as (select a.request_id, coalesce(case when matched then upper(b_area) end, near.k) as k from asked a join base using (request_id) join (select request_id, k from (
  select a.request_id, k, row_number() over (partition by a.request_id order by round({hav('a.lat', 'a.lon', 'c_lat', 'c_lon')}, 2), k) as r from asked a cross join areas) where r = 1) near using (request_id)),
around as (select request_id, area, area_mean, population_density as c_density, population::double / households as c_household, limited_accuracy from mine join areas using (k) left join census on area_id = concat('N', lpad(cast(number as string), 4, '0'))),
there as (select case category {" ".join(f"when '{c}' then '{k}'" for k, c in KINDS.items())} end as kind, entity_id, lat, lon from pois where category in ({", ".join(f"'{c}'" for c in KINDS.values())})),
ranked as (select request_id, kind, metres, row_number() over (partition by request_id, kind order by two, entity_id) as place from (
  select a.request_id, t.kind, t.entity_id, round({hav('a.lat', 'a.lon', 't.lat', 't.lon')}, 2) as metres, {legs('a.lat', 'a.lon', 't.lat', 't.lon')} as two, row_number() over (partition by a.request_id, t.kind order by abs(a.lat-t.lat)+abs(a.lon-t.lon), t.entity_id) as stage from asked a cross join there t) where stage <= 25),
reach as (select request_id, {amenities} from ranked group by 1),
seen as (select a.request_id, p.location_id, p.value, a.year_built as t_year, a.tax_class as t_tax, p.year_built as p_year, p.tax_class as p_tax, {legs('a.lat', 'a.lon', 'p.lat', 'p.lon')} as two, row_number() over (partition by a.request_id order by abs(a.lat-p.lat)+abs(a.lon-p.lon), p.location_id) as stage
  from asked a cross join properties p where p.value is not null),
sorted as (select *, row_number() over (partition by request_id, matching order by two, location_id) as r from (select *, {matching} as matching from seen where stage <= 60)),
picked as materialized (select * from sorted where r <= {appraisal.COMPARABLES}),
mids as (select request_id, median(value) filter (matching) as m_median, median(value) filter (not matching) as n_median, median(value) as c_median, count(*) as c_count from picked group by 1),
wide as (select request_id, avg(abs(value - c_median)) as c_spread from picked join mids using (request_id) group by 1),
rows_ as (select *, ({score}) / {sum(x for *_, x in V.CENTRES)}::double as commute from asked join base using (request_id) left join around using (request_id) left join reach using (request_id) left join mids using (request_id) left join wide using (request_id) cross join city),
told as (select *, {raw} as raw, least(100.0::double, {complete}) as completeness from rows_),
counted as (select *, raw < 0.65::double * base or raw > 1.35::double * base as guarded, cast(not matched as int) + 2 + cast(raw < 0.65::double * base or raw > 1.35::double * base as int) as flags, cast((year_built is not null or tax_class is not null) and m_median is null as int) as missing,
  greatest(0.08::double, least(0.38::double, 0.12::double + case when c_count > 0 then least(0.12::double, c_spread / greatest(base, 1.0::double)) else 0.08::double end + greatest(0.0::double, (100 - completeness) / 250))) as spread,
  round(greatest(0.0::double, greatest(0.65::double * base, least(1.35::double * base, raw))), 2) as estimate from told),
sure as (select *, greatest(5.0::double, least(99.0::double, completeness + case when matched then 14.0::double else 0 end - 4.0::double * missing - 3.5::double * flags + case when m_median is not null then 6.0::double when n_median is not null then 2.0::double else 0 end)) as confidence from counted)
select request_id, case when base is null then 'no_baseline' else 'ok' end as status, baseline_id, round(base, 2) as base, round(baseline_m, 2) as baseline_m, matched, area, case when base is not null then round(estimate, 1) end as estimate, case when base is not null then round(round(estimate * (1 - spread), 2), 1) end as low,
  case when base is not null then round(round(estimate * (1 + spread), 2), 1) end as high, case when base is not null then round(completeness, 2) end as completeness, case when base is not null then round(confidence, 2) end as confidence,
  case when base is not null then case when confidence >= 80 then 'high' when confidence >= 60 then 'medium' when confidence >= 40 then 'low' else 'very_low' end end as label, case when base is not null then concat_ws(',', case when not matched then 'baseline_nearest_neighbour' end, 'commute_routing_fallback', 'straight_line_distance', case when guarded then 'valuation_guardrail' end) end as flags,
  case when base is not null then case when missing = 1 then 'matching_comparables' else '' end end as missing, n_parks, n_schools, n_libraries, round(commute, 4) as commute_index from sure
"""


@query(_sql(), ("properties", "pois", "stops"))
def point_valuation(spark, sf):
    p, pois = view(spark, sf, "properties"), view(spark, sf, "pois")
    at = F.col("stop_id").cast("long")
    own = p.select(F.regexp_extract("location_id", "loc-(.*)", 1).alias("stop_id"), F.col("lat").alias("h_lat"), F.col("lon").alias("h_lon"), F.col("year_built").cast("double").alias("year_built"), "tax_class")
    s = view(spark, sf, "stops").select("stop_id", "lat", "lon").join(own, "stop_id")
    points = s.select(
        F.col("stop_id").alias("request_id"), F.when(at % 2 == 0, F.col("h_lat") + 0.0001).otherwise(F.col("lat")).alias("lat"), F.when(at % 2 == 0, F.col("h_lon")).otherwise(F.col("lon")).alias("lon"),
        F.when(at % 4 < 2, F.col("year_built")).alias("year_built"), F.when(at % 4 == 1, F.col("tax_class")).alias("tax_class"))
    kind = F.element_at(F.create_map(*[F.lit(x) for k, c in KINDS.items() for x in (c, k)]), F.col("category"))
    amenities = pois.filter(F.col("category").isin(list(KINDS.values()))).select(kind.alias("kind"), "entity_id", "lat", "lon")
    number = F.col("neighbourhood_id")
    groups = p.filter(number % 5 != 4).groupBy("neighbourhood_id").agg(F.count("*").alias("n"))
    area = 1.5 + number
    census = groups.select(F.format_string("N%04d", number).alias("area_id"), (F.col("n") * 37).alias("population"), (1 + F.col("n") * (10 + number % 7)).alias("households"), area.alias("area_sq_km"), (F.col("n") * 37 / area).alias("population_density"), (number % 3 == 0).cast("int").alias("limited_accuracy"))
    crime = view(spark, sf, "crime").groupBy("neighbourhood").agg(F.sum("amount").alias("incidents"))
    r = appraisal.appraise(points, p, amenities, census=census, crime=crime)
    r = r.select(
        "request_id", "status", "baseline_id", "base", "baseline_m", F.col("matched_property").isNotNull().alias("matched"), "area", F.round("estimate", 1).alias("estimate"), F.round("low", 1).alias("low"), F.round("high", 1).alias("high"), "completeness", "confidence", "label",
        F.array_join("fallback_flags", ",").alias("flags"), F.array_join("missing_factors", ",").alias("missing"), "n_parks", "n_schools", "n_libraries", "commute_index")
    return rounded(r)
