"""Domain tables derived from the driver's tables, as columns whose text is valid in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LAT = "(cast(53.3958 as double) + cast((({k})*7919)%3202 as double)/10000)"
_LON = "(cast(-113.7136 as double) + cast((({k})*104729)%4422 as double)/10000)"


def lat(key: str) -> str:
    return _LAT.format(k=key)


def lon(key: str) -> str:
    return _LON.format(k=key)


def _outline(key: str) -> str:
    """Text of a geometry by the key modulo 9: six types, then broken text, no coordinates, null."""
    pair = lambda dx, dy: f"concat('[', cast({key} % 90 + {dx} as string), ', ', cast({key} % 50 + {dy} as string), ']')"
    many = lambda *parts: "concat('[', " + ", ', ', ".join(parts) + ", ']')"
    square = lambda at, s: many(*[pair(at + dx, at + dy) for dx, dy in ((0, 0), (s, 0), (s, s), (0, s), (0, 0))])
    shapes = {
        "Point": pair(0, 0), "MultiPoint": many(pair(0, 0), pair(2, 4)), "LineString": many(pair(0, 0), pair(3, 0), pair(3, 3)),
        "MultiLineString": many(many(pair(0, 0), pair(2, 0)), many(pair(0, 2), pair(2, 2), pair(1, 6))),
        "Polygon": many(square(0, 4), square(1, 1)), "MultiPolygon": many(many(square(0, 3), square(1, 1)), many(square(5, 2))),
    }
    cases = " ".join(f"when {key} % 9 = {i} then concat('{{\"type\": \"{kind}\", \"coordinates\": ', {xy}, '}}')" for i, (kind, xy) in enumerate(shapes.items()))
    return f"case {cases} when {key} % 9 = 6 then '{{\"type\": \"Point\", \"coordinates\": [1,' when {key} % 9 = 7 then '{{\"type\": \"Polygon\"}}' end"


#: name: (source tables and joins, columns as (expression, name))
VIEWS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "properties": (
        "customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
        [
            ("concat('loc-', cast(c_custkey as string))", "location_id"), ("n_name", "neighbourhood"), ("cast(n_nationkey as bigint)", "neighbourhood_id"), ("r_name", "ward"),
            ("c_mktsegment", "tax_class"), ("case when c_custkey % 97 = 0 then cast(null as double) else c_acctbal*40+300000 end", "value"), ("cast(1950 + c_custkey % 75 as bigint)", "year_built"),
            ("cast(250 + c_custkey % 400 as double)", "lot_size"), ("cast(900 + c_custkey % 1800 as double)", "gross_area"), ("case when c_custkey % 3 = 0 then 'RF1' when c_custkey % 3 = 1 then 'RF3' else 'DC2' end", "zoning"),
            ("case when c_custkey % 2 = 0 then 'Y' else 'N' end", "garage"), ("case when c_custkey % 11 = 0 then cast(c_custkey % 9 + 1 as string) end", "suite"), ("cast(100 + c_custkey % 900 as string)", "house"),
            ("concat(cast(c_custkey % 120 as string), ' ST NW')", "street"), (lat("c_custkey"), "lat"), (lon("c_custkey"), "lon"),
        ],
    ),
    "attributes": (
        "customer",
        [
            ("concat('loc-', cast(c_custkey as string))", "location_id"), ("case when c_custkey % 7 = 0 then cast(null as bigint) else cast(1 + c_custkey % 5 as bigint) end", "bedrooms"),
            ("case when c_custkey % 7 = 0 then cast(null as double) else cast(1 + c_custkey % 6 as double) / 2 end", "bathrooms"), ("cast(2 + c_custkey % 3 as bigint)", "bedrooms_estimated"),
            ("cast(2 + c_custkey % 4 as double) / 2", "bathrooms_estimated"), ("case when c_custkey % 13 = 0 then cast(null as double) else cast(50 + c_custkey % 50 as double) / 100 end", "confidence"),
            ("case when c_custkey % 4 = 0 then 'observed' when c_custkey % 4 = 1 then 'inferred' else 'imputed' end", "source_type"),
        ],
    ),
    "records": (
        "orders",
        [
            ("case when o_orderkey % 83 = 0 then cast(null as string) else cast(o_orderkey - o_orderkey % 3 as string) end", "record_id"), ("concat('loc-', cast(o_custkey as string))", "location_id"),
            ("cast(extract(year from o_orderdate) as bigint)", "year"), ("case when o_orderkey % 50 = 0 then cast(null as double) when o_orderkey % 50 = 1 then cast(0 as double) else o_totalprice end", "value"),
            ("case when o_orderkey % 2 = 0 then 'city_a' else 'city_b' end", "source_id"), ("cast(ascii(o_orderpriority) % 10 as double) / 10", "confidence"), ("o_orderkey", "ordinal"),
            ("case when o_orderkey % 61 = 0 then cast(null as double) else " + lat("o_custkey") + " end", "lat"), (lon("o_custkey"), "lon"),
            ("case when o_orderkey % 5 = 0 then '' else concat(o_orderstatus, cast(o_orderkey % 4 as string)) end", "zoning"),
        ],
    ),
    "pois": (
        "part",
        [
            ("cast(p_partkey as string)", "entity_id"), ("case when p_partkey % 2 = 0 then 'pois_a' else 'pois_b' end", "source_id"), ("p_name", "name"), ("p_type", "category"),
            (lat("p_partkey % 997"), "lat"), (lon("p_partkey % 997"), "lon"), ("p_partkey", "ordinal"), ("p_brand", "subcategory"),
        ],
    ),
    "crime": (
        "events",
        [
            ("concat('NATION_', cast(user_id % 25 as string))", "neighbourhood"), ("event_type", "crime_type"), ("cast(extract(day from ts) as bigint)", "day"), ("value", "amount"),
            ("event_id", "ordinal"), (lat("event_id"), "lat"), (lon("event_id"), "lon"), ("case when event_id % 2 = 0 then 'count' else 'rate' end", "metric"),
            ("case when event_id % 3 = 0 then 'police_a' when event_id % 3 = 1 then 'police_b' end", "source_id"), ("case when event_id % 7 = 0 then cast(null as bigint) else cast(2019 + event_id % 5 as bigint) end", "year"),
        ],
    ),
    # properties with units and legal descriptions, and what other sources tell of some of them, each kind of error in an eighth
    "homes": (
        "customer join nation on c_nationkey = n_nationkey",
        [
            ("concat('loc-', cast(c_custkey as string))", "location_id"), ("case when c_custkey % 3 = 0 then cast(c_custkey % 5 + 1 as string) end", "suite"), ("cast(100 + c_custkey % 60 as string)", "house"),
            ("concat(n_name, ' STREET NW')", "street"), ("concat('Plan ', cast(c_custkey as string), ' Block ', cast(c_custkey % 50 as string), ' Lot ', cast(c_custkey % 20 as string))", "legal_description"),
            ("cast(1950 + c_custkey % 75 as string)", "year_built"), ("cast(900 + c_custkey % 1800 as double)", "gross_area"), (lat("c_custkey"), "lat"), (lon("c_custkey"), "lon"),
        ],
    ),
    "offers": (
        "customer join nation on c_nationkey = n_nationkey",
        [
            ("concat('src-', cast(c_custkey as string))", "source_record_id"), ("case when c_custkey % 8 <> 3 and c_custkey % 3 = 0 then concat('Unit ', cast(c_custkey % 5 + 1 as string)) end", "suite"),
            ("case when c_custkey % 8 = 2 then '9999' when c_custkey % 8 = 7 and c_custkey % 5 = 0 then cast(null as string) else cast(100 + c_custkey % 60 as string) end", "house"),
            (
                "case c_custkey % 8 when 1 then concat(n_name, ' Strret North-West') when 4 then concat(substring(n_name, 2, 30), ' St NW') when 5 then concat('street ', n_name, ' nw') when 6 then concat(n_name, 'E St. NW') "
                "when 7 then case when c_custkey % 5 = 0 then cast(null as string) else 'UNKNOWN ROAD' end else concat(n_name, ' street nw') end", "street",
            ),
            ("case when c_custkey % 8 = 2 then concat('PLAN ', cast(c_custkey as string), ' BLK ', cast(c_custkey % 50 as string), ' LOT ', cast(c_custkey % 20 as string)) end", "legal_description"),
            ("case when c_custkey % 8 = 6 then cast(1950 + c_custkey % 75 as string) end", "year_built"), ("case when c_custkey % 16 = 6 then cast(850 + c_custkey % 1800 as double) end", "gross_area"),
            ("case when c_custkey % 8 = 4 then " + lat("c_custkey") + " end", "lat"), (lon("c_custkey"), "lon"),
            ("cast(1 + c_custkey % 5 as bigint)", "bedrooms"), ("case when c_custkey % 9 <> 0 then cast(1 + c_custkey % 6 as double) / 2 end", "bathrooms"),
        ],
    ),
    # several arrivals for each property and point of interest, with gaps
    "arrivals": (
        "orders",
        [
            ("concat('loc-', cast(o_custkey as string))", "location_id"), ("o_orderkey", "ordinal"), ("case when o_orderkey % 4 = 0 then ' ' when o_orderkey % 4 = 1 then cast(o_orderkey % 7 as string) end", "suite"),
            ("case when o_orderkey % 3 = 0 then cast(o_orderkey % 90 as string) end", "house_number"), ("case when o_orderkey % 5 > 2 then concat('st ', cast(o_orderkey % 31 as string)) end", "street_name"), ("case when o_orderkey % 6 = 1 then o_orderpriority else '' end", "zoning"),
            ("case when o_orderkey % 7 > 3 then cast(o_totalprice as double) end", "lot_size"), ("case when o_orderkey % 8 = 5 then cast(1950 + o_orderkey % 70 as bigint) end", "year_built"), ("case when o_orderkey % 9 > 6 then o_orderstatus end", "garage"),
            ("case when o_orderkey % 11 > 2 then cast(extract(year from o_orderdate) as bigint) end", "assessment_year"), ("case when o_orderkey % 13 > 4 then cast(o_totalprice as double) end", "assessment_value"),
            ("o_orderpriority", "link_method"), ("case when o_orderkey % 10 > 0 then cast(o_orderkey % 5 as double) / 4 end", "confidence"), ("cast(o_orderdate as date)", "updated_at"),
            ("concat('src', cast(o_orderkey % 4 as string))", "source_a"), ("case when o_orderkey % 3 > 0 then concat('src', cast(o_orderkey % 6 as string)) end", "source_b"), ("concat('r', cast(o_orderkey as string))", "record_a"),
            (
                "case when o_orderkey % 17 = 0 then 'broken {' when o_orderkey % 19 = 0 then '[1]' else concat('{\"color\": ', cast(o_orderkey % 9 as string), ', \"f', cast(o_orderkey % 3 as string), '\": \"', o_orderstatus, '\", \"sources\": ', "
                "case when o_orderkey % 12 = 3 then '7' else concat('{\"s', cast(o_orderkey % 5 as string), '\": ', cast(o_orderkey as string), '}') end, '}') end", "metadata",
            ),
        ],
    ),
    # two kinds of transit routes over the stops: one for each nation of suppliers, one for each region
    "nation_calls": ("supplier", [("concat('N', cast(s_nationkey as string))", "route_id"), ("s_suppkey", "position"), ("cast(s_suppkey as string)", "stop_id")]),
    "region_calls": ("supplier join nation on s_nationkey = n_nationkey", [("concat('R', cast(n_regionkey as string))", "route_id"), ("(s_suppkey * 37) % 101", "position"), ("cast(s_suppkey as string)", "stop_id")]),
    "trips_wanted": (
        "customer",
        [
            ("concat('loc-', cast(c_custkey as string))", "request_id"), ("concat(cast(100 + c_custkey % 900 as string), ' ', cast(c_custkey % 120 as string), ' st. nw')", "origin_text"),
            ("case when c_custkey % 3 <> 0 then " + lat("c_custkey") + " end", "origin_lat"), ("case when c_custkey % 3 <> 0 then " + lon("c_custkey") + " end", "origin_lon"),
            (lat("c_custkey*17"), "destination_lat"), ("case when c_custkey % 53 <> 0 then " + lon("c_custkey*17") + " end", "destination_lon"),
        ],
    ),
    # geometries of the six types as text, some with holes, some broken or absent, around (x, y)
    "outlines": (
        "customer",
        [
            ("cast(c_custkey as string)", "entity_id"), ("c_custkey", "ordinal"), ("c_custkey % 90", "x"), ("c_custkey % 50", "y"), ("c_custkey % 9", "kind"), (_outline("c_custkey"), "geometry_json"),
            ("case when c_custkey % 31 = 0 then 'none' else cast(c_custkey % 200 as string) end", "number"), ("case when c_custkey % 5 > 0 then c_name end", "name"), ("c_mktsegment", "raw_category"),
            ("case when c_custkey % 4 = 0 then 'roads' when c_custkey % 4 = 1 then 'boundaries' else 'schools' end", "dataset"), ("concat('src', cast(c_custkey % 3 as string))", "source_id"),
            ("case when c_custkey % 7 > 0 then concat('12 ', c_mktsegment, ' \"ST\" NW') end", "address"), (lat("c_custkey"), "lat"), (lon("c_custkey"), "lon"),
        ],
    ),
    # counts of the census by labels of several editions, and the neighbourhoods of today
    "census_counts": (
        "orders",
        [
            ("case when o_orderkey % 43 = 0 then 'all' else cast(o_custkey % 250 as string) end", "number"), ("case when o_orderkey % 3 = 0 then 'Income' else 'Population and dwellings' end", "question_type"),
            (
                "case (o_custkey % 250 + o_orderkey % 3 * 3) % 8 when 0 then 'Population, 2021' when 1 then ' POPULATION' when 2 then 'Total  Population' when 3 then 'Population density' when 4 then 'Median total income of household' "
                "when 5 then 'Household total income, median' when 6 then 'Average household income' else 'Income of persons' end", "characteristic",
            ),
            ("case o_orderkey % 5 when 0 then 'Men+' when 1 then cast(null as string) when 2 then 'TOTAL' else 'Total - Gender' end", "gender"),
            ("case when o_orderkey % 17 = 0 then 'F' else cast(o_orderkey % 9001 as string) end", "value"), ("o_orderkey", "ordinal"),
        ],
    ),
    "household_counts": (
        "orders",
        [
            ("cast(o_custkey % 240 as string)", "number"), ("case when o_orderkey % 7 = 0 then 'Dwellings' else 'Household Size' end", "question_type"),
            ("case o_orderkey % 6 when 0 then '1 person' when 1 then '2 Persons' when 2 then '5 or more persons' when 3 then 'Private households' when 4 then '4 persons' else '3 persons or so' end", "characteristic"),
            ("cast(null as string)", "gender"), ("case when o_orderkey % 19 = 0 then 'F' else cast(o_orderkey % 97 as string) end", "value"), ("o_orderkey", "ordinal"),
        ],
    ),
    "quarters": ("customer", [("cast(c_custkey % 260 as string)", "number"), ("c_name", "neighbourhood"), ("case when c_custkey % 3 > 0 then c_mktsegment end", "ward"), ("c_custkey", "ordinal")]),
    "stops": ("supplier", [("cast(s_suppkey as string)", "stop_id"), (lat("s_suppkey*31"), "lat"), (lon("s_suppkey*31"), "lon"), ("s_name", "name")]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    words = source.split()
    df = spark.read.parquet(f"{sf_dir}/{words[0]}.parquet")
    for part in source.split(" join ")[1:]:
        other, condition = part.split(" on ")
        from pyspark.sql import functions as F

        df = df.join(spark.read.parquet(f"{sf_dir}/{other}.parquet"), F.expr(condition))
    return df.selectExpr(*[f"{e} as {n}" for e, n in columns])


def with_views(sql: str, *names: str) -> str:
    """``sql`` for DuckDB with these domain tables in front."""
    tables = [f"{n} as (select {', '.join(f'{e} as {c}' for e, c in VIEWS[n][1])} from {VIEWS[n][0]})" for n in names]
    return f"with {', '.join(tables)}\n{sql}"
