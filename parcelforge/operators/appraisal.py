"""Valuation of any points: the nearest property is the baseline, evidence around the point adjusts it.

A point within MATCH_M of a property is that property; else the nearest one stands in, and a
flag says so. What a point has no evidence for is told by a code (missing factor), as is
everything that was used instead (fallback flag) and each warning; completeness and
confidence follow from these. All points go through each step together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.functions import geo
from parcelforge.functions.text import money
from parcelforge.graph import routing
from parcelforge.operators import valuation as V
from parcelforge.operators.models import model_adjustment
from parcelforge.operators.nearest import comparables, knn, nearest_one
from parcelforge.session import materialize

# Metres within which a point is a property, comparables of each kind, amenities of each kind, and the commute's scale and labels.
MATCH_M, COMPARABLES = 35.0, 8
AMENITY_LIMIT = {"parks": 3, "playgrounds": 3, "schools": 3, "libraries": 1}
MISSING = {"parks": "park_access", "playgrounds": "playground_access", "schools": "school_access", "libraries": "library_access"}
COMMUTE_MIN, COMMUTE_LABELS = 35.0, [(0.7, "high"), (0.45, "medium")]
ATTRIBUTES = ["year_built", "bedrooms", "bathrooms", "gross_area", "lot_size", "tax_class", "garage", "zoning"]
#: factor: share of the whole that it adds to completeness, in the order of the checks
WEIGHTS = V.COMPLETENESS


def _codes(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, in this order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in pairs]))


def _matches(told: list[str]) -> Column:
    """A neighbour agrees with everything that the point tells of itself, and it tells something."""
    kinds = {"year_built": lambda c: V.close_to(f"t_{c}", c, 5), "bedrooms": lambda c: V.close_to(f"t_{c}", c, 1.0), "bathrooms": lambda c: V.close_to(f"t_{c}", c, 0.5), "gross_area": lambda c: V.similar(f"t_{c}", c, 0.2), "lot_size": lambda c: V.similar(f"t_{c}", c, 0.2)}
    known = reduce(lambda a, b: a | b, [F.coalesce(F.trim(F.col(f"t_{c}").cast("string")) != "", F.lit(False)) for c in told], F.lit(False))
    return reduce(lambda a, b: a & b, [kinds.get(c, lambda c: V.same_text(f"t_{c}", c))(c) for c in told], known)


def context(points: DataFrame, properties: DataFrame, census: DataFrame | None, crime: DataFrame | None) -> DataFrame:
    """(target_id, area, area_mean, area_median, area_count, density, household, limited, incidents): the neighbourhood of each point and what is known of it.

    points: (target_id, t_lat, t_lon, m_area), the last the matched property's neighbourhood.
    Without one, the neighbourhood whose properties' centre is nearest. Names are compared
    without regard to case.
    """
    named = properties.filter(F.trim("neighbourhood") != "").withColumn("area_key", F.upper("neighbourhood"))
    areas = materialize(named.groupBy("area_key").agg(
        F.min("neighbourhood").alias("area"), F.avg("value").alias("area_mean"), F.percentile("value", F.lit(0.5)).alias("area_median"), F.count("value").alias("area_count"),
        F.avg("lat").alias("c_lat"), F.avg("lon").alias("c_lon")), "areas")
    usual = named.filter("neighbourhood_id is not null").groupBy("area_key", "neighbourhood_id").agg(F.count("*").alias("n")).groupBy("area_key").agg(F.max_by("neighbourhood_id", F.struct("n", -F.col("neighbourhood_id").cast("double"))).alias("number"))
    known = areas.join(usual, "area_key", "left")
    if census is not None:
        size = F.when(F.col("households") > 0, F.col("population") / F.col("households"))
        figures = census.select(F.col("area_id"), F.col("population_density").cast("double").alias("density"), size.alias("household"), F.coalesce(F.col("limited_accuracy").cast("boolean"), F.lit(False)).alias("limited"), F.lit(True).alias("in_census"))
        known = known.withColumn("area_id", F.format_string("N%04d", F.col("number").cast("double").cast("long"))).join(figures, "area_id", "left")
    else:
        known = known.withColumns({"density": F.lit(None).cast("double"), "household": F.lit(None).cast("double"), "limited": F.lit(None).cast("boolean"), "in_census": F.lit(None).cast("boolean")})
    if crime is not None:
        known = known.join(crime.groupBy(F.upper("neighbourhood").alias("area_key")).agg(F.sum("incidents").alias("incidents")), "area_key", "left")
    else:
        known = known.withColumn("incidents", F.lit(None).cast("double"))

    own = points.filter(F.trim("m_area") != "").select("target_id", F.upper("m_area").alias("area_key"))
    others = points.join(own.select("target_id"), "target_id", "left_anti")
    centres = areas.select(F.col("area_key").alias("point_id"), F.col("c_lat").alias("p_lat"), F.col("c_lon").alias("p_lon"))
    near = knn(others.select("target_id", "t_lat", "t_lon"), centres, k=25, candidates=25)
    metres = F.round(geo.haversine(F.col("t_lat"), F.col("t_lon"), F.col("p_lat"), F.col("p_lon")), 2)
    found = near.groupBy("target_id").agg(F.min(F.struct(metres.alias("m"), "point_id")).alias("x")).select("target_id", F.col("x.point_id").alias("area_key"))
    columns = ["area", "area_mean", "area_median", "area_count", "density", "household", "limited", "in_census", "incidents"]
    return own.unionByName(found).join(known.select("area_key", *columns), "area_key", "left").drop("area_key")


def _distances(pairs: DataFrame, roads: DataFrame | None) -> DataFrame:
    """(pair_id, metres, minutes, fallback): by road, or straight where there is no road."""
    if roads is not None:
        found = routing.routes(pairs, roads)
        return found.select("pair_id", "road_distance_m", "car_travel_time_s", "fallback").select(
            "pair_id", F.round("road_distance_m", 2).alias("metres"), F.round(F.col("car_travel_time_s") / 60, 2).alias("minutes"), "fallback")
    straight = F.least(F.lit(routing.CAP_M), geo.haversine(F.col("o_lat"), F.col("o_lon"), F.col("d_lat"), F.col("d_lon")))
    return pairs.select("pair_id", F.round(straight, 2).alias("metres"), F.round(F.round(straight / (routing.CAR_KMH / 3.6), 2) / 60, 2).alias("minutes"), F.lit(True).alias("fallback"))


def appraise(
    points: DataFrame, properties: DataFrame, amenities: DataFrame, roads: DataFrame | None = None, census: DataFrame | None = None, crime: DataFrame | None = None,
    predictions: DataFrame | None = None, centres: list[tuple[str, float, float, float]] | None = None, use_models: bool = True,
) -> DataFrame:
    """One row for each point (request_id, lat, lon, and any of ATTRIBUTES), the id unique.

    properties: (location_id, value, neighbourhood, neighbourhood_id, lat, lon, and any of
    ATTRIBUTES); amenities: (kind, entity_id, lat, lon), kinds as in AMENITY_LIMIT; roads:
    (segment_id, points); census: (area_id, population, households, area_sq_km,
    population_density, limited_accuracy); crime: (neighbourhood, incidents); predictions:
    (location_id, ridge, forest). Tables that are None or empty count as not available.

    status: ok, invalid_point (no place on earth), no_property, or no_baseline (the nearest
    property has no value); only ok rows have an estimate.
    """
    centres = V.CENTRES if centres is None else centres
    there = lambda df: df if df is not None and not df.isEmpty() else None
    roads, census, crime, predictions = there(roads), there(census), there(crime), there(predictions) if use_models else None
    told = [c for c in ATTRIBUTES if c in points.columns and c in properties.columns]
    numbers = ("year_built", "bedrooms", "bathrooms", "gross_area", "lot_size")
    typed = lambda c: F.col(c).cast("double") if c in numbers else F.col(c).cast("string")
    good = F.coalesce(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180), F.lit(False))
    asked = materialize(points.select("request_id", good.alias("good"), F.round("lat", 6).alias("t_lat"), F.round("lon", 6).alias("t_lon"), *[typed(c).alias(f"t_{c}") for c in told]), "asked")
    targets = asked.filter("good").drop("good").withColumnRenamed("request_id", "target_id")
    place = targets.select("target_id", "t_lat", "t_lon")
    known = properties.filter("lat is not null and lon is not null")

    nearest = nearest_one(place, known.select(F.col("location_id").alias("point_id"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), F.col("value").alias("base"), F.col("neighbourhood").alias("b_area")), scaled=True)
    metres = F.round(geo.haversine(F.col("t_lat"), F.col("t_lon"), F.col("p_lat"), F.col("p_lon")), 2)
    base = materialize(nearest.select("target_id", F.col("point_id").alias("baseline_id"), F.round("base", 2).alias("base"), metres.alias("baseline_m"), (metres <= MATCH_M).alias("matched"), "b_area"), "baselines")
    around = context(place.join(base.select("target_id", F.when(F.col("matched"), F.col("b_area")).alias("m_area")), "target_id", "left"), properties, census, crime)

    # amenities and employment centres: pairs of places, all distances in one go
    found = knn(place, amenities.filter(F.col("kind").isin(list(AMENITY_LIMIT))).select("kind", F.col("entity_id").alias("point_id"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")), k=max(AMENITY_LIMIT.values()), by="kind")
    limit = F.create_map(*[F.lit(x) for kv in AMENITY_LIMIT.items() for x in kv])
    found = found.filter(F.col("rank") <= F.element_at(limit, F.col("kind"))).select("target_id", "kind", F.col("rank").cast("int").alias("rank"), F.col("point_id").cast("string").alias("entity_id"), "t_lat", "t_lon", "p_lat", "p_lon")
    jobs = F.array(*[F.struct(F.lit("centre").alias("kind"), F.lit(i).alias("rank"), F.lit(n).alias("entity_id"), F.lit(a).alias("p_lat"), F.lit(b).alias("p_lon")) for i, (n, a, b, _) in enumerate(centres)])
    pairs = found.unionByName(place.select("*", F.inline(jobs))) if centres else found
    pairs = materialize(pairs.withColumn("pair_id", F.concat_ws("|", F.col("target_id").cast("string"), "kind", F.col("rank").cast("string"))), "place-pairs")
    far = _distances(pairs.select("pair_id", F.col("t_lat").alias("o_lat"), F.col("t_lon").alias("o_lon"), F.col("p_lat").alias("d_lat"), F.col("p_lon").alias("d_lon")), roads)
    reached = pairs.join(far, "pair_id")
    weight = F.element_at(F.array(*[F.lit(float(w)) for *_, w in centres] or [F.lit(1.0)]), F.col("rank") + 1)
    is_centre, is_first = F.col("kind") == "centre", F.col("rank") == 1
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("minutes") / COMMUTE_MIN))
    by_point = reached.groupBy("target_id").agg(
        *[F.min(F.when((F.col("kind") == k) & is_first, F.col("metres"))).alias(f"d_{k}") for k in AMENITY_LIMIT], *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in AMENITY_LIMIT],
        (F.sum(F.when(is_centre, F.round(score * weight, 9))) / sum(w for *_, w in centres) if centres else F.lit(None).cast("double")).alias("commute"), F.max("fallback").alias("straight"), F.coalesce(F.max(F.when(is_centre, F.col("fallback"))), F.lit(False)).alias("commute_straight"))

    columns = [c for c in told]
    others = known.filter("value is not null").select(F.col("location_id").alias("point_id"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), *[typed(c).alias(c) for c in columns], "value")
    near = materialize(comparables(targets, others, _matches(told), COMPARABLES), "comparables")
    ids = near.groupBy("target_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("rank", "point_id")))), lambda x: x["point_id"]).alias(n) for n, c in (("comparables_matching", F.col("matching")), ("comparables_other", ~F.col("matching")))])

    rows = asked.withColumnRenamed("request_id", "target_id")
    for part in (base, around, by_point, V.compared_values(near), ids):
        rows = rows.join(part, "target_id", "left")
    if predictions is not None:
        rows = rows.join(predictions.select(F.col("location_id").alias("baseline_id"), "ridge", "forest"), "baseline_id", "left")
    city = (None, None)
    if census is not None:
        city = census.filter("area_sq_km > 0 and households > 0 and population > 0").agg(F.avg("population_density"), F.avg(F.col("population") / F.col("households"))).first()
    base_ = F.col("base")
    parts: dict[str, Column] = {"matching_comparables": V.compared(base_, F.col("m_median"), "matching"), "nearby_comparables": V.compared(base_, F.col("n_median"), "nearby"), "neighbourhood_context": V.compared(base_, F.round("area_mean", 2), "neighbourhood")}
    in_census = F.lit(False)
    if census is not None and city[0] and city[1]:
        in_census = (F.col("density") > 0) & (F.col("household") > 0)
        parts["census_indicators"] = F.coalesce(V.census_adjustment(base_, F.col("density"), F.col("household"), F.lit(city[0]), F.lit(city[1]), F.coalesce("limited", F.lit(False))), F.lit(0.0))
    parts |= {f"{k}_access": V.amenity_adjustment(base_, F.col(f"d_{k}"), k) for k in AMENITY_LIMIT}
    parts["commute_accessibility"] = F.coalesce(base_ * 0.03 * (F.col("commute") - 0.35), F.lit(0.0))
    if predictions is not None:
        positive = lambda c: F.when((F.col(c) > 0) & F.col("matched"), F.col(c))
        parts["neighbourhood_value_model"] = model_adjustment(base_, positive("ridge"), positive("forest"))
    raw = reduce(lambda a, b: a + b, parts.values(), base_)
    rows = rows.withColumn("raw", raw)
    guarded = (F.col("raw") < V.LOW_RAIL * base_) | (F.col("raw") > V.HIGH_RAIL * base_)

    some = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    has = {**{k: some(f"n_{k}") for k in AMENITY_LIMIT}, "commute": F.col("commute").isNotNull(), "neighbourhood": F.col("area_mean").isNotNull(), "crime": F.lit(crime is not None) & F.col("area").isNotNull(), "census": F.col("in_census").isNotNull(), "comparables": some("c_count")}
    completeness = F.round(F.least(F.lit(100.0), reduce(lambda a, b: a + b, [F.when(c, WEIGHTS[k]).otherwise(0.0) for k, c in has.items()])), 2)
    tells = reduce(lambda a, b: a | b, [F.coalesce(F.trim(F.col(f"t_{c}").cast("string")) != "", F.lit(False)) for c in told], F.lit(False))
    no_match = tells & F.col("m_median").isNull()
    no_area = F.col("area").isNull()
    unmatched = ~F.col("matched")
    missing = _codes(*[(~has[k], MISSING[k]) for k in AMENITY_LIMIT], (~has["commute"], "commute_accessibility"), (no_area, "neighbourhood_context"), (~no_area & F.lit(crime is None), "crime_statistics"), (~no_area & F.lit(census is None), "census_indicators"), (no_match, "matching_comparables"), (~has["comparables"], "comparables"))
    flags = _codes((F.lit(not use_models), "neighbourhood_value_model_disabled"), (unmatched, "baseline_nearest_neighbour"), (F.coalesce("straight", F.lit(False)), "straight_line_distance"), (F.coalesce("commute_straight", F.lit(False)), "commute_routing_fallback"), (F.coalesce(guarded, F.lit(False)), "valuation_guardrail"))
    warnings = _codes(
        (F.lit(not use_models), "neighbourhood_value_model_disabled"), (unmatched, "baseline_nearest_neighbour"), *[(~has[k], f"{k}_unavailable") for k in AMENITY_LIMIT], (F.coalesce("straight", F.lit(False)), "straight_line_fallback"), (~has["commute"], "employment_centers_unavailable"),
        (no_area, "neighbourhood_unavailable"), (~no_area & F.lit(crime is None), "crime_unavailable"), (~no_area & F.lit(census is None), "census_unavailable"), (~no_area & F.lit(census is not None) & F.col("in_census").isNull(), "census_neighbourhood_unavailable"),
        (no_match, "matching_comparables_unavailable"), (~has["comparables"], "comparables_unavailable"), (F.coalesce(guarded, F.lit(False)), "valuation_guardrail"), (~has["comparables"], "range_low_reliability"))
    rows = rows.withColumns({"completeness": completeness, "missing_factors": F.array_sort(missing), "fallback_flags": F.array_sort(flags), "warnings": warnings})

    estimate = money(V.clip(F.col("raw"), V.LOW_RAIL * base_, V.HIGH_RAIL * base_))
    wide = 0.12 + F.when(has["comparables"], F.least(F.lit(0.12), F.col("c_spread") / F.greatest(base_, F.lit(1.0)))).otherwise(0.08) + F.greatest(F.lit(0.0), (100 - F.col("completeness")) / 250)
    wide = V.clip(wide, 0.08, 0.38)
    sure = F.col("completeness") + F.when(F.col("matched"), 14.0).otherwise(0.0) - 4.0 * F.size("missing_factors") - 3.5 * F.size("fallback_flags") + F.when(F.col("m_median").isNotNull(), 6.0).when(F.col("n_median").isNotNull(), 2.0).otherwise(0.0)
    sure = F.round(V.clip(sure, 5.0, 99.0), 2)
    status = F.when(~F.col("good"), "invalid_point").when(F.col("baseline_id").isNull(), "no_property").when(base_.isNull(), "no_baseline").otherwise("ok")
    fine = status == "ok"
    adjustments = F.array(*[F.struct(F.lit(n).alias("code"), F.when(told_, F.round(c, 2)).alias("value")) for n, c, told_ in ((n, c, _evidence(n, in_census)) for n, c in parts.items())])
    adjustments = F.filter(adjustments, lambda a: a["value"].isNotNull())
    ranked = F.array_sort(adjustments, lambda a, b: F.when(F.abs(a["value"]) != F.abs(b["value"]), F.signum(F.abs(b["value"]) - F.abs(a["value"])).cast("int")).when(a["code"] < b["code"], 1).when(a["code"] > b["code"], -1).otherwise(0))
    labels = reduce(lambda c, x: c.when(F.col("commute") >= x[0], x[1]), COMMUTE_LABELS[1:], F.when(F.col("commute") >= COMMUTE_LABELS[0][0], COMMUTE_LABELS[0][1])).when(F.col("commute").isNotNull(), "low").otherwise("neutral")
    rows = rows.withColumns({"estimate": estimate, "adjustments": ranked})
    top = lambda keep: F.transform(F.slice(F.filter("adjustments", keep), 1, 3), lambda a: a["code"])
    only = lambda c: F.when(fine, c)
    return rows.select(
        F.col("target_id").alias("request_id"), status.alias("status"), "baseline_id", F.when(F.col("matched"), "matched_property_assessment").when(F.col("baseline_id").isNotNull(), "nearest_neighbour_assessment").alias("baseline_type"), "base", "baseline_m",
        F.when(F.col("matched"), F.col("baseline_id")).alias("matched_property"), only(F.col("estimate")).alias("estimate"), only(F.when(F.col("matched"), F.round(F.col("estimate") - base_, 2))).alias("estimate_minus_assessed"),
        only(money(F.col("estimate") * (1 - wide))).alias("low"), only(F.greatest("estimate", money(F.col("estimate") * (1 + wide)))).alias("high"), only(F.col("completeness")).alias("completeness"), only(sure).alias("confidence"), only(V.confidence_label(sure)).alias("label"),
        only(F.col("adjustments")).alias("adjustments"), only(top(lambda a: a["value"] > 0)).alias("top_positive"), only(top(lambda a: a["value"] < 0)).alias("top_negative"), only(F.col("missing_factors")).alias("missing_factors"), only(F.col("fallback_flags")).alias("fallback_flags"),
        only(F.col("warnings")).alias("warnings"), "area", F.round("commute", 4).alias("commute_index"), labels.alias("commute_label"), *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in AMENITY_LIMIT], "comparables_matching", "comparables_other")


def _evidence(name: str, in_census: Column) -> Column:
    """Whether an adjustment of this name was made."""
    column = {"matching_comparables": "m_median", "nearby_comparables": "n_median", "neighbourhood_context": "area_mean", "commute_accessibility": "commute"}.get(name)
    if column:
        return F.col(column).isNotNull()
    if name == "census_indicators":
        return F.coalesce(in_census, F.lit(False))
    if name == "neighbourhood_value_model":
        return F.coalesce(F.col("matched") & ((F.col("ridge") > 0) | (F.col("forest") > 0)), F.lit(False))
    return F.col(f"d_{name.removesuffix('_access')}").isNotNull()
