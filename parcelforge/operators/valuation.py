"""Explainable valuation in batch: baseline, adjustments, guard rails, range, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions import geo
from parcelforge.functions.text import money
from parcelforge.operators.nearest import comparables, knn

# Fixed values of the valuation rules.
#: group: (distance at which access is worth nothing, share of the baseline it can move)
AMENITIES = {"parks": (1400.0, 0.018), "playgrounds": (1200.0, 0.012), "schools": (2000.0, 0.02), "libraries": (3500.0, 0.01)}
#: cap and pull of each comparison with the baseline
COMPARED = {"matching": (0.12, 0.55), "nearby": (0.08, 0.25), "neighbourhood": (0.06, 0.18)}
LOW_RAIL, HIGH_RAIL = 0.65, 1.35
#: what each kind of evidence adds to completeness (100 in all)
COMPLETENESS = {"parks": 12.0, "playgrounds": 10.0, "schools": 12.0, "libraries": 8.0, "commute": 10.0, "neighbourhood": 14.0, "crime": 8.0, "census": 8.0, "comparables": 18.0}
#: employment centres: name, lat, lon, weight; the indices fall to zero at COMMUTE_M metres
CENTRES = [
    ("downtown", 53.5461, -113.4938, 1.0), ("west edmonton mall", 53.523, -113.6227, 0.9), ("strathcona", 53.5182, -113.4973, 0.9), ("university", 53.5232, -113.5263, 0.9),
    ("kingsway", 53.556998, -113.503331, 0.75), ("northgate", 53.5979, -113.4889, 0.75), ("south edmonton common", 53.4468, -113.4849, 0.8),
]
COMMUTE_M = 15_000.0
#: metres and what a feature within them is worth
STEPS = [(500.0, 5000.0), (1000.0, 2000.0), (2000.0, 500.0)]


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    """``x`` between its limits; null stays null (least and greatest alone would pass over it)."""
    col = lambda v: F.lit(v) if isinstance(v, float) else v
    return F.when(x.isNotNull(), F.greatest(col(low), F.least(x, col(high))))


def compared(base: Column, other: Column, kind: str) -> Column:
    cap, pull = COMPARED[kind]
    return F.coalesce(clip((other - base) * pull, -cap * base, cap * base), F.lit(0.0))


def amenity_adjustment(base: Column, metres: Column, group: str) -> Column:
    far, share = AMENITIES[group]
    return F.coalesce(base * share * (clip(1 - metres / far, 0.0, 1.0) - 0.35), F.lit(0.0))


def commute_index(lat: Column, lon: Column) -> Column:
    """Weighted mean of nearness to the employment centres."""
    total = sum(w for *_, w in CENTRES)
    near = [clip(1 - geo.haversine(lat, lon, F.lit(a), F.lit(b)) / COMMUTE_M, 0.0, 1.0) * w for _, a, b, w in CENTRES]
    out = near[0]
    for x in near[1:]:
        out = out + x
    return out / total


def census_adjustment(base: Column, density: Column, household: Column, city_density: Column, city_household: Column, limited: Column) -> Column:
    d = clip((density - city_density) / city_density, -1.0, 1.0)
    h = clip((household - city_household) / city_household, -1.0, 1.0)
    value = clip(clip(base * (0.012 * d + 0.008 * h), -0.025 * base, 0.025 * base), -60_000.0, 60_000.0)
    fine = (city_density > 0) & (city_household > 0) & (density > 0) & (household > 0)
    return F.when(fine, F.when(limited, value * 0.5).otherwise(value)).otherwise(0.0)


def step_factor(metres: Column, sign: int = 1) -> Column:
    out = F.when(metres <= STEPS[0][0], sign * STEPS[0][1])
    for far, worth in STEPS[1:]:
        out = out.when(metres <= far, sign * worth)
    return out.otherwise(0.0)


def confidence_label(score: Column) -> Column:
    return F.when(score >= 80, "high").when(score >= 60, "medium").when(score >= 40, "low").otherwise("very_low")


def similar(a: str, b: str, part: float) -> Column:
    """The second lies within a share of the first; what the target doesn't tell decides nothing, what the neighbour doesn't tell excludes it."""
    return F.col(a).isNull() | F.coalesce(F.col(b).between(F.col(a) * (1 - part), F.col(a) * (1 + part)), F.lit(False))


def close_to(a: str, b: str, far: float) -> Column:
    return F.col(a).isNull() | F.coalesce(F.abs(F.col(a) - F.col(b)) <= far, F.lit(False))


def same_text(a: str, b: str) -> Column:
    return F.coalesce(F.trim(a) == "", F.lit(True)) | (F.upper(F.trim(F.coalesce(b, F.lit("")))) == F.upper(F.trim(a)))


def comparable_rule() -> Column:
    """The target (t_ columns) and a neighbour agree in year, rooms, areas and tax class, as far as the target tells them, and it tells one at least."""
    known = F.lit(False)
    for c in ("t_year_built", "t_bedrooms", "t_bathrooms", "t_gross_area", "t_lot_size", "t_tax_class"):
        known = known | F.col(c).isNotNull()
    return (
        known & close_to("t_year_built", "year_built", 5) & close_to("t_bedrooms", "bedrooms", 1.0) & close_to("t_bathrooms", "bathrooms", 0.5)
        & similar("t_gross_area", "gross_area", 0.2) & similar("t_lot_size", "lot_size", 0.2) & same_text("t_tax_class", "tax_class")
    )


def compared_values(near: DataFrame) -> DataFrame:
    """(target_id, m_median, n_median, c_count, c_median, c_spread) of the comparables of each target, a few values each: medians of those that match, those that don't, all, and the mean deviation from the last."""
    lists = near.groupBy("target_id").agg(*[F.array_sort(F.collect_list(F.when(c, F.col("value")))).alias(n) for n, c in (("m", F.col("matching")), ("n", ~F.col("matching")), ("c", F.lit(True)))])
    middle = lambda n: F.when(F.size(n) > 0, (F.get(n, F.floor((F.size(n) - 1) / 2).cast("int")) + F.get(n, F.floor(F.size(n) / 2).cast("int"))) / 2)
    out = lists.select("target_id", "c", middle("m").alias("m_median"), middle("n").alias("n_median"), middle("c").alias("c_median"), F.size("c").cast("long").alias("c_count"))
    spread = F.aggregate("c", F.lit(0.0), lambda s, v: s + F.abs(v - F.col("c_median"))) / F.col("c_count")
    return out.withColumn("c_spread", F.when(F.col("c_count") > 0, spread)).drop("c")


def value_all(properties: DataFrame, pois: DataFrame, groups: dict[str, str], k: int = 5) -> DataFrame:
    """One valuation for every property with a value, the property itself being its baseline.

    groups: amenity group to point category. Comparables are the other properties nearby.
    """
    rows = properties.filter("value is not null and lat is not null and lon is not null")
    rooms = lambda c, kind: F.col(c).cast(kind) if c in properties.columns else F.lit(None).cast(kind)
    targets = rows.select(F.col("location_id").alias("target_id"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"), F.col("year_built").alias("t_year_built"), F.col("gross_area").alias("t_gross_area"), F.col("lot_size").alias("t_lot_size"), F.col("tax_class").alias("t_tax_class"), rooms("bedrooms", "double").alias("t_bedrooms"), rooms("bathrooms", "double").alias("t_bathrooms"), F.col("neighbourhood").alias("t_neighbourhood"), F.col("value").alias("base"))
    points = rows.select(F.col("location_id").alias("point_id"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), "year_built", "gross_area", "lot_size", "tax_class", rooms("bedrooms", "double").alias("bedrooms"), rooms("bathrooms", "double").alias("bathrooms"), "value")
    near = comparables(targets, points, comparable_rule(), k).filter("target_id != point_id")
    out = targets.join(compared_values(near), "target_id", "left")
    context = rows.groupBy(F.col("neighbourhood").alias("t_neighbourhood")).agg(F.avg("value").alias("area_mean"))
    out = out.join(context, "t_neighbourhood", "left")
    kinds = {category: group for group, category in groups.items()}
    there = pois.filter(F.col("category").isin(list(kinds))).select(F.col("entity_id").alias("point_id"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), "category")
    first = knn(targets.select("target_id", "t_lat", "t_lon"), there, k=1, by="category")
    out = out.join(first.groupBy("target_id").agg(*[F.min(F.when(F.col("category") == c, F.col("distance"))).alias(f"d_{g}") for c, g in kinds.items()]), "target_id", "left")
    base = F.col("base")
    parts = {
        "adj_matching": compared(base, F.col("m_median"), "matching"), "adj_nearby": compared(base, F.col("n_median"), "nearby"), "adj_neighbourhood": compared(base, F.col("area_mean"), "neighbourhood"),
        **{f"adj_{g}": amenity_adjustment(base, F.col(f"d_{g}"), g) for g in groups},
        "adj_commute": base * 0.03 * (commute_index(F.col("t_lat"), F.col("t_lon")) - 0.35),
    }
    out = out.withColumns(parts)
    total = base
    for name in parts:
        total = total + F.col(name)
    complete = sum((F.when(F.col(f"d_{g}").isNotNull(), COMPLETENESS[g]).otherwise(0.0) for g in groups), F.lit(COMPLETENESS["commute"]))
    complete = complete + F.when(F.col("area_mean").isNotNull(), COMPLETENESS["neighbourhood"]).otherwise(0.0) + F.when(F.col("c_count") > 0, COMPLETENESS["comparables"]).otherwise(0.0)
    out = out.withColumns({"raw": total, "completeness": F.least(F.lit(100.0), complete)})
    out = out.withColumns({"estimate": clip(F.col("raw"), LOW_RAIL * base, HIGH_RAIL * base), "guarded": (F.col("raw") < LOW_RAIL * base) | (F.col("raw") > HIGH_RAIL * base)})
    wide = 0.12 + F.when(F.col("c_count") > 0, F.least(F.lit(0.12), F.col("c_spread") / F.greatest(base, F.lit(1.0)))).otherwise(0.08) + F.greatest(F.lit(0.0), (100 - F.col("completeness")) / 250)
    spread_ratio = clip(wide, 0.08, 0.38)
    score = F.col("completeness") + 14.0 + F.when(F.col("m_median").isNotNull(), 6.0).when(F.col("n_median").isNotNull(), 2.0).otherwise(0.0) - F.when(F.col("guarded"), 3.5).otherwise(0.0)
    score = clip(score, 5.0, 99.0)
    return out.select(
        F.col("target_id").alias("location_id"), "base", *parts, "completeness", "guarded", money(F.col("estimate")).alias("estimate"),
        money(F.col("estimate") * (1 - spread_ratio)).alias("low"), money(F.col("estimate") * (1 + spread_ratio)).alias("high"), F.round(score, 2).alias("confidence"), confidence_label(score).alias("label"))
