"""The enrichment run: rooms of properties from listings, earlier observations, permits and a model.

Steps, in order: observed matching, back-fill of locations, permits, training, imputation,
promotion, report. Each step's rows are staged under the run, so a step never reads what
another run wrote, and the promotion (of attributes, and of back-filled locations) becomes
visible by one marker. The target is the live table, a shadow table, or none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.functions.text import permit_rooms
from parcelforge.operators import matching
from parcelforge.operators.entity import PRECEDENCE
from parcelforge.operators.records import training_rows
from parcelforge.sources.store import Store

LIVE, SHADOW = "property_attributes", "property_attributes_shadow"
#: What is staged for a property, and promoted.
ATTRIBUTES = (
    "location_id string, bedrooms bigint, bathrooms double, bedrooms_estimated bigint, bathrooms_estimated double, source_type string, source_name string, source_record_id string, confidence double, match_method string, "
    "ambiguous boolean, quarantined boolean, reason_code string"
)
COLUMNS = [c.split()[0] for c in ATTRIBUTES.split(", ")]
#: Columns that a back-fill may set.
LOCATION = ["suite", "house", "street", "lat", "lon"]
#: Properties alike in these share the model's guess.
GROUP = ["zoning", "tax_class", "garage", "neighbourhood"]
# How sure a guess is where the group is known, and where it isn't.
KNOWN_GROUP, UNKNOWN_GROUP = 0.78, 0.64


@dataclass(frozen=True)
class Settings:
    fuzzy_threshold: float = 0.90
    observed_least: float = 0.85
    imputation_least: float = 0.70
    training_least: float = 0.90
    training_rows: int = 25
    target: str = "production"  # or shadow, or disabled
    backfill: bool = False
    overwrite: bool = False


def _shaped(rows: DataFrame) -> DataFrame:
    """ATTRIBUTES in order; columns that are missing are null."""
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in (c.split() for c in ATTRIBUTES.split(", "))])


def _from_sources(matches: DataFrame, sources: DataFrame, source_type: str, name: str) -> DataFrame:
    named = F.coalesce(F.col("source_name"), F.lit(name)) if "source_name" in sources.columns else F.lit(name)
    told = sources.select("source_record_id", F.col("bedrooms").cast("bigint").alias("bedrooms"), F.col("bathrooms").cast("double").alias("bathrooms"), named.alias("source_name"))
    return matches.join(told, "source_record_id").withColumn("source_type", F.lit(source_type))


def observed(properties: DataFrame, listings: DataFrame, prior: DataFrame, settings: Settings) -> DataFrame:
    """Of listings and earlier observations the surer match of each property (ties: the observation), each record for one property only."""
    parts = []
    for order, (name, rows) in enumerate((("listing_api", listings), ("prior_observed_recovery", prior))):
        told = rows.filter("bedrooms is not null or bathrooms is not null")
        found = matching.match(properties, told, settings.fuzzy_threshold).filter(F.col("confidence") >= settings.observed_least)
        parts.append(_from_sources(found, told, "observed", name).withColumn("order", F.lit(order)))
    both = parts[0].unionByName(parts[1])
    best = Window.partitionBy("location_id").orderBy(F.col("confidence").desc(), F.col("order").desc())
    one = both.withColumn("place", F.row_number().over(best)).filter("place = 1")
    return _shaped(_kept(one))


def _kept(staged: DataFrame) -> DataFrame:
    """The rows that keep their source record, with what that says of their quarantine."""
    held = ["match_method", "ambiguous", "quarantined", "reason_code"]
    chosen = matching.one_property_each(staged.select("location_id", "source_record_id", "confidence", *held))
    return staged.drop(*held, "source_record_id", "confidence").join(chosen, "location_id")


def permits(properties: DataFrame, records: DataFrame, staged: DataFrame, settings: Settings) -> DataFrame:
    """Rooms that permits' texts tell, for properties without an observation."""
    parsed = records.withColumn("rooms", permit_rooms(F.col("description"))).filter("rooms.confidence is not null")
    parsed = parsed.select(*[c for c in records.columns if c not in ("bedrooms", "bathrooms")], F.col("rooms.bedrooms").alias("bedrooms"), F.col("rooms.bathrooms").alias("bathrooms"), F.col("rooms.confidence").alias("told"))
    rest = properties.join(staged.select("location_id"), "location_id", "left_anti")
    found = matching.match(rest, parsed, settings.fuzzy_threshold)
    rows = _from_sources(found, parsed, "inferred", "permit_text").join(parsed.select("source_record_id", "told"), "source_record_id")
    rows = rows.withColumns({"confidence": F.col("confidence") * F.col("told"), "match_method": F.lit("permit_text")}).drop("told")
    return _shaped(_kept(rows))


def _rank(source_type: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRECEDENCE.items() for x in kv]), source_type), F.lit(0))


def preferred(current: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ATTRIBUTES after ``new`` came upon ``current``, one row a location on either side.

    The higher precedence, then the higher confidence, holds, the new row winning ties; what
    loses fills gaps of the estimates only. Estimates are replaced by imputed rows alone.
    """
    o, n = current.alias("o"), new.alias("n")
    joined = o.join(n, F.col("o.location_id") == F.col("n.location_id"), "full_outer")
    fresh, none = F.col("o.location_id").isNull(), F.col("n.location_id").isNull()
    ranks = [_rank(F.col(f"{s}.source_type")) for s in "no"]
    sure = [F.coalesce(F.col(f"{s}.confidence"), F.lit(0.0)) for s in "no"]
    take = fresh | (~none & ((ranks[0] > ranks[1]) | ((ranks[0] == ranks[1]) & (sure[0] >= sure[1]))))
    pick = lambda c: F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    guess = lambda c: F.when(fresh | (take & (F.col("n.source_type") == "imputed")), F.col(f"n.{c}")).when(take, F.col(f"o.{c}")).otherwise(F.coalesce(f"o.{c}", f"n.{c}")).alias(c)
    guesses = ("bedrooms_estimated", "bathrooms_estimated")
    return joined.select(F.coalesce("o.location_id", "n.location_id").alias("location_id"), *[guess(c) if c in guesses else pick(c) for c in COLUMNS[1:]])


def imputed(properties: DataFrame, staged: DataFrame, current: DataFrame, settings: Settings) -> tuple[DataFrame, int]:
    """Guesses for properties without told rooms, and the number of rows learned from; too few give no guesses.

    Learned from sure rows of this run and live observations. Bedrooms: the group's most
    frequent number (least on ties); bathrooms: its mean, to the half; what the group lacks
    comes from all rows. A group that is unknown altogether is guessed too unsurely to stay.
    """
    spark = properties.sparkSession
    learned = training_rows(preferred(_shaped(staged), _shaped(current.filter("source_type = 'observed'"))), settings.training_least)
    learned = learned.select("location_id", "bedrooms", "bathrooms").join(properties.select("location_id", *GROUP), "location_id")
    n = learned.count()
    if n < settings.training_rows:
        return spark.createDataFrame([], ATTRIBUTES), n
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(c) for c in GROUP]  # nulls are a group
    votes = learned.filter("bedrooms is not null").groupBy(*keys, "bedrooms").agg(F.count("*").alias("n"))
    most = F.max_by("bedrooms", F.struct("n", -F.col("bedrooms")))
    beds, baths = votes.groupBy(*GROUP).agg(most.alias("g_beds")), learned.filter("bathrooms is not null").groupBy(*keys).agg(F.avg("bathrooms").alias("g_baths"))
    whole_beds = votes.groupBy("bedrooms").agg(F.sum("n").alias("n")).agg(most).first()[0]
    whole_baths = learned.agg(F.avg("bathrooms")).first()[0]
    asked = properties.join(staged.filter("bedrooms is not null or bathrooms is not null").select("location_id"), "location_id", "left_anti").select("location_id", *keys)
    rows = asked.join(beds, GROUP, "left").join(baths, GROUP, "left")
    sure = F.when(F.col("g_beds").isNotNull() | F.col("g_baths").isNotNull(), KNOWN_GROUP).otherwise(UNKNOWN_GROUP)
    half = F.bround(F.coalesce("g_baths", F.lit(2.0 if whole_baths is None else whole_baths)) * 2, 0) / 2
    out = rows.select("location_id", F.coalesce("g_beds", F.lit(3 if whole_beds is None else whole_beds)).alias("bedrooms_estimated"), half.alias("bathrooms_estimated"), sure.alias("confidence"))
    out = out.filter(F.col("confidence") >= settings.imputation_least).withColumns({"source_type": F.lit("imputed"), "source_name": F.lit("grouped-v1"), "match_method": F.lit("model_imputation"), "ambiguous": F.lit(False), "quarantined": F.lit(False)})
    return _shaped(out), n


def backfilled(properties: DataFrame, staged: DataFrame, sources: DataFrame, overwrite: bool) -> tuple[DataFrame, DataFrame]:
    """(properties, updates): LOCATION columns from the sources of observations that aren't quarantined, where they are blank or, with ``overwrite``, in any case; updates are (location_id, field)."""
    given = sources.select("source_record_id", *[(F.col(c) if c in sources.columns else F.lit(None)).cast(dict(properties.dtypes)[c]).alias(f"new_{c}") for c in LOCATION])
    good = staged.filter("source_type = 'observed' and not quarantined").select("location_id", "source_record_id").join(given, "source_record_id").drop("source_record_id")
    rows = properties.join(good, "location_id", "left")
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    change = {c: ~blank(f"new_{c}") & (F.lit(overwrite) | blank(c)) for c in LOCATION}
    updates = rows.select("location_id", F.explode(F.array_compact(F.array(*[F.when(change[c], F.lit(c)) for c in LOCATION]))).alias("field"))
    return rows.select(*[F.when(change[c], F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in LOCATION else F.col(c) for c in properties.columns]), updates


def review_rows(staged: DataFrame, properties: DataFrame, sources: DataFrame, unmatched: DataFrame) -> DataFrame:
    """What people look at: staged rows held back, source records without a property, and properties that share an address without unit; each field the source's value, else the property's."""
    fields = ["suite", "house", "street", "legal_description", "lat", "lon"]
    typed = lambda df, c: (F.col(c) if c in df.columns else F.lit(None)).cast("double" if c in ("lat", "lon") else "string")
    p = properties.select("location_id", *[typed(properties, c).alias(f"p_{c}") for c in fields])
    s = sources.select("source_record_id", *[typed(sources, c).alias(f"s_{c}") for c in fields], typed(sources, "address").alias("written"))
    base = matching.address(F.lit(None), F.col("p_house"), F.col("p_street"), F.lit(None), F.lit(None))["base"]
    shared = Window.partitionBy("base")
    alike = p.withColumn("base", base).filter("base is not null").withColumn("n", F.count("*").over(shared)).filter("n > 1")
    label = lambda df, kind, method, reason: df.select("location_id", "source_record_id", kind.alias("source_type"), method.alias("match_method"), reason.alias("reason_code"), "confidence")
    null = lambda t: F.lit(None).cast(t)
    rows = label(staged.filter("ambiguous or quarantined"), F.col("source_type"), F.col("match_method"), F.col("reason_code"))
    rows = rows.unionByName(label(unmatched.withColumns({"location_id": null("string"), "confidence": null("double")}), F.lit("unmatched"), F.lit("unmatched_source_record"), F.col("reason_code")))
    same = F.lit("duplicate_base_address_group")
    rows = rows.unionByName(label(alike.select("location_id").withColumns({"source_record_id": null("string"), "confidence": null("double")}), F.lit("property_candidate"), same, same))
    joined = rows.join(s, "source_record_id", "left").join(p, "location_id", "left")
    chosen = {c: F.coalesce(F.nullif(F.col(f"s_{c}"), F.lit("")) if c not in ("lat", "lon") else F.col(f"s_{c}"), F.col(f"p_{c}")) for c in fields}
    a = matching.address(chosen["suite"], chosen["house"], chosen["street"], F.col("written"), F.lit(None))
    raw = F.coalesce(F.nullif(F.trim("written"), F.lit("")), F.nullif(F.concat_ws(" ", "s_suite", "s_house", "s_street"), F.lit("")))
    return joined.select("location_id", "source_record_id", "source_type", "match_method", "reason_code", "confidence", F.coalesce(a["full"], a["base"]).alias("normalized_address"), raw.alias("raw_source_address"), *[v.alias(c) for c, v in chosen.items()])


def run(store: Store, run_id: str, properties: DataFrame, listings: DataFrame, prior: DataFrame, permit_records: DataFrame, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """All steps; returns the staged rows, the review rows, the step log, and what was promoted.

    A step that fails is logged as such and ends the run, before anything is promoted.
    """
    if settings.target not in ("production", "shadow", "disabled"):
        raise ValueError(f"unknown target {settings.target}")
    spark, log = store.spark, []

    def step(name: str, work: Callable):
        began = datetime.now(UTC)
        try:
            out = work()
        except Exception as error:
            log.append((run_id, name, "failed", began, datetime.now(UTC), str(error)[:2000]))
            _log(store, log)
            raise
        log.append((run_id, name, "succeeded", began, datetime.now(UTC), None))
        return out

    sources = listings.select("source_record_id", *[c for c in (*LOCATION, "legal_description", "address") if c in listings.columns]).unionByName(prior.select("source_record_id", *[c for c in (*LOCATION, "legal_description", "address") if c in prior.columns]), allowMissingColumns=True)
    table = SHADOW if settings.target == "shadow" else LIVE
    current = store.read(LIVE) if store.version(LIVE) else spark.createDataFrame([], ATTRIBUTES)
    seen = step("observed matching", lambda: store.stage("observed", run_id, observed(properties, listings, prior, settings)))
    located, updates = properties, spark.createDataFrame([], "location_id string, field string")
    if settings.backfill:
        located, updates = step("location backfill", lambda: backfilled(properties, seen, sources, settings.overwrite))
        updates = store.stage("backfill", run_id, updates)
    else:
        log.append((run_id, "location backfill", "skipped", datetime.now(UTC), datetime.now(UTC), None))
    told = step("permit parsing", lambda: store.stage("permits", run_id, permits(properties, permit_records, seen, settings)))
    both = seen.unionByName(told)
    guesses, learned = step("imputation", lambda: imputed(properties, both, current, settings))
    staged = store.stage("attributes", run_id, both.unionByName(guesses))
    target = current if table == LIVE else store.read(SHADOW) if store.version(SHADOW) else spark.createDataFrame([], ATTRIBUTES)
    after = preferred(_shaped(target), staged)
    if settings.target != "disabled":
        step("promotion", lambda: store.promote_together({table: after} | ({"property_locations": located} if settings.backfill and settings.target == "production" else {}), run_id))
    else:
        log.append((run_id, "promotion", "disabled", datetime.now(UTC), datetime.now(UTC), None))
    unmatched = matching.unmatched_reasons(properties, listings, seen)
    review = step("reporting", lambda: store.stage("review", run_id, review_rows(staged, properties, sources, unmatched)))
    report = staged.groupBy("source_type").agg(F.count("*").alias("rows"), F.count_if("ambiguous").alias("ambiguous"), F.count_if("quarantined").alias("quarantined")).withColumn("learned_from", F.lit(learned))
    return {"staged": staged, "review": review, "updates": updates, "report": report, "steps": _log(store, log), "attributes": store.read(table) if settings.target != "disabled" else current}


def _log(store: Store, log: list[tuple]) -> DataFrame:
    rows = store.spark.createDataFrame(log, "run_id string, step string, status string, started_at timestamp, completed_at timestamp, error string")
    store.log("enrichment_steps", rows)
    return rows
