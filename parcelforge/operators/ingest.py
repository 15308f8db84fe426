"""Ingestion: quarantine, duplicate choice, order-sensitive merge folds, census and crime shaping, quality rates.

Every fold is written with an explicit arrival number (``ordinal``), so its result doesn't
depend on how Spark deals the rows; all are aggregates with partial sums, no collected groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.functions.text import first_known, leading_year


def quarantine(records: DataFrame) -> DataFrame:
    """All records with a reason_code; null where the record is valid."""
    reason = (
        F.when(F.col("record_id").isNull() | (F.trim("record_id") == ""), "missing_record_id")
        .when(F.col("lat").isNull() | F.col("lon").isNull(), "missing_coordinates")
        .when(F.col("value").isNull(), "missing_value")
        .when(F.col("value") <= 0, "invalid_value")
    )
    return records.withColumn("reason_code", reason)


def distinct_ids(records: DataFrame, key: str, tag: str) -> DataFrame:
    """The nth record with the same key, in arrival order, gets a suffix from its second on."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("ordinal"))
    return records.withColumn("_n", n).withColumn("unique_id", F.when(F.col("_n") == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit(f"__{tag}"), F.col("_n").cast("string")))).drop("_n")


def choose_assessment(records: DataFrame) -> DataFrame:
    """One record of each location: greatest confidence, then value, then the first to arrive; locations whose choice has no value go."""
    best = F.max_by(F.struct("record_id", "value", "confidence", "year"), F.struct(F.col("confidence"), F.coalesce("value", F.lit(-1.0)), -F.col("ordinal")))
    return records.groupBy("location_id").agg(best.alias("r")).select("location_id", "r.*").filter("value is not null")


def first_text(column: str) -> Column:
    """The first text that isn't blank, in arrival order."""
    known = first_known(F.col(column).cast("string"))
    return F.min_by(known, F.when(known.isNotNull(), F.col("ordinal"))).alias(column)


def merge_properties(records: DataFrame, texts: list[str]) -> DataFrame:
    """Fold all records of a location into one row.

    Texts: the first that isn't blank. Year and value: of the latest year among rows with a
    value, later rows win ties; without any value the first row's year stays. Source of the
    greatest confidence, later rows win ties.
    """
    valued = F.when(F.col("value").isNotNull(), F.struct(F.coalesce("year", F.lit(0)), F.col("ordinal")))
    return records.groupBy("location_id").agg(
        *[first_text(t) for t in texts],
        F.coalesce(F.max_by("year", valued), F.min_by("year", "ordinal")).alias("year"), F.max_by("value", valued).alias("value"),
        F.max_by("source_id", F.struct(F.coalesce("confidence", F.lit(0.0)), F.col("ordinal"))).alias("source_id"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
        F.count("*").alias("record_count"),
    )


def merge_pois(pois: DataFrame, key: Column) -> DataFrame:
    """Fold points of interest with one merge key; the sources' ids stay as a sorted list."""
    rows = pois.withColumn("poi_id", key)
    ids = F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "source_id", "entity_id"))), ",")
    return rows.groupBy("poi_id").agg(first_text("name"), first_text("category"), first_text("subcategory"), F.min_by("lat", "ordinal").alias("lat"), F.min_by("lon", "ordinal").alias("lon"), ids.alias("sources"))


def latest_text(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Of each column the last text that isn't blank: new values replace old ones, blanks don't."""
    known = lambda c: first_known(F.col(c).cast("string"))
    return rows.groupBy(key).agg(*[F.max_by(known(c), F.when(known(c).isNotNull(), F.col("ordinal"))).alias(c) for c in columns])


def quality_rates(records: DataFrame) -> DataFrame:
    """Shares of quarantined records by reason, over all records of a source."""
    q = quarantine(records)
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    return q.groupBy("source_id").agg(
        F.count("*").alias("total"), share(F.col("reason_code").isNotNull()).alias("quarantined"), share(F.col("reason_code") == "invalid_value").alias("invalid_value"),
        share(F.col("reason_code") == "missing_value").alias("missing_value"), share(F.col("reason_code") == "missing_record_id").alias("missing_id"), share(F.col("reason_code") == "missing_coordinates").alias("missing_point"))


def census_rows(rows: DataFrame) -> DataFrame:
    """Valid census rows with density; the income of suppressed rows is 0 and marks limited accuracy."""
    fine = (F.col("population") >= 0) & (F.col("households") >= 0) & (F.col("area_km2") > 0)
    return rows.filter(fine).select(
        "area_id", "population", "households", "area_km2", F.round(F.col("population") / F.col("area_km2"), 4).alias("density"),
        F.when(F.col("suppressed"), F.lit(0.0)).otherwise(F.col("income")).alias("income"), F.col("suppressed").cast("int").alias("limited_accuracy"))


def census_pivot(rows: DataFrame) -> DataFrame:
    """Long rows (area, label, amount, ordinal) to one row an area; the last row of a kind wins, private dwellings before all dwellings."""
    label = F.lower("label")
    is_population = label.contains("population") & ~label.contains("density")
    last = lambda rule: F.max_by(F.when(rule, F.col("amount")), F.when(rule, F.col("ordinal")))
    dwelling = F.when(label.contains("occupied") & label.contains("dwelling"), 2).when(label.contains("dwelling"), 1)
    return rows.groupBy("area").agg(
        last(is_population).alias("population"), last(label.contains("land area")).alias("area_km2"),
        F.max_by(F.when(dwelling.isNotNull(), F.col("amount")), F.when(dwelling.isNotNull(), F.struct(dwelling, F.col("ordinal")))).alias("households"))


def merge_crime(rows: DataFrame) -> DataFrame:
    """One row for each source, area, type and year: the greatest count and the greatest rate, whichever of the two there are."""
    is_rate = F.lower("metric").rlike(r"\brates?\b")
    keys = [F.coalesce("source_id", F.lit("")).alias("source_id"), "neighbourhood", "crime_type", F.coalesce("year", F.lit(0)).alias("year")]
    return rows.groupBy(*keys).agg(F.max(F.when(~is_rate, F.col("amount"))).alias("incidents"), F.max(F.when(is_rate, F.col("amount"))).alias("rate"))


def crime_year(rows: DataFrame, column: str = "REF_DATE") -> DataFrame:
    return rows.withColumn("year", leading_year(F.col(column)))


def standardize_pois(pois: DataFrame, rules: DataFrame) -> DataFrame:
    """Points with the category of their rule, ``Unmapped`` without one. ``rules`` has a row for each raw category."""
    mapped = pois.join(rules.select(F.col("raw").alias("category"), F.col("canonical").alias("standard"), "rule_id"), "category", "left")
    return mapped.withColumn("standard", F.coalesce("standard", F.lit("Unmapped")))


def mapping_conflicts(rows: DataFrame) -> DataFrame:
    """(source_id, category) with more than one canonical category."""
    return rows.groupBy("source_id", "category").agg(F.count_distinct("standard").alias("n")).filter("n > 1")
