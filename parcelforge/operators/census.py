"""Census of neighbourhoods from long tables of labelled counts.

The long tables have number, question_type, characteristic, gender, value (texts) and ordinal.
Labels differ between editions, so of a neighbourhood's rows the one with the best label
counts; ties go by label, then by ordinal. All tables meet in one aggregation by number, which
combines before its shuffle, instead of a chain of joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of the whole population, best first, and what labels of other counts contain, best first.
POPULATION_LABELS = ["population, 2021", "population", "total - population, 2021", "total population"]
HOUSEHOLD_LABELS = ["private households occupied by usual residents", "private households", "households"]
INCOME_LABELS = ["median.*household.*income", "median.*total income.*household", "median.*income.*household"]
HOUSEHOLD_SIZES = "(?i)^(1 person|2 persons|3 persons|4 persons|5 or more persons)$"
BY_SIZE = "sum_household_size_distribution"
LAST_RANK = 50


def _plain(label: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(label, r"(?U)\s+", " ")))


def _rank(tests: list[tuple[Column, int]]) -> Column:
    """The number of the first test that holds."""
    rank = F.lit(LAST_RANK)
    for test, n in reversed(tests):
        rank = F.when(test, n).otherwise(rank)
    return rank


def _has(column: str, pattern: str) -> Column:
    return F.coalesce(F.col(column).rlike(f"(?i){pattern}"), F.lit(False))


def _ranked(rows: DataFrame, kind: str, tests: list[tuple[Column, int]]) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), F.col("number").try_cast("double").alias("number"), _rank(tests).alias("rank"), "characteristic", "ordinal", F.col("value").try_cast("double").alias("value"))


def population_rows(rows: DataFrame) -> DataFrame:
    label = _plain(F.col("characteristic"))
    found = rows.filter(_has("characteristic", "population") & _has("gender", "total") & _has("question_type", "population"))
    return _ranked(found, "population", [(label == name, i) for i, name in enumerate(POPULATION_LABELS)])


def _of_all(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("gender").isNull() | _has("gender", "total"))


def income_rows(rows: DataFrame) -> DataFrame:
    label = _plain(F.col("characteristic"))
    has = lambda word: label.contains(word)
    tests = [(label.rlike(p), i) for i, p in enumerate(INCOME_LABELS)] + [(has("income") & has("household") & has("median"), 10), (has("income") & has("household"), 20)]
    return _ranked(_of_all(rows).filter(_has("characteristic", "income")), "income", tests)


def income_labels(rows: DataFrame) -> DataFrame:
    """(question_type, characteristic): all labels about income, for review."""
    return _of_all(rows).filter(_has("characteristic", "income")).select("question_type", "characteristic").distinct()


def household_rows(rows: DataFrame) -> DataFrame:
    """Rows of household sizes, if the table has any, all of which count; else rows about households."""
    sizes = rows.filter(_has("question_type", "household size") & F.coalesce(F.col("characteristic").rlike(HOUSEHOLD_SIZES), F.lit(False)))
    if not sizes.isEmpty():
        return _ranked(sizes, "sizes", [])
    label = _plain(F.col("characteristic"))
    found = _of_all(rows).filter(_has("question_type", "household|family") & _has("characteristic", "households"))
    return _ranked(found, "households", [(label.contains(name), i) for i, name in enumerate(HOUSEHOLD_LABELS)])


def build(current: DataFrame, population: DataFrame, households: DataFrame, areas: DataFrame) -> DataFrame:
    """One row for each number of ``current`` (number, neighbourhood, ward, ordinal), from its first row.

    ``areas`` has neighbourhood_number and area_sq_km. Numbers that are none are left out of the
    counts, and share one row where ``current`` has them. Where a neighbourhood has no row of a
    kind, its columns are null; counts by size that aren't numbers count 0. Names and wards are
    those of ``current`` only.
    """
    known = population_rows(population).unionByName(income_rows(population)).unionByName(household_rows(households))
    known = known.unionByName(areas.select(F.lit("area").alias("kind"), F.col("neighbourhood_number").cast("double").alias("number"), F.col("area_sq_km").alias("value")), allowMissingColumns=True).filter("number is not null")
    listed = current.select(F.lit("current").alias("kind"), F.col("number").try_cast("double").alias("number"), "ordinal", F.struct("neighbourhood", "ward").alias("names"))
    rows = known.unionByName(listed, allowMissingColumns=True)

    of = lambda kind: F.col("kind") == kind
    best = lambda kind, c: F.min_by(c, F.when(of(kind) & F.col(c).isNotNull(), F.struct("rank", "characteristic", "ordinal")))
    sizes = F.max(of("sizes"))
    found = rows.groupBy("number").agg(
        F.max(of("current")).alias("listed"), F.min_by("names", F.when(of("current"), F.col("ordinal"))).alias("names"),
        best("population", "value").alias("population_2021"), best("population", "characteristic").alias("population_characteristic"),
        best("income", "value").alias("median_household_income_2020_cad"), best("income", "characteristic").alias("income_characteristic"),
        F.when(sizes, F.coalesce(F.sum(F.when(of("sizes"), F.col("value"))), F.lit(0.0))).otherwise(best("households", "value")).alias("households_2021"),
        F.when(sizes, BY_SIZE).otherwise(best("households", "characteristic")).alias("households_characteristic"),
        F.max(F.when(of("area"), F.col("value"))).alias("area_sq_km"),
    )
    return found.filter("listed").select(
        F.when(F.col("number").isNotNull(), F.format_string("N%03d", F.col("number").cast("long"))).alias("source_area_id"), F.lit("neighbourhood").alias("geography_level"), F.col("number").alias("neighbourhood_number"),
        "names.neighbourhood", "names.ward", "population_2021", "households_2021", "median_household_income_2020_cad", "area_sq_km", "population_characteristic", "households_characteristic", "income_characteristic",
    )
