import random
import re

import pytest

from parcelforge.operators import census

LONG = "number string, question_type string, characteristic string, gender string, value string, ordinal long"
CURRENT = "number string, neighbourhood string, ward string, ordinal long"
AREAS = "neighbourhood_number double, area_sq_km double"


def number(text):
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def first(rows, rank):
    """(value, label) of a neighbourhood's rows, each from the best row that has it."""
    rows = sorted(rows, key=lambda r: (rank(" ".join(r[2].split()).lower()), r[2], r[5]))
    return next((number(r[4]) for r in rows if number(r[4]) is not None), None), rows[0][2] if rows else None


def has(text, *words):
    return text is not None and any(w in text.lower() for w in words)


def population_rank(label):
    return census.POPULATION_LABELS.index(label) if label in census.POPULATION_LABELS else 50


def household_rank(label):
    return next((i for i, part in enumerate(census.HOUSEHOLD_LABELS) if part in label), 50)


def income_rank(label):
    for i, pattern in enumerate(census.INCOME_LABELS):
        if re.search(pattern, label):
            return i
    return 50 if not ("income" in label and "household" in label) else 10 if "median" in label else 20


def plain(current, population, households, areas):
    sizes = [r for r in households if has(r[1], "household size") and r[2] and re.match(census.HOUSEHOLD_SIZES, r[2])]
    out = {}
    for r in sorted(current, key=lambda r: r[3]):
        n = number(r[0])
        if n in out:
            continue
        own = lambda rows: [x for x in rows if n is not None and number(x[0]) == n]  # noqa: E731,B023
        total = lambda rows: [x for x in rows if x[3] is None or has(x[3], "total")]
        p = first([x for x in own(population) if has(x[2], "population") and has(x[3], "total") and has(x[1], "population")], population_rank)
        i = first([x for x in total(own(population)) if has(x[2], "income")], income_rank)
        if sizes:
            mine = own(sizes)
            h = (sum(number(x[4]) or 0.0 for x in mine), census.BY_SIZE) if mine else (None, None)
        else:
            h = first([x for x in total(own(households)) if has(x[1], "household", "family") and has(x[2], "households")], household_rank)
        out[n] = (r[1], r[2], p[0], h[0], i[0], dict(areas).get(n) if n is not None else None, p[1], h[1], i[1])
    return out


@pytest.mark.parametrize("with_sizes", [True, False])
def test_against_plain_version(spark, with_sizes):
    rng = random.Random(int(with_sizes))
    labels = [None, "", "Population, 2021", "population ", "Total -  Population, 2021", "TOTAL POPULATION", "Population density", "Median household income", "Median total income of household", "Income of household, median", "Household income", "Income", "Private households", "Private  households occupied by usual residents", "Households of two"]
    sizes = ["1 person", "2 PERSONS", "5 or more persons", "6 persons", "1 person in all"] if with_sizes else []
    ask = [None, "", "Population", "Income and family", "Household size", "Households"]
    who = [None, "", "Total", "Total - Gender", "Men+"]
    numbers = [None, "x", "1", "1.0", "2", "12", "130", "1204"]
    long_rows = lambda n: [(rng.choice(numbers), rng.choice(ask), rng.choice(labels + sizes), rng.choice(who), rng.choice([None, "", "x", "0", "7", "12.5"]), i // 2 * 2 + i % 2) for i in range(n)]
    population, households = long_rows(500), long_rows(400)
    current = [(rng.choice([*numbers, "900"]), rng.choice([None, "A", "B"]), rng.choice([None, "w"]), i) for i in range(25)]
    areas = [(1.0, 2.5), (12.0, 0.25), (77.0, 9.0)]
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((current, CURRENT), (population, LONG), (households, LONG), (areas, AREAS))]
    got = census.build(*frames).collect()
    assert {r.neighbourhood_number: tuple(r)[3:] for r in got} == plain(current, population, households, areas)
    ids = {r.neighbourhood_number: r.source_area_id for r in got}
    assert ids[1.0] == "N001" and ids[1204.0] == "N1204" and ids.get(None) is None
    found = {(r.question_type, r.characteristic) for r in census.income_labels(frames[1]).collect()}
    assert found == {(x[1], x[2]) for x in population if has(x[2], "income") and (x[3] is None or has(x[3], "total"))}


def test_empty_tables(spark):
    none = spark.createDataFrame([], LONG)
    one = spark.createDataFrame([("7", "A", None, 0)], CURRENT)
    row = census.build(one, none, none, spark.createDataFrame([], AREAS)).first()
    assert (row.source_area_id, row.neighbourhood, row.population_2021, row.households_characteristic) == ("N007", "A", None, None)
    assert census.build(one.limit(0), none, none, spark.createDataFrame([], AREAS)).count() == 0
