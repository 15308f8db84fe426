import pytest

from parcelforge.plans import enrichment as E
from parcelforge.sources.store import Store

PLACE = "suite string, house string, street string, lat double, lon double"


@pytest.fixture()
def inputs(spark):
    """Forty properties: the first thirty are listed, five have permits, the rest is guessed or stays unknown."""
    homes = [(f"p{i:02}", None, str(100 + i) if i != 3 else None, f"{'MAIN' if i % 2 else 'OAK'} ST", None if i == 4 else 53.5, -113.5, "RF1" if i < 38 else "DC9", "R", "Y", "A") for i in range(40)]
    homes += [("p90", "1", "900", "ELM ST", 53.5, -113.5, "RF1", "R", "Y", "A"), ("p91", "2", "900", "ELM ST", 53.5, -113.5, "RF1", "R", "Y", "A")]
    properties = spark.createDataFrame(homes, f"location_id string, {PLACE}, zoning string, tax_class string, garage string, neighbourhood string")
    listed = [(f"s{i:02}", None, str(100 + i), f"{'Main' if i % 2 else 'Oak'} Street", 53.6, -113.5, 2 + i % 2, 1.5) for i in range(30)]
    listed += [("s90", None, "900", "Elm Street", None, None, 4, 2.0), ("s99", None, "5000", "Nowhere Rd", None, None, 1, 1.0), ("s98", None, "101", "Main St", None, None, None, None)]
    listings = spark.createDataFrame(listed, f"source_record_id string, {PLACE}, bedrooms int, bathrooms double")
    prior = listings.limit(0)
    permits = spark.createDataFrame([(f"w{i}", str(130 + i), f"{'Main' if i % 2 else 'Oak'} St", f"new house {3 + i % 2} bedrooms 2 bath") for i in range(5)] + [("w9", "100", "Oak St", "9 bedrooms"), ("w8", "136", "Oak St", "deck")], "source_record_id string, house string, street string, description string")
    return properties, listings, prior, permits


def rows(df):
    return {r.location_id: r for r in df.collect()}


def test_disabled_then_shadow_then_production(spark, inputs, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    off = E.run(store, "r1", *inputs, E.Settings(target="disabled"))
    staged = rows(off["staged"])
    assert store.version(E.LIVE) is None and store.version(E.SHADOW) is None and off["attributes"].count() == 0
    assert {k: r.source_type for k, r in staged.items() if k in ("p00", "p30", "p36")} == {"p00": "observed", "p30": "inferred", "p36": "imputed"}
    assert staged["p00"].bedrooms == 2 and staged["p00"].match_method == "fuzzy_address_geo" and staged["p00"].reason_code == "typo_normalized_match"
    assert staged["p30"].confidence == pytest.approx(0.99 * 0.82) and staged["p30"].bedrooms == 3
    assert (staged["p36"].bedrooms_estimated, staged["p36"].bathrooms_estimated, staged["p36"].bedrooms, staged["p36"].confidence) == (2, 1.5, None, 0.78)
    assert "p38" not in staged  # its group is unknown: too unsure
    assert sum(r.source_record_id == "s90" for r in staged.values()) == 1 and any(r.quarantined and r.reason_code == "suite_missing_multi_unit" for r in staged.values())
    assert [(r.step, r.status) for r in off["steps"].collect()] == [("observed matching", "succeeded"), ("location backfill", "skipped"), ("permit parsing", "succeeded"), ("imputation", "succeeded"), ("promotion", "disabled"), ("reporting", "succeeded")]
    review = off["review"].collect()
    assert {(r.source_record_id, r.reason_code) for r in review if r.source_type == "unmatched"} >= {("s99", "no_house_number_match")}
    assert {r.location_id for r in review if r.source_type == "property_candidate"} == {"p90", "p91"}
    held = next(r for r in review if r.source_record_id == "s90" and r.source_type == "observed")
    assert held.raw_source_address == "900 Elm Street" and held.normalized_address.startswith("900 ELM ST")

    E.run(store, "r2", *inputs, E.Settings(target="shadow", backfill=True))
    assert store.version(E.LIVE) is None and store.read(E.SHADOW).count() == len(staged)
    assert store.version("property_locations") is None  # a shadow run moves no property

    first = E.run(store, "r3", *inputs, E.Settings(backfill=True))
    live = rows(first["attributes"])
    assert live.keys() == staged.keys()
    assert {(r.location_id, r.field) for r in first["updates"].collect()} == {("p04", "lat")}
    moved = rows(store.read("property_locations"))
    assert moved["p04"].lat == 53.6 and moved["p00"].lat == 53.5 and len(moved) == 42
    markers = [r for r in store._versions().collect() if r.run_id == "r3"]
    assert {m.table_name for m in markers} == {E.LIVE, "property_locations"} and len({m.promoted_at for m in markers}) == 1

    # a later run without listings: observations stay, a permit fills nothing that is observed
    properties, listings, prior, permits = inputs
    again = rows(E.run(store, "r4", properties, listings.limit(0), prior, permits)["attributes"])
    assert again["p00"].source_type == "observed" and again["p00"].bedrooms == 2
    assert again["p30"].source_type == "inferred"


def test_overwrite_and_failed_step(spark, inputs, tmp_path, monkeypatch):
    properties, listings, prior, permits = inputs
    seen = E.observed(properties, listings, prior, E.Settings())
    moved, updates = E.backfilled(properties, seen, listings, overwrite=True)
    assert rows(moved)["p00"].lat == 53.6 and rows(moved)["p00"].street == "Oak Street" and updates.filter("field = 'street'").count() == seen.filter("not quarantined").count()
    store = Store(spark, str(tmp_path / "store"))
    monkeypatch.setattr(E, "imputed", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        E.run(store, "bad", *inputs)
    log = {r.step: r.status for r in spark.read.parquet(f"{store.root}/_log/enrichment_steps").collect()}
    assert log["imputation"] == "failed" and log["permit parsing"] == "succeeded" and store.version(E.LIVE) is None
    with pytest.raises(ValueError):
        E.run(store, "bad", *inputs, E.Settings(target="elsewhere"))
