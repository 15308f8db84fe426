import json

import pytest
from pyspark.sql import functions as F

from parcelforge.plans import refresh as workflow
from parcelforge.sources import readers
from parcelforge.sources.store import Store
from parcelforge.streaming import refresh


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"metadata": {"year": "2025"}, "records": [{"record_id": "A", "value": "1"}, {"record_id": "B"}]}))
    rows = readers.read_json_source(spark, str(tmp_path / "a.json"), "record_id:string, value:string").collect()
    assert [(r.record_id, r.value, r.ordinal, r.metadata["year"]) for r in rows] == [("A", "1", 0, "2025"), ("B", None, 1, "2025")]
    (tmp_path / "b.csv").write_text('﻿Street Name,the_geom,ward\n"Main, St","LINESTRING (-113.5 53.5, -113.4 53.6)",1\nElm,,2\n', encoding="utf-8")
    df = readers.read_csv_source(spark, str(tmp_path / "b.csv"), "the_geom")
    rows = df.collect()
    assert rows[0]["Street Name"] == "Main, St" and (rows[0].lat, rows[0].lon) == (53.5, -113.5) and len(rows[0].points) == 2
    assert rows[1].points is None
    mapped = readers.apply_field_map(df, {"name": "street_name", "city": "=Edmonton", "gone": "nothing"})
    assert [(r.name, r.city, r.gone) for r in mapped.collect()] == [("Main, St", "Edmonton", None), ("Elm", "Edmonton", None)]
    assert readers.passes(mapped, {"ward": "1"}, (-114, 53, -113, 54)).count() == 1


def test_geojson_and_arcgis(spark, tmp_path):
    features = [
        {"type": "Feature", "properties": {"id": "1"}, "geometry": {"type": "Point", "coordinates": [-113.5, 53.5]}},
        {"type": "Feature", "properties": {"id": "2"}, "geometry": {"type": "MultiLineString", "coordinates": [[[-1, 2], [-3, 4]], [[-5, 6]]]}},
        {"type": "Feature", "properties": {"id": "3"}, "geometry": {"type": "Polygon", "coordinates": [[[-1, 2], [-3, 4], [-1, 2]]]}},
        {"type": "Feature", "properties": None, "geometry": None},
    ]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = {(r.properties or {}).get("id"): r.points for r in readers.read_geojson(spark, str(tmp_path / "a.geojson")).collect()}
    assert [(p.lat, p.lon) for p in rows["1"]] == [(53.5, -113.5)]
    assert [(p.lat, p.lon) for p in rows["2"]] == [(2.0, -1.0), (4.0, -3.0), (6.0, -5.0)]
    assert rows["3"] is None and rows[None] is None
    (tmp_path / "b.json").write_text(json.dumps({"features": [{"attributes": {"a": "x"}, "geometry": {"x": -1.0, "y": 2.0}}]}))
    assert tuple(readers.read_arcgis(spark, str(tmp_path / "b.json")).first())[1:] == (2.0, -1.0)


def test_names_and_registry(spark, tmp_path):
    assert readers.find_column(["Street Name", "x"], "street_name") == "Street Name"
    assert readers.find_column(["centerline_id"], "centerline") == "centerline_id"
    assert readers.find_column(["a"], "b") is None
    with pytest.raises(ValueError):
        readers.technique("x.ivt")
    registry = {"b": {"pipeline": "crime"}, "a": {"pipeline": "census", "enabled": False}, "c": {"pipeline": "census"}}
    assert [r.key for r in readers.list_sources(spark, registry).collect()] == ["b", "c"]
    assert [r.key for r in readers.list_sources(spark, registry, "census", enabled_only=False).collect()] == ["a", "c"]
    df = spark.createDataFrame([("", "x"), ("y", "z"), (None, None)], "beds string, Bedrooms string")
    assert [r.bedrooms for r in readers.pick(df, {"bedrooms": ["beds", "Bedrooms"]}).collect()] == ["x", "y", None]


def test_pages(spark):
    html = '<title> Two </title><a href="/x">x</a><a class=b href=\'/y\'>y</a><a href="/x">again</a><p>3 bed, 2.5 bath at $450,000</p>'
    ld = '<script type="application/ld+json">{"numberOfBedrooms": "4", "offers": {"price": "500000"}}</script>'
    df = spark.createDataFrame([(1, html), (2, ld), (3, None)], "page_id long, html string")
    links = {r.page_id: (r.title, r.links) for r in readers.page_links(df).collect()}
    assert links[1] == ("Two", ["/x", "/y"]) and links[3] == (None, None)
    rooms = {r.page_id: (r.bedrooms, r.bathrooms, r.price) for r in readers.listing_details(df).collect()}
    assert rooms[1] == (3, 2.5, 450000.0) and rooms[2][0] == 4 and rooms[2][2] == 500000.0


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.read("census").count() == 0
    rows = lambda *r: spark.createDataFrame(r, "dataset_type string, entity_id string, source_id string, name string, ordinal long")
    store.replace("geospatial", rows(("poi", "1", "a", "x", 0), ("poi", "2", "b", "y", 0)).drop("ordinal"))
    first = store.version("geospatial")
    store.replace_sources("geospatial", rows(("poi", "3", "b", "z", 0)).drop("ordinal"))
    names = lambda: sorted((r.entity_id, r.name) for r in store.read("geospatial").collect())
    assert names() == [("1", "x"), ("3", "z")] and store.version("geospatial") != first
    store.upsert("geospatial", rows(("poi", "1", "a", "new", 0), ("poi", "1", "a", "newer", 1), ("poi", "9", "c", "q", 2)), ["dataset_type", "entity_id", "source_id"])
    assert names() == [("1", "newer"), ("3", "z"), ("9", "q")]
    store.insert_new("geospatial", rows(("poi", "9", "c", "other", 0), ("poi", None, "c", "n", 0)).drop("ordinal"), ["entity_id"])
    store.insert_new("geospatial", rows(("poi", None, "c", "again", 0)).drop("ordinal"), ["entity_id"])
    assert sorted((str(r.entity_id), r.name) for r in store.read("geospatial").collect()) == [("1", "newer"), ("3", "z"), ("9", "q"), ("None", "n")]
    staged = store.stage("geospatial", "run1", rows(("poi", "5", "d", "s", 0)))
    assert staged.count() == 1 and store.stage("geospatial", "run1", rows()).count() == 0 and store.read("geospatial").count() == 4
    assert [(r.table_name, r.n) for r in store.summary().collect()] == [("geospatial", 4)]
    store.log("alerts", spark.createDataFrame([("r", 1), ("r", 2)], "run_id string, at int"))
    assert store.latest_log("alerts", "run_id", "at").first().at == 2
    store.export_csv(rows(("poi", "5", "d", "s", 0)), str(tmp_path / "out"), ["entity_id", "missing"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["entity_id", "missing"]


def test_workflow():
    assert workflow.closure(["deduplication"]) == ["geospatial", "poi_standardization", "deduplication"]
    done = []
    steps = {n: (lambda n=n: done.append(n)) for n in workflow.DEPENDS}

    def broken():
        raise ValueError("no file")

    out = workflow.run(["transit", "deduplication"], steps | {"geospatial": broken})
    assert out.status == "partial_success" and out.steps == {"geospatial": "failed", "transit": "succeeded", "poi_standardization": "skipped", "deduplication": "skipped"}
    assert workflow.run(["crime"], steps).status == "succeeded"
    assert workflow.run(["crime"], steps | {"crime": broken}).status == "failed"


def test_refresh_stream(spark, tmp_path):
    folder, schema = str(tmp_path / "landing"), "k long, v string"
    seen = []
    apply = lambda df, n: seen.extend(sorted(r.k for r in df.collect()))
    for k in (1, 2):
        spark.createDataFrame([(k, "x")], schema).write.mode("append").parquet(folder)
        refresh.refresh_on_arrival(spark, folder, schema, str(tmp_path / "check"), apply).awaitTermination()
    assert seen == [1, 2]


def test_rate_limit_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.select("ts", "user_id").repartition(2).write.parquet(str(tmp_path / "e"))
    stream = refresh.request_rates(spark.readStream.schema("ts timestamp, user_id long").parquet(str(tmp_path / "e")))
    q = stream.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.window_start, r.user_id, r.requests) for r in refresh.request_rates(events).collect()}
    assert {(r.window_start, r.user_id, r.requests) for r in spark.table("rates").collect()} == want
    assert refresh.rate_limited(events, 1).filter(F.col("requests") <= 1).count() == 0


def test_assessments_need_places_only():
    assert workflow.closure(["assessments"]) == ["geospatial", "assessments"]
