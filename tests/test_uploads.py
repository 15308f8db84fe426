import json
import struct
import zipfile

import pytest
from test_more_sources import dbf, shp

from parcelforge.sources import uploads


@pytest.fixture
def file(tmp_path):
    def write(name, content):
        (tmp_path / name).write_text(content)
        return str(tmp_path / name)

    return write


def found(spark, path, dataset):
    return [(r.issue, r.detail) for r in uploads.issues(spark, path, dataset).collect()]


def test_issues(spark, file):
    assert found(spark, file("a.csv", "School Name,Latitude,LNG\nx,1,2\n"), " Schools ") == []
    assert found(spark, file("b.csv", "School_Nam,x\n1,2\n"), "schools") == [("missing_field", "lat/latitude"), ("missing_field", "lng/lon/longitude")]
    assert found(spark, "/nowhere/x.csv", "lakes")[0][0] == "unknown_dataset"
    assert found(spark, "/nowhere/x.xlsx", "parks") == [("wrong_ending", ".xlsx")] and found(spark, "/nowhere/x", "parks") == [("wrong_ending", ".unknown")]
    assert found(spark, "/nowhere/x.csv", "parks")[0][0] == "unreadable" and found(spark, file("c.json", "{"), "parks")[0][0] == "unreadable"
    for name, text in (("d.json", " "), ("e.json", "[]"), ("f.json", "{}"), ("g.json", '{"features": []}')):
        assert found(spark, file(name, text), "parks")[0][0] in ("no_fields", "missing_field")


def test_json_kinds(spark, file):
    stop = {"Stop-ID": 1, "name": "A", "stop_lat": 53, "stop_lon": -113}
    assert found(spark, file("a.json", json.dumps([stop, 7])), "transit_stops") == [] == found(spark, file("b.json", json.dumps(stop)), "transit_stops")
    feature = lambda xy: json.dumps({"type": "FeatureCollection", "features": [{"geometry": {"type": "Point", "coordinates": xy}, "properties": {"name": "P", "k": None}}]})
    assert found(spark, file("c.geojson", feature([-113.5, 53.5])), "playgrounds") == []
    assert [i for i, _ in found(spark, file("d.geojson", feature([[1, 2], [3, 4]])), "playgrounds")] == ["missing_field"] * 2
    got = uploads.rows(spark, file("c.geojson", feature([-113.5, 53.5]))).collect()
    assert [r.asDict() for r in got] == [{"k": None, "name": "P", "lat": "53.5", "lon": "-113.5"}]


def test_both_modes(spark, file, tmp_path):
    path, written = file("a.csv", "name,lat,lon\nx,1,2\ny,3,4\n"), []
    keep = lambda df: written.extend(sorted(r.name for r in df.collect()))
    status, none, n = uploads.ingest(spark, path, "parks", keep, validate_only=True)
    assert (status, none.count(), n, written) == ("valid", 0, 2, [])
    assert uploads.ingest(spark, path, "parks", keep)[::2] == ("ingested", 2) and written == ["x", "y"]
    status, why, n = uploads.ingest(spark, file("b.csv", "name\nx\n"), "parks", keep)
    assert (status, why.count(), n, written) == ("refused", 2, 0, ["x", "y"])
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("p.shp", shp([struct.pack("<i2d", 1, -113.5, 53.5)]))
        z.writestr("p.dbf", dbf(["OFFICIAL_N"], [("Park",)]))
    assert uploads.ingest(spark, str(tmp_path / "p.zip"), "parks", keep, validate_only=True)[::2] == ("valid", 1)
    assert uploads.rows(spark, str(tmp_path / "p.zip")).first().asDict() == {"OFFICIAL_N": "Park", "lat": "53.5", "lon": "-113.5"}
