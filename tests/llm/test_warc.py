import gzip
import hashlib
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from parcelforge.llm import warc
from parcelforge.llm.common import table

SF = "/root/testdata/sf0.001"


def plainly(rows):
    best = {}
    for page_id, html in rows:
        body = (html or "").encode()
        if page_id is not None:
            best[body] = max(best.get(body, page_id), page_id)
    out = []
    for page_id, html in rows:
        body = (html or "").encode()
        keeper = best.get(body) if len(body) >= 1000 else page_id
        again = keeper is not None and page_id != keeper
        out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", keeper if again else None))
    return sorted(out, key=str)


def through(spark, pages):
    """op9 on other pages."""
    folder = tempfile.mkdtemp(prefix="spark-")
    pages.write.parquet(f"{folder}/pages.parquet")
    return warc.op9_warc(spark, folder)


def test_whole_table(spark):
    rows = [(r.page_id, r.html) for r in table(spark, SF, "pages").collect()]
    got = warc.op9_warc(spark, SF)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == plainly(rows)


def test_edge_rows(spark):
    long, short = "é" * 500, "x" * 999
    rows = [(1, long), (5, long), (5, long), (None, long), (2, short), (3, short), (4, None), (6, ""), (7, "y" * 3_000_000), (8, "y" * 3_000_000), (None, None)]
    pages = spark.createDataFrame([(a, f"http://h/{a} b\r\nX: y" if a != 2 else None, b, "q", 3) for a, b in rows], "page_id long, url string, html string, record_type string, payload int")
    assert sorted(map(tuple, through(spark, pages).collect()), key=str) == plainly(rows)
    assert through(spark, pages.limit(0)).count() == 0


def test_many_repeated_digests_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
    rows = [(i, "z" * 1200 if i % 3 else f"{i % 5} " * 600 if i % 2 else "small" if i % 4 else None) for i in range(300)] + [(None, "z" * 1200)]
    pages = spark.createDataFrame([(a, "http://h", b) for a, b in rows], "page_id long, url string, html string")
    assert sorted(map(tuple, through(spark, pages).collect()), key=str) == plainly(rows)


def test_pushdown_and_foreign_archives(spark, tmp_path):
    warc.register(spark)
    for k in range(3):
        with open(tmp_path / f"{k}.warc.gz", "wb") as f:
            for i in range(4):
                data = warc.record("response" if i % 2 else "revisit", f"urn:page:{k}{i}", f"http://host{k}/{i}", "ab" * 20, 5, b"hello" if i % 2 else b"", None)
                f.write(warc.member(data) if k else gzip.compress(data))
    read = spark.read.format("warc").option("split_bytes", "1")
    df = read.load(str(tmp_path))
    assert df.count() == 12 and df.rdd.getNumPartitions() == 3
    some = df.filter((F.col("record_type") == "response") & F.col("target_uri").startswith("http://host1/"))
    assert sorted((r.record_id, bytes(r.payload)) for r in some.collect()) == [("urn:page:11", b"hello"), ("urn:page:13", b"hello")]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert not any(line.lstrip("*+-: (0123456789)").startswith("Filter") for line in plan.splitlines()), plan
    assert df.filter(F.col("record_id").isin("urn:page:00", "urn:page:21")).count() == 2
    bare = read.option("payload", "false").load(str(tmp_path))
    assert bare.filter("payload is not null").count() == 0 and {r.http_length for r in bare.collect()} == {5}


def test_unwanted_payloads_are_not_inflated(tmp_path):
    data = warc.record("response", "urn:page:1", None, "00", 1, b"payload", None)
    good = warc.member(data)
    broken = bytearray(warc.member(warc.record("revisit", "urn:page:2", None, "00", 1, bytes(range(256)) * 4000, None)))
    broken[-2000:-8] = bytes(1992)  # damage that only inflating to the end would meet
    (tmp_path / "a.warc.gz").write_bytes(bytes(broken) + good)
    from pyarrow import fs

    rows = list(warc.read_file(fs.LocalFileSystem(), str(tmp_path / "a.warc.gz"), lambda v: v["record_type"] == "response", True))
    assert [(r[1], r[6]) for r in rows] == [("urn:page:1", b"payload")]


def test_sql_says_the_same(spark):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    want = con.sql(warc.OP9_SQL).df()
    got = warc.op9_warc(spark, SF).toPandas()
    assert sorted(got.page_id) == sorted(want.page_id)
    both = got.merge(want, on="page_id")
    for c in ("payload_bytes", "payload_digest", "record_type"):
        assert (both[f"{c}_x"] == both[f"{c}_y"]).all()
