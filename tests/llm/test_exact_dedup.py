import hashlib

import pytest
from pyspark.sql import functions as F

from parcelforge.llm import exact_dedup
from parcelforge.llm.common import dealt_join, table
from parcelforge.session import materialize

BLANKS = dict.fromkeys(map(ord, exact_dedup.BLANKS))


def plainly(rows, longest):
    """(doc_id, keep_id, size, sha) sorted, and the number of rows that stay."""
    classes = {}
    for doc_id, text in rows:
        classes.setdefault((text or "").translate(BLANKS), []).append((-len(text or "") if longest else 0, doc_id is None, doc_id))
    out = []
    for body, members in classes.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        out += [(m[2], keep, len(members), hashlib.sha256(body.encode()).hexdigest()) for m in members]
    return sorted(out, key=str), len(classes)


ROWS = [
    (5, "one two"), (3, "onetwo"), (9, "one\t two"), (4, "one two "), (7, None), (8, ""), (6, " \x0b\x0c\r\n"), (None, "alone"), (None, "one two"),
    (1, "long " * 50_000), (2, "long" * 50_000), (11, "x y"), (12, "xy"), (13, "same"), (13, "same"), (13, "sa me"), (14, "One two"), (15, "ö 😀"), (16, "ö😀"),
]
WEAK = {"md5": exact_dedup.content_hash, "three values": lambda t: F.crc32(t) % 3, "one value": lambda t: F.lit(1)}


@pytest.mark.parametrize("longest", [False, True])
@pytest.mark.parametrize("key", WEAK)
def test_classes_with_collisions(spark, key, longest):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("key", F.lit("theirs")).withColumn("row", F.lit(0))
    got = exact_dedup.classes(df, key=WEAK[key], longest=longest).collect()
    want, n = plainly(ROWS, longest)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == n and len({r.text_sha256 for r in kept}) == n and all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("longest", [False, True])
def test_keep_one_returns_the_callers_columns(spark, longest):
    names = ["row", "id", "sha", "own_id", "own_sha", "key", "n_points", "best", "times", "text_sha256", "a.b"]
    df = spark.createDataFrame(ROWS, "doc_id long, text string").select("doc_id", "text", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(c) for c in names])
    got = exact_dedup.keep_one(df, longest=longest)
    assert got.columns == df.columns
    rows = got.collect()
    want = {(k, sha) for _, k, _, sha in plainly(ROWS, longest)[0]}
    assert sorted(((r.doc_id, hashlib.sha256((r.text or "").translate(BLANKS).encode()).hexdigest()) for r in rows), key=str) == sorted(want, key=str)
    assert all(r[c] == f"{c} of {'?' if r.doc_id is None else r.doc_id}" for r in rows for c in names)


def test_corpus(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = sorted((tuple(r) for r in exact_dedup.classes(docs, longest=True).select("doc_id", "keep_id", "group_size", "text_sha256").collect()), key=str)
    assert got == plainly([tuple(r) for r in docs.select("doc_id", "text").collect()], True)[0]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, more int")
    assert exact_dedup.classes(df).count() == 0
    assert exact_dedup.keep_one(df).count() == 0


def test_hot_keys_join_where_they_are(spark):
    """A third of all rows under one key: the same rows as a plain join, with nulls and missing keys gone."""
    n = 3000
    rows = materialize(spark.range(n).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 == 1, None).otherwise(F.col("id")).alias("k"), "id"), "t-rows")
    one = materialize(rows.filter("k is not null and k % 11 != 3").groupBy("k").agg(F.count("*").alias("n")), "t-one")
    got = dealt_join(rows, one, ["k"], "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(one, "k").collect()))
