"""Exact copies: one row of each class of equal texts stays.

Texts are equal when they are the same bytes after deleting blanks. One pass over the texts
makes a narrow table (id, 128-bit content hash, length, digest); grouping it by the hash,
combined before the shuffle, gives each group's size and the row that stays. Bytes are then
compared inside the groups of more than one row: their least and greatest text must be the
same, which again combines before the shuffle, so of a hot group each task sends one text.
Groups in which they differ (a collision of the hash) are grouped anew by hash and text.

Skew: rows get their group's answer from ``dealt_join``; no group is ever collected.
Which texts are read a second time: those of groups of several rows where the list of these
groups may be broadcast, else all.

Defined results: null counts as empty, and empty texts (only blanks) are equal; of rows
that are alike in everything, ids included, exactly one stays; a null id sorts behind all
others; very long texts count whole; extra columns are not read by ``classes`` and returned
as they are by ``keep_one``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.llm.common import BROADCAST_BYTES, by_size, dealt_join, table
from parcelforge.session import materialize

BLANKS = " \t\n\x0b\x0c\r"
#: Bytes of a content hash in a broadcast list, with its row's overhead.
KEY_BYTES = 48


def without_blanks(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def content_hash(text: Column) -> Column:
    """128 bits of the text, as binary."""
    return F.unhex(F.md5(text))


def _best(longest: bool) -> Column:
    """The row that stays: (longest original first, where asked for,) least id, null ids last."""
    length = -F.col("n_points") if longest else F.lit(0)
    return F.min(F.struct(length.alias("length"), F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("best")


def _answer(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    joined = dealt_join(rows, groups, keys, "group_size")
    return joined.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", "key")


def classes(documents: DataFrame, normal: Callable[[Column], Column] = without_blanks, key: Callable[[Column], Column] = content_hash, longest: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, key): the class of every row.

    ``normal`` says what of a text counts and ``key`` hashes that; any function is right,
    a weak one only makes more work. The least id stays, or with ``longest`` the least id
    of the rows with the most code points.
    """
    # the normal form is made once, in a projection of its own
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.char_length(F.col("text").cast("string")), F.lit(0)).alias("n_points"), normal(F.col("text")).alias("text"))
    keyed = texts.select("doc_id", "n_points", key(F.col("text")).alias("key"), F.sha2(F.col("text"), 256).alias("text_sha256"), "text").withColumn("row", F.monotonically_increasing_id())
    rows = materialize(keyed.drop("text"), "exact-rows")
    groups = materialize(rows.groupBy("key").agg(F.count("*").alias("group_size"), _best(longest)), "exact-groups")

    several = groups.filter("group_size > 1").select("key")
    compared = keyed.select("key", "text")
    if several.count() * KEY_BYTES <= BROADCAST_BYTES:
        compared = compared.join(F.broadcast(several), "key", "left_semi")
    unlike = materialize(compared.groupBy("key").agg(F.min("text").alias("least"), F.max("text").alias("most")).filter("least != most").select("key"), "exact-unlike")
    if unlike.isEmpty():
        return _answer(rows, groups, ["key"])
    listed = by_size(unlike, KEY_BYTES)
    mixed = materialize(keyed.join(listed, "key", "left_semi"), "exact-mixed")
    apart = materialize(mixed.groupBy("key", "text").agg(F.count("*").alias("group_size"), _best(longest)), "exact-apart")
    return _answer(rows.join(listed, "key", "left_anti"), groups.join(listed, "key", "left_anti"), ["key"]).unionByName(_answer(mixed, apart, ["key", "text"]))


def keep_one(documents: DataFrame, normal: Callable[[Column], Column] = without_blanks, key: Callable[[Column], Column] = content_hash, longest: bool = False) -> DataFrame:
    """The documents, with all their columns, without those that are copies of a row that stays."""
    stays = classes(documents, normal, key, longest).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    found = materialize(stays.groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).agg(F.count("*").alias("times")), "exact-kept")
    # the caller's columns stay inside a struct until the end, so none of their names can clash
    text = F.col("row.text")
    rows = documents.select(F.struct("*").alias("row")).withColumns({"own_id": F.col("row.doc_id").cast("long"), "own_sha": F.sha2(normal(text), 256)})
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_sha") == F.col("sha"))
    once = rows.join(by_size(found.filter("times = 1"), 120), same, "left_semi")
    # rows that share the id and the text of the one that stays: any, or the longest of them
    points = F.coalesce(F.char_length(text.cast("string")), F.lit(0))
    again = rows.join(by_size(found.filter("times > 1"), 120), same, "left_semi").groupBy("own_id", "own_sha").agg((F.max_by("row", points) if longest else F.any_value("row")).alias("row"))
    return once.select("row.*").union(again.select("row.*"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), longest=True).drop("key")


OP13_SQL = r"""
with t as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by body) as group_size, row_number() over w = 1 as kept, sha256(body) as text_sha256
from t window w as (partition by body order by n desc, doc_id nulls last)
"""
