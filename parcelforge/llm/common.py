"""What the training-data operators share: tables, folds and Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.session import materialize

#: Rows and bytes in an Arrow batch of whole texts: bounds what a Python worker holds at once.
TEXT_BATCH_ROWS = 2000
TEXT_BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``; -1 for a null id, which so is in no named fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(-1))


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small; smaller settings of the session stay, larger ones are lowered in it."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def map_arrow(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``step`` to each Arrow batch, with batches small enough for long texts."""
    bounded_batches(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(step, batches)

    return df.mapInArrow(each, schema)


#: Bytes of a written list that may be broadcast; a longer one is joined by shuffle.
BROADCAST_BYTES = 32_000_000


def by_size(rows: DataFrame, row_bytes: int | Column = 8) -> DataFrame:
    """Written rows, marked for broadcast if all of them, at ``row_bytes`` each, are small enough."""
    size = rows.count() * row_bytes if isinstance(row_bytes, int) else rows.agg(F.coalesce(F.sum(row_bytes), F.lit(0))).first()[0]
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows


def dealt_join(rows: DataFrame, one: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Each of ``rows`` with the row that ``one`` has for its keys; rows without one go.

    ``weight`` counts the rows of a key. Keys that may fill a quarter of a shuffle partition
    alone are fewer than four times the partitions, so they are broadcast and their rows stay
    where they are; the others are joined by shuffle. ``rows`` and ``one`` are written tables.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = one.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = F.col(weight) * 4 * parts > total
    heavy = F.broadcast(one.filter(hot))
    return rows.join(heavy, keys).unionByName(rows.join(heavy.select(*keys), keys, "left_anti").join(one.filter(~hot), keys))


def without(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id isn't among the doc_id of ``ids``; rows with a null id stay.

    The caller's columns travel inside a struct, so none of their names can clash.
    """
    gone = materialize(ids.select(F.col("doc_id").cast("long").alias("gone")).dropna().distinct(), "gone")
    rows = documents.select(F.struct("*").alias("row"))
    return rows.join(by_size(gone), F.col("row.doc_id").cast("long") == F.col("gone"), "left_anti").select("row.*")
