"""Periodic refresh as a stream over a landing folder, and the time-window analogues of the service layer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def refresh_on_arrival(spark: SparkSession, folder: str, schema: str, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand every batch of new files once to ``apply``; files already seen stay seen across restarts."""
    arrived = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(folder)
    return arrived.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def request_rates(events: DataFrame, window: str = "60 seconds", late: str = "5 minutes") -> DataFrame:
    """Requests of each user in each window; works on streams and tables alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window).alias("w"), "user_id").agg(F.count("*").alias("requests")).select(F.col("w.start").alias("window_start"), "user_id", "requests")


def rate_limited(events: DataFrame, most: int, window: str = "60 seconds") -> DataFrame:
    return request_rates(events, window).filter(F.col("requests") > most)


def age_days(now: Column, promoted_at: Column) -> Column:
    return F.datediff(now, promoted_at)


def freshness(versions: DataFrame, now: str, most_days: int) -> DataFrame:
    """(dataset, age_days, degraded) of the newest version of each dataset; ``now`` is given, so the answer is reproducible."""
    newest = versions.groupBy("dataset").agg(F.max("promoted_at").alias("promoted_at"))
    age = age_days(F.lit(now).cast("timestamp"), F.col("promoted_at"))
    return newest.select("dataset", age.cast("long").alias("age_days"), (age > most_days).alias("degraded"))
