"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "parcelforge", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; anything in ``conf`` wins."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.ui.enabled": "false",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in spark.checkpoint.dir. Where that is unset, a local master gets a
    new temporary folder, kept in the session's settings; any other master is an error, for
    its executors would each write to a disk of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("parcelforge.shared.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        found = "file://" + tempfile.mkdtemp(prefix="parcelforge-")
        spark.conf.set("parcelforge.shared.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, so a lost executor costs no more than the last step, and keeps
    later plans from computing ``df`` twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_at = path
    return written


def discard(written: DataFrame) -> None:
    """Delete the table of ``materialize``; nothing that still has to be computed may read it."""
    jvm, context = written.sparkSession._jvm, written.sparkSession.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(written.written_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
