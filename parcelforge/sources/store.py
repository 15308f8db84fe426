"""The property store: Parquet tables below one folder, staged by run and promoted whole.

A table's live version is the one that its newest marker names. A write goes to a folder of
its own and is promoted by writing one small marker, so readers see the old rows or the
new ones, never a mixture, and a run that dies leaves nothing that is read.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.sources.schemas import SCHEMAS


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- versions
    def _versions(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("table_name string, version string, promoted_at timestamp, run_id string").json(f"{self.root}/_versions")
        except AnalysisException:
            return None

    def version(self, table: str) -> str | None:
        found = self._versions()
        if found is None:
            return None
        row = found.filter(F.col("table_name") == table).agg(F.max_by("version", F.struct("promoted_at", "version"))).first()
        return row[0]

    def read(self, table: str) -> DataFrame:
        """The live rows; a table that was never written is empty."""
        version = self.version(table)
        if version is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.parquet(f"{self.root}/{table}/{version}")

    def promote_together(self, tables: dict[str, DataFrame], run_id: str = "") -> None:
        """New versions of several tables, all named by one marker: readers see all of them or none."""
        marks = []
        for table, rows in tables.items():
            version = f"v-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.root}/{table}/{version}")
            marks.append((table, version, run_id))
        if marks:
            now = datetime.now(UTC)
            mark = self.spark.createDataFrame([(t, v, now, r) for t, v, r in marks], "table_name string, version string, promoted_at timestamp, run_id string")
            mark.coalesce(1).write.mode("append").json(f"{self.root}/_versions")

    def _promote(self, table: str, rows: DataFrame, run_id: str, partition: list[str] | None = None) -> str:
        version = f"v-{uuid.uuid4().hex}"
        writer = rows.write
        if partition:
            writer = writer.partitionBy(*partition)
        writer.parquet(f"{self.root}/{table}/{version}")
        mark = self.spark.createDataFrame([(table, version, datetime.now(UTC), run_id)], "table_name string, version string, promoted_at timestamp, run_id string")
        mark.coalesce(1).write.mode("append").json(f"{self.root}/_versions")
        return version

    # --- staging
    def stage(self, table: str, run_id: str, rows: DataFrame) -> DataFrame:
        """Write a run's rows, replacing what the same run staged before."""
        path = f"{self.root}/_staging/{table}/run_id={run_id}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    # --- sinks
    def replace(self, table: str, rows: DataFrame, run_id: str = "") -> str:
        """All rows are new."""
        return self._promote(table, rows, run_id)

    def replace_sources(self, table: str, rows: DataFrame, run_id: str = "", key: str = "source_id") -> str:
        """The sources that ``rows`` has are replaced, others stay."""
        old = self.read(table).join(rows.select(key).distinct(), key, "left_anti")
        return self._promote(table, old.unionByName(rows, allowMissingColumns=True), run_id)

    def upsert(self, table: str, rows: DataFrame, keys: list[str], run_id: str = "") -> str:
        """Of each key the new row, the last one if there are several; needs an ``ordinal`` in ``rows``."""
        old = self.read(table).withColumn("ordinal", F.lit(-1).cast("long"))
        both = old.unionByName(rows.withColumn("ordinal", F.col("ordinal").cast("long")), allowMissingColumns=True)
        columns = [c for c in both.columns if c not in (*keys, "ordinal")]
        last = both.groupBy(*keys).agg(F.max_by(F.struct(*columns), "ordinal").alias("r")).select(*keys, "r.*")
        return self._promote(table, last, run_id)

    def insert_new(self, table: str, rows: DataFrame, keys: list[str], run_id: str = "") -> str:
        """Rows whose key isn't there yet, nulls in keys being equal to each other."""
        old = self.read(table)
        o, n = old.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct(), rows.dropDuplicates(keys)
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return self._promote(table, old.unionByName(n.join(o, same, "left_anti"), allowMissingColumns=True), run_id)

    def merge(self, table: str, rows: DataFrame, fold, run_id: str = "") -> str:
        """``fold`` of old rows (ordinal -1) and new ones, such as the merge folds of the ingestion."""
        old = self.read(table).withColumn("ordinal", F.lit(-1).cast("long"))
        return self._promote(table, fold(old.unionByName(rows, allowMissingColumns=True)), run_id)

    def log(self, table: str, rows: DataFrame) -> None:
        """Append to a log table (runs, alerts, checks)."""
        rows.write.mode("append").parquet(f"{self.root}/_log/{table}")

    def latest_log(self, table: str, key: str, at: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.root}/_log/{table}")
        return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), at).alias("r")).select("r.*")

    def export_csv(self, rows: DataFrame, path: str, columns: list[str]) -> None:
        """Review rows with fixed columns; missing ones stay empty."""
        chosen = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]
        rows.select(*chosen).write.mode("overwrite").option("header", True).csv(path)

    def summary(self) -> DataFrame:
        """(table, columns, rows) of every promoted table."""
        found = self._versions()
        names = sorted(r[0] for r in found.select("table_name").distinct().collect()) if found is not None else []
        out = [(n, (df := self.read(n)).columns, df.count()) for n in names]
        return self.spark.createDataFrame(out, "table_name string, columns array<string>, n long")
