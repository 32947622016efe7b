"""The run ledger: an append-only table with one row per table and run."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.operators.rollups import latest_state

LEDGER_SCHEMA = ("run_id string, run_ts timestamp_ntz, table_key string, mode string, watermark timestamp_ntz, "
                 "records bigint, status string, error string, duration_ms double")


class Ledger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.path = f"{root.rstrip('/')}/ledger"

    def append(self, rows: DataFrame | Sequence[tuple]) -> None:
        frame = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(list(rows), LEDGER_SCHEMA)
        frame.write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        """All runs; empty when nothing was written yet."""
        try:
            return self.spark.read.schema(LEDGER_SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], LEDGER_SCHEMA)

    def latest(self) -> DataFrame:
        return latest_state(self.read(), "table_key", ["run_ts", "run_id"],
                            ["run_ts", "mode", "watermark", "records", "status", "error"])

    def watermarks(self) -> dict[str, datetime]:
        """Highest date read by a successful run, per configured table."""
        done = self.read().where("status = 'success' AND watermark IS NOT NULL")
        rows = done.groupBy("table_key").agg(F.max("watermark").alias("watermark")).collect()
        return {r["table_key"]: r["watermark"] for r in rows}
