"""Table scans: parquet folders or a database over JDBC."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.config import TableConfig
from lectern.operators.documents import build_documents, drop_sensitive


@dataclass(frozen=True)
class Parquet:
    """A folder with one parquet entry per table."""
    root: str

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.parquet(f"{self.root}/{table}.parquet")


@dataclass(frozen=True)
class Jdbc:
    """A database. ``split`` maps a table to (column, lower, upper, partitions)."""
    url: str
    properties: dict[str, str] = field(default_factory=dict, hash=False)
    split: dict[str, tuple[str, str, str, int]] = field(default_factory=dict, hash=False)

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        reader = spark.read.format("jdbc").option("url", self.url).option("dbtable", table)
        for name, value in self.properties.items():
            reader = reader.option(name, value)
        if table in self.split:
            column, lower, upper, parts = self.split[table]
            reader = (reader.option("partitionColumn", column).option("lowerBound", lower)
                      .option("upperBound", upper).option("numPartitions", parts))
        return reader.load()


Source = Parquet | Jdbc


def widen(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan with fewer splits than cores before work that costs CPU per row.

    Few splits mean few bytes, so the exchange is small; a large table has
    more splits than cores and is left alone. Without keys all columns are hashed.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    hashable = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return df.repartition(cores, *(keys or hashable))


def scan_changed(df: DataFrame, date_column: str, since=None, ordered: bool = True) -> DataFrame:
    """Rows at or after ``since`` by date; NULL ``since`` reads all."""
    rows = df if since is None else df.where(F.col(date_column) >= F.lit(since).cast(df.schema[date_column].dataType))
    return rows.orderBy(date_column) if ordered else rows


def scan_first(df: DataFrame, key: str, n: int) -> DataFrame:
    """Bounded scan; ordered, so that it gives the same rows each time."""
    return df.orderBy(key).limit(n)


def fan_in(spark: SparkSession, source: Source, configs: Sequence[TableConfig],
           rows: Callable[[DataFrame, TableConfig], DataFrame] = lambda df, cfg: df,
           ) -> tuple[DataFrame | None, dict[str, str]]:
    """Documents of all tables, and the error of every table that could not be read or rendered."""
    parts: list[DataFrame] = []
    errors: dict[str, str] = {}
    for cfg in configs:
        try:
            parts.append(build_documents(rows(drop_sensitive(source.read(spark, cfg.table)), cfg), cfg))
        except Exception as exc:  # one unreadable table must not stop the others
            errors[cfg.key] = str(exc).split("\n")[0]
    documents = reduce(DataFrame.unionByName, parts) if parts else None
    return documents, errors
