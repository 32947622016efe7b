"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lectern.session import materialise

ROWS_PER_COPY = 1_000_000
SMALL_ROWS = 100_000
SMALL_KEYS = 1_000_000
SMALL_BYTES = 64 << 20


def _row_bytes(schema: T.StructType) -> Column:
    sizes = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint"))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            sizes.append(F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)).cast("bigint"))
    return reduce(Column.__add__, sizes, F.lit(16 * len(schema.fields)).cast("bigint"))


def fits_broadcast(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> bool:
    """Is the table within both bounds? Reads row sizes only, stops past the row bound, and brings back two numbers."""
    sizes = df.select(_row_bytes(df.schema).alias("b")).limit(rows + 1)
    n, total = sizes.agg(F.count("*"), F.sum("b")).first()
    return n <= rows and (total or 0) <= size


def skewed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", *, cheap: bool = False,
                rows_per_copy: int = ROWS_PER_COPY) -> DataFrame:
    """Join of many left rows to a right side with few rows per key.

    A right side that is ``cheap`` to read is measured first, and broadcast when
    it is small. Otherwise every key with more than ``rows_per_copy`` left rows
    is spread over several tasks by input partition, with its right rows copied
    to each. There are at most rows / ``rows_per_copy`` such keys; where their
    list is too long to broadcast all the same, the bound is raised until it is
    not. Rows with a NULL key meet nothing and do not enter the join.
    ``how`` is inner, left, left_semi or left_anti.
    """
    keys = list(keys)
    if cheap and fits_broadcast(right):
        return left.join(F.broadcast(right), keys, how)
    one = F.lit(1).cast("bigint")
    unknown = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    known = left.where(~unknown)
    counted = materialise(known.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > rows_per_copy), "hot")
    bound = rows_per_copy
    while not fits_broadcast(counted.where(F.col("_n") > bound)):
        bound *= 2
    hot = counted.where(F.col("_n") > bound).select(
        *keys, F.ceil(F.col("_n") / F.lit(bound)).cast("bigint").alias("_copies"))
    # The partition number needs no column of the row, and is the same when a task runs again.
    many = (known.withColumn("_part", F.spark_partition_id().cast("bigint")).join(F.broadcast(hot), keys, "left")
            .withColumn("_salt", F.pmod("_part", F.coalesce("_copies", one))).drop("_copies", "_part"))
    copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_copies", one) - 1)
    few = right.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(copies)).drop("_copies")
    met = many.join(few, [*keys, "_salt"], how).drop("_salt")
    if how not in ("left", "left_anti"):
        return met
    return met.unionByName(left.where(unknown), allowMissingColumns=True)
