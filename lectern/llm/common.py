"""Shared steps of the operators in this package."""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.functions.text import let
from lectern.session import scratch_path

#: Rows are handed to vectorised code in groups of about this many bytes.
GROUP_CHARS = 1 << 20


_HELD: dict[str, Any] = {}


def held(kind: str, make: Callable[[], Any] = dict) -> Any:
    """What a worker process keeps from task to task for one operator, made when it is first asked for.

    Workers outlive stages. What other operators left there is dropped, so that
    their caches never add up.
    """
    if kind not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[kind] = make()
    return _HELD[kind]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, text: int = 1, limit: int = GROUP_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have a bounded number of bytes; a longer text goes alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        done = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(first, end - first)
        first = end


def grouped(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = GROUP_CHARS
            ) -> Iterator[tuple[list[list[Any]], list[str]]]:
    """Rows of Arrow batches in groups of bounded text (in bytes): the other columns as lists, and the texts (null: empty)."""
    for batch in batches:
        for part in slices(batch, text, limit):
            others = [part.column(j).to_pylist() for j in range(part.num_columns) if j != text]
            yield others, [x or "" for x in part.column(text).to_pylist()]


def range_of(rows: DataFrame, key: str, groups: int) -> Column:
    """The place of a row's key among about ``groups`` ranges of equal size, ascending; NULL keys are in the first.

    Only the borders pass through the driver. They are looked up in two steps
    of about the root of their number.
    """
    shares = [(i + 1) / groups for i in range(groups - 1)] or [1.0]
    borders = sorted(set(rows.agg(F.percentile_approx(key, shares, F.lit(10 * groups))).first()[0] or []))
    wide = max(1, math.isqrt(len(borders)))
    inner = [borders[i : i + wide] for i in range(0, len(borders), wide)]
    outer = F.array(*(F.lit(x[-1]) for x in inner)).cast("array<bigint>")
    chosen = F.array(*(F.array(*map(F.lit, x)).cast("array<bigint>") for x in [*inner, []]))

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda x: x < F.col(key)))

    return let(below(outer), lambda o: o * wide + below(F.get(chosen, o))).cast("int")


def free(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def training_rows(key="doc_id"):
    """True for rows that may be learned from: crc32 of the id as text leaves no remainder 1 by three."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 != 1


def held_out(key="doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
