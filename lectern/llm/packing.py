"""Packing of documents into token sequences by minimum bin slack.

Lengths are whole numbers up to the capacity, so the pieces of a corpus are a
histogram of at most ``capacity`` lengths. The plan works on that histogram: the
longest length left opens a bin, a bitset of reachable sums finds the fullest
feasible fill for the rest of it, and the combination is taken out as many
times as its lengths last. Pieces then find their place by their rank among
the pieces of equal length, which is counted in spread groups.

Defined cases: null text counts as empty (a piece of the end id alone); a null
document id sorts first; rows that repeat an id are packed, all of them; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lectern.llm.common import slices, stored
from lectern.llm.tokenizer import ENCODED, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Groups into which pieces of one length are spread while they are ranked.
SPREAD = 256


def pieces(docs: DataFrame, path: str, end: int, capacity: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece. A longer document is cut so that all pieces but the first are full."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for some in slices(batch, limit=ENCODED):
                rows: list[list] = [[], [], [], [], []]
                for doc, raw in zip(some.column(0).to_pylist(), enc.encode(some.column(1).fill_null("")), strict=True):
                    ids = np.append(np.frombuffer(raw, enc.dtype), enc.dtype.type(end)).astype("<u4")
                    head = (len(ids) - 1) % capacity + 1
                    for k, at in enumerate([0, *range(head, len(ids), capacity)]):
                        part = ids[at : head if not k else at + capacity]
                        for c, v in zip(rows, (doc, k, at, len(part), zlib.crc32(part.tobytes())), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if j == 1 else pa.int64()) for j, c in enumerate(rows)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, PIECES)


def fullest(left: Mapping[int, int], room: int) -> list[int]:
    """Lengths, longest first, whose sum is the greatest that fits; each is used as often as it is left at most."""
    reach, mask = 1, (1 << (room + 1)) - 1
    steps = []
    for n in sorted((n for n, c in left.items() if c and n <= room), reverse=True):
        copies, block = min(left[n], room // n), 1
        while copies:
            take = min(block, copies)
            steps.append((n, take, reach))
            reach = (reach | reach << n * take) & mask
            copies, block = copies - take, block * 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    out: list[int] = []
    for n, take, before in reversed(steps):
        if not before >> total & 1:
            out += [n] * take
            total -= n * take
    return sorted(out, reverse=True)


def plan(histogram: Mapping[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Slots (length, first rank, end rank, uses, first sequence, offset) and the number of sequences."""
    left = {int(n): int(c) for n, c in histogram.items() if c}
    done = dict.fromkeys(left, 0)
    slots, sequence = [], 0
    while left:
        top = max(left)
        rest = {**left, top: left[top] - 1}
        bin_ = [top, *fullest(rest, capacity - top)]
        uses = {n: bin_.count(n) for n in bin_}
        times = min(left[n] // u for n, u in uses.items())
        offset = 0
        for n, u in uses.items():
            slots.append((n, done[n], done[n] + u * times, u, sequence, offset))
            offset += n * u
            done[n] += u * times
            left[n] -= u * times
            if not left[n]:
                del left[n]
        sequence += times
    return slots, sequence


def place(rows: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that are cheap to read again."""
    spark = rows.sparkSession
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, _ = plan(histogram, capacity)
    # At most ``capacity`` lengths times SPREAD groups are counted; slots depend on the histogram alone.
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SPREAD)))
    counted = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("length", "_salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (salted.withColumn("_rank", F.row_number().over(inside) - 1)
              .join(offsets, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before")))
    table = spark.createDataFrame(slots, "length long, _from long, _to long, _uses long, _sequence long, _offset long")
    at = F.col("_rank") - F.col("_from")
    return (ranked.join(F.broadcast(table), "length").where("_rank >= _from AND _rank < _to")
            .select("doc_id", "piece", "start", "length", "ids_crc32",
                    (F.col("_sequence") + F.floor(at / F.col("_uses"))).cast("long").alias("sequence_id"),
                    (F.col("_offset") + F.pmod(at, F.col("_uses")) * F.col("length")).cast("long").alias("offset")))


def pack(docs: DataFrame, path: str, end: int = 0, capacity: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece with its sequence and its place there."""
    return place(stored(pieces(docs, path, end, capacity, text, key), "pieces"), capacity)
