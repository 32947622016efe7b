"""Leaving out rows of a wide table that cannot meet a list of keys, before anything of it is shuffled.

The keys become a Bloom filter of bitmaps, built by Spark's bitmap aggregates and sent to every task. It
has ``BITS`` bits for each key up to a fixed size, whatever the number of keys: beyond that more rows pass, never fewer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of one bitmap, as the bitmap functions have it.
WORD = 32_768
#: Bits for each key, and those of the whole filter: 64 MB.
BITS, MOST = 16, 1 << 29
SEEDS = (17, 4711)


def _place(key: str, seed: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(bits))


def _is_set(word: Column, place: Column) -> Column:
    at = F.pmod(place, F.lit(WORD))
    byte = F.conv(F.hex(F.substring(word, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    return F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1


def maybe_among(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key is in the one column of ``keys``, and a few others; no row that is in it is left out."""
    (name,) = keys.columns
    n = keys.count()
    bits = min(MOST, WORD * -(-max(1, n) * BITS // WORD))
    places = keys.select(F.explode(F.array(*(_place(name, s, bits) for s in SEEDS))).alias("_at"))
    words = places.groupBy((F.col("_at") / WORD).cast("int").alias("_word")).agg(
        F.bitmap_construct_agg(F.pmod("_at", F.lit(WORD))).alias("_bits"))
    columns = df.columns
    for i, seed in enumerate(SEEDS):
        own = words.select(F.col("_word").alias(f"_word{i}"), F.col("_bits").alias(f"_bits{i}"))
        at = _place(key, seed, bits)
        df = df.withColumn(f"_word{i}", (at / WORD).cast("int")).join(F.broadcast(own), f"_word{i}")
    found = reduce(Column.__and__, (_is_set(F.col(f"_bits{i}"), _place(key, s, bits)) for i, s in enumerate(SEEDS)))
    return df.where(found).select(*columns)
