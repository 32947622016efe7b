"""Upsert, precedence, dedup and set operations over document tables.

Every "one row per key" rule is a ``row_number`` with a small limit or a
``min_by``/``max_by``. Both are pre-aggregated before the shuffle, so a key that
holds a third of all rows still sends at most a few rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.operators.skew import SMALL_KEYS, fits_broadcast, skewed_join
from lectern.session import materialise


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int = 1,
                  rank: str | None = None) -> DataFrame:
    """First ``n`` rows per group by a total order."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    name = rank or "_place"
    out = df.withColumn(name, place).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def one_per_key(docs: DataFrame, key: str = "doc_id", version: str = "version", then: str = "text",
                small_keys: int = SMALL_KEYS) -> DataFrame:
    """Last write per key within one scan.

    Keys are counted first, on the key column alone. Rows whose key occurs
    once, normally all of them, then pass without a shuffle of their texts;
    only with very many repeated keys do all rows meet by key.
    """
    order = [F.col(version).desc_nulls_last(), F.desc(then)]
    counted = docs.groupBy(key).agg(F.count("*").alias("_n"))
    repeated = materialise(counted.where(F.col("_n") > 1).select(key), "repeated")
    if not fits_broadcast(repeated, small_keys):
        return top_per_group(docs, [key], order)
    single = docs.join(F.broadcast(repeated), key, "left_anti")
    several = docs.join(F.broadcast(repeated), key, "left_semi")
    return single.unionByName(top_per_group(several, [key], order))


def union_sources(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def upsert_latest(current: DataFrame, *deltas: DataFrame, key: str = "doc_id", version: str = "version",
                  position: str | None = None) -> DataFrame:
    """Last write per key. A later delta wins whatever its version, which orders the rows within one delta only."""
    frames = [f.withColumn("_batch", F.lit(i)) for i, f in enumerate((current, *deltas))]
    order = [F.desc("_batch"), F.col(version).desc_nulls_last()]
    if position:
        order.append(F.desc(position))
    return top_per_group(union_sources(*frames), [key], order).drop("_batch")


def live(log: DataFrame, key: str, order: Sequence[str], deleted: Column) -> DataFrame:
    """Latest change per key, without keys whose latest change removed them."""
    latest = top_per_group(log, [key], [F.desc(c) for c in order])
    return latest.where(~F.coalesce(deleted, F.lit(False)))


def apply_changes(current: DataFrame, changes: DataFrame, key: str = "doc_id", small_keys: int = SMALL_KEYS,
                  then: Sequence[str] = ("text",)) -> DataFrame:
    """A collection with one row per key after a log of ``(..., version, batch, deleted)``.

    The later batch wins, the newest version within a batch, then the columns ``then`` decide. Keys are counted
    first, on the key column alone: changes whose key occurs once, normally all of them, pass as they are, with the
    columns that are asked for and no others. The others meet by ``max_by``, so that a key changed very often sends one row per task. Rows of the
    collection whose key occurs in the log go, the others are only scanned where the keys are few and short enough to be
    sent to every task; beyond that they stream past the keys of their partition, and are not sorted.
    """
    return union_sources(*changed_parts(current, changes, key, small_keys, then))


def changed_parts(current: DataFrame, changes: DataFrame, key: str = "doc_id", small_keys: int = SMALL_KEYS,
                  then: Sequence[str] = ("text",)) -> list[DataFrame]:
    """The same in parts: rows that stay, then changed rows."""
    counted = changes.groupBy(key).agg(F.count("*").alias("_n"))
    keys = counted.select(key)
    keys = F.broadcast(keys) if fits_broadcast(keys, small_keys) else keys.hint("shuffle_hash")
    repeated = counted.where("_n > 1").select(F.col(key).alias("_repeated"))
    if fits_broadcast(repeated, small_keys):
        same = F.col(key).eqNullSafe(F.col("_repeated"))
        newest = [changes.join(F.broadcast(repeated), same, "left_anti"),
                  _last_changes(changes.join(F.broadcast(repeated), same, "left_semi"), key, then)]
    else:
        newest = [_last_changes(changes, key, then)]
    return [current.join(keys, key, "left_anti"), *(n.where("NOT deleted").select(*current.columns) for n in newest)]


def _last_changes(changes: DataFrame, key: str, then: Sequence[str]) -> DataFrame:
    last = F.max_by(F.struct(*(c for c in changes.columns if c != key)), F.struct("batch", "version", *then))
    return changes.groupBy(key).agg(last.alias("_row")).select(key, "_row.*")


def precedence_merge(sources: Sequence[DataFrame], keys: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Earlier sources win per key; the last one adds only groups no earlier source knows."""
    *first, fallback = sources
    known = reduce(DataFrame.unionByName, [s.withColumn("_tier", F.lit(i)) for i, s in enumerate(first)])
    fresh = skewed_join(fallback, known.select(*group).distinct(), group, "left_anti")
    tiers = known.unionByName(fresh.withColumn("_tier", F.lit(len(first))))
    return top_per_group(tiers, keys, ["_tier"]).drop("_tier")


def physical_dedup(df: DataFrame, physical: Sequence[str], priority: Sequence[Column | str]) -> DataFrame:
    """First row per physical key; rows without one pass, and skip the shuffle."""
    unknown = reduce(Column.__or__, [F.col(c).isNull() for c in physical])
    kept = top_per_group(df.where(~unknown), physical, priority)
    return kept.unionByName(df.where(unknown))


def first_by(df: DataFrame, group: Sequence[str], preferred: Column, order: Sequence[str],
             columns: Sequence[str]) -> DataFrame:
    """First row per group among the preferred ones, else first of all."""
    place = F.struct((~preferred).alias("later"), *order)
    picked = df.groupBy(*group).agg(F.min_by(F.struct(*columns), place).alias("_row"))
    return picked.select(*group, "_row.*")


def difference(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    return left.select(*columns).subtract(right.select(*columns))


def overlaps(df: DataFrame, group: Sequence[str], item: str, items: DataFrame) -> DataFrame:
    """Per group: does its set of items meet the given one?"""
    known = items.select(item).distinct().withColumn("_known", F.lit(True))
    return (skewed_join(df.select(*group, item).distinct(), known, [item], "left", cheap=True)
            .groupBy(*group).agg(F.coalesce(F.bool_or("_known"), F.lit(False)).alias("overlaps")))


def content_dedup(df: DataFrame, text: str, key: str) -> DataFrame:
    """One row per distinct text, the one with the lowest key."""
    others = [c for c in df.columns if c != text]
    picked = df.groupBy(F.sha2(F.col(text), 256).alias("content_hash")).agg(
        F.min_by(F.struct(*others), F.col(key)).alias("_row"), F.count("*").alias("copies"))
    return picked.select("content_hash", "_row.*", "copies")
