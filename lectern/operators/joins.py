"""Joins between documents, their chunks, their files and their sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lectern.functions import text as X
from lectern.operators.prefilter import maybe_among
from lectern.operators.skew import SMALL_KEYS, fits_broadcast, skewed_join
from lectern.session import materialise

CHUNK_MARK = ".chunk_"


def active_children(child: DataFrame, parent: DataFrame, on: Sequence[str], child_selected: Column,
                    parent_active: Column) -> DataFrame:
    """Selected children of active parents."""
    return skewed_join(child.where(child_selected), parent.where(parent_active), on, cheap=True)


def deselect(df: DataFrame, exclusions: DataFrame, keys: Sequence[str]) -> DataFrame:
    return skewed_join(df, exclusions.select(*keys).distinct(), keys, "left_anti", cheap=True)


def stale_documents(collection: DataFrame, source: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents whose source row is gone."""
    return collection.join(source.select(key), key, "left_anti")


def lookup(docs: DataFrame, ids: DataFrame, key: str = "doc_id", small_ids: int = SMALL_KEYS) -> DataFrame:
    """Documents with the ids of a list, in which ids may repeat.

    Few ids are sent to every task. Beyond that, only documents that may be wanted are shuffled, and stream past the ids
    of their partition: no task sorts texts.
    """
    wanted = ids.select(key).distinct()
    if fits_broadcast(wanted, small_ids):
        return docs.join(F.broadcast(wanted), key, "left_semi")
    return maybe_among(docs, key, wanted).join(wanted.hint("shuffle_hash"), key, "left_semi")


def overlay(base: DataFrame, patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Non-empty patch values win; rows of either side stay, those of the patch alone as they are."""
    def filled(c: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, T.StringType):
            return F.when(c != "", c)
        if isinstance(dtype, (T.ArrayType, T.MapType)):
            return F.when(F.size(c) > 0, c)
        return c

    b, p = base.alias("b"), patch.alias("p")
    joined = b.join(p, [F.col(f"b.{k}") == F.col(f"p.{k}") for k in keys], "full_outer")
    columns = [F.coalesce(f"b.{k}", f"p.{k}").alias(k) for k in keys]
    for f in base.schema.fields:
        if f.name in keys:
            continue
        own = F.col(f"b.{f.name}")
        new = F.col(f"p.{f.name}") if f.name in patch.columns else None
        columns.append((own if new is None else F.coalesce(filled(new, f.dataType), own, new)).alias(f.name))
    return joined.select(*columns)


def is_chunk(doc_id: Column) -> Column:
    return F.contains(doc_id, F.lit(CHUNK_MARK))


def first_chunk_id(doc_id: Column) -> Column:
    return F.concat(doc_id, F.lit(CHUNK_MARK + "0"))


def enrich_first_chunk(hits: DataFrame, collection: DataFrame, columns: Sequence[str],
                       small: bool = False) -> DataFrame:
    """Hits plus the first file chunk of every record hit that has one and is not a hit itself.

    The chunk takes over the score and rank of its parent and follows it
    directly: ``position`` orders the enlarged list. ``small`` says that the
    hits are of a proven small size and may be sent to every task.
    """
    wanted = (
        hits.where(~is_chunk(F.col("doc_id")))
        .select("query_id", "rank", "score", first_chunk_id(F.col("doc_id")).alias("doc_id"))
        .join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    )
    chunks = collection.select("doc_id", *columns).where(is_chunk(F.col("doc_id")))
    if small:
        added = chunks.join(F.broadcast(wanted), "doc_id")
    else:
        # Only texts of chunks that may be wanted are shuffled; a record of very many hits is spread over tasks.
        wanted = materialise(wanted, "wanted")
        added = skewed_join(wanted, maybe_among(chunks, "doc_id", wanted.select("doc_id").distinct()), ["doc_id"])
    both = (hits.withColumn("added", F.lit(False))
            .unionByName(added.withColumn("added", F.lit(True)), allowMissingColumns=True))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "added"))
    return both.withColumn("position", place)


def resolve_paths(refs: DataFrame, listing: DataFrame, path: str = "path",
                  prefixes: Sequence[str] = X.UPLOAD_PREFIXES) -> DataFrame:
    """First existing place of each referenced path, NULL when none exists.

    Each distinct path is resolved once, so that one path named by many rows
    costs one lookup and one row in the shuffles before the join back.
    """
    distinct = refs.select(path).where(F.col(path).isNotNull()).distinct()
    places = distinct.select(path, F.explode(X.path_candidates(F.col(path), prefixes)).alias("c")).select(path, "c.*")
    files = listing.select(F.col("path").alias("candidate"))
    found = skewed_join(places, files, ["candidate"], "left_semi", cheap=True).groupBy(path).agg(F.min_by("candidate", "prio").alias("resolved_path"))
    return skewed_join(refs, found, [path], "left")


def file_path_for_doc(ids: DataFrame, collection: DataFrame, file_path: Column, small: bool = False) -> DataFrame:
    """File of each document: its own, else its first chunk's, else its base record's.

    ``small`` says that ``ids`` is of a proven small size; the collection is
    then cut down to the rows asked for before anything is shuffled.
    """
    named = (ids.withColumn("chunk_id", first_chunk_id(F.col("doc_id")))
             .withColumn("base_id", F.when(is_chunk(F.col("doc_id")),
                                           F.split_part("doc_id", F.lit(CHUNK_MARK), F.lit(1)))))
    files = collection.select("doc_id", file_path.alias("file_path")).where(F.coalesce("file_path", F.lit("")) != "")
    asked = named.select(F.explode(F.array("doc_id", "chunk_id", "base_id")).alias("doc_id")).distinct()
    files = files.join(F.broadcast(asked), "doc_id", "left_semi") if small else maybe_among(files, "doc_id", asked)
    own = files.withColumnRenamed("file_path", "own_path")
    chunk = files.select(F.col("doc_id").alias("chunk_id"), F.col("file_path").alias("chunk_path"))
    base = files.select(F.col("doc_id").alias("base_id"), F.col("file_path").alias("base_path"))
    # Most documents have no base record; rows without one go round the last join.
    known = named.join(own, "doc_id", "left").join(chunk, "chunk_id", "left")
    return (skewed_join(known, base, ["base_id"], "left")
            .withColumn("file_path", F.coalesce("own_path", "chunk_path", "base_path"))
            .drop("chunk_id", "base_id", "own_path", "chunk_path", "base_path"))
