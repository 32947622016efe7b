"""Exact inner-product top-k of a table of queries against a table of vectors.

A small query set goes to every task once; each task multiplies its vectors
batch by batch and keeps only the k best rows per query, so that the shuffle
carries k rows per query and task, whatever the size of the collection. A query
set beyond ``max_queries`` is taken block by block, with the same result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.operators.prefilter import maybe_among
from lectern.operators.skew import SMALL_ROWS, fits_broadcast, skewed_join
from lectern.session import materialise, scratch_path

MAX_QUERIES = 4096
#: Equal vectors may differ in the last bits of their sums; this is far above that and far below any real difference.
RANK_DECIMALS = 12
SHOWN_DECIMALS = 6
_BLOCK = 2048


class _Best:
    """The k best (score, id) per query seen so far; equal scores by rising id."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.scores: list[np.ndarray] = [np.empty(0)] * n_queries
        self.ids: list[np.ndarray] = [np.empty(0, dtype=object)] * n_queries
        self.floor = np.full(n_queries, -np.inf)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` is (queries, rows), rounded."""
        for q in np.flatnonzero(scores.max(axis=1) >= self.floor):
            row = scores[q]
            # The k-th best of this block is a lower bound too; ties with it stay in.
            cut = self.floor[q]
            if row.size > self.k:
                cut = max(cut, np.partition(row, row.size - self.k)[row.size - self.k])
            keep = np.flatnonzero(row >= cut)
            s = np.concatenate([self.scores[q], row[keep]])
            i = np.concatenate([self.ids[q], ids[keep]])
            order = np.lexsort((i, -s))[: self.k]
            self.scores[q], self.ids[q] = s[order], i[order]
            if len(order) == self.k:
                self.floor[q] = s[order[-1]]

    def rows(self, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = [len(s) for s in self.scores]
        return np.repeat(query_ids, sizes), np.concatenate(self.ids), np.concatenate(self.scores)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64, copy=False)


def _scan(query_ids: np.ndarray, query_matrix: np.ndarray, k: int, decimals: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(query_ids), k)
        for batch in batches:
            for start in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(start, _BLOCK)
                if part.column(1).null_count:
                    part = part.filter(part.column(1).is_valid())
                    if part.num_rows == 0:
                        continue
                matrix = _matrix(part.column(1))
                alive = matrix.any(axis=1)
                if not alive.any():
                    continue
                ids = part.column(0).to_numpy(zero_copy_only=False)[alive]
                scores = np.round(query_matrix @ matrix[alive].T, decimals)
                best.add(scores + 0.0, ids)
        q, i, s = best.rows(query_ids)
        if len(q):
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, type=schema.field(0).type), pa.array(i, type=schema.field(1).type),
                 pa.array(s, type=pa.float64())], schema=schema)

    return run


def _matrix_of(asked: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and vectors of a bounded set of queries; None when no query has a vector."""
    head = asked.select("query_id", "qvec").toArrow()
    head = head.filter(pc.is_valid(head.column(1)))
    if head.num_rows == 0:
        return None
    return head.column(0).to_numpy(zero_copy_only=False), _matrix(head.column(1).combine_chunks())


def _blocks(pool: DataFrame, asked: DataFrame, n_queries: int, k: int, decimals: int, out: T.StructType,
            max_queries: int) -> DataFrame:
    """Top-k rows per task of a large query set: the collection is scanned in place for one block of queries after the
    other, and never shuffled. The blocks, of half ``max_queries`` on average, are written apart, so each is read once."""
    spark = pool.sparkSession
    blocks = math.ceil(n_queries / max_queries) * 2
    where, found = scratch_path(spark, "asked"), scratch_path(spark, "candidates")
    (asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
     .repartition("_block").write.partitionBy("_block").parquet(where))
    numbered = spark.read.schema(T.StructType([*asked.schema.fields, T.StructField("_block", T.IntegerType())])).parquet(where)
    spark.createDataFrame([], out).write.parquet(found)
    for block in range(blocks):
        head = _matrix_of(numbered.where(F.col("_block") == block))
        if head is not None:
            pool.mapInArrow(_scan(*head, k, decimals, to_arrow_schema(out)), out).write.mode("append").parquet(found)
    return spark.read.schema(out).parquet(found)


def topk(vectors: DataFrame, queries: DataFrame, k: int, *, where: Column | None = None,
         doc_id: str = "doc_id", vector: str = "embedding", query_id: str = "query_id",
         query_vector: str = "embedding", decimals: int = RANK_DECIMALS, max_queries: int = MAX_QUERIES) -> DataFrame:
    """``(query_id, rank, doc_id, score)`` of the k best vectors per query.

    ``where`` applies before the search, so a selective condition still fills
    its k rows. Hits are ranked by their scores to twelve places, so that equal
    vectors tie whatever the order of their sums, and ties go by ``doc_id``; the
    score shown is rounded afterwards. The result is independent of partitioning. NULL and
    zero vectors, the mark of a failed embedding, are no hits.
    """
    pool = vectors if where is None else vectors.where(where)
    pool = pool.select(F.col(doc_id).alias("doc_id"), F.col(vector).alias("vec"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("qvec"))
    out = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType),
                        T.StructField("doc_id", pool.schema["doc_id"].dataType),
                        T.StructField("score", T.DoubleType())])
    few = len(asked.select("query_id").limit(max_queries + 1).collect())
    if few > max_queries:
        candidates = _blocks(pool, asked, asked.count(), k, decimals, out, max_queries)
    else:
        head = _matrix_of(asked)
        if head is None:
            return pool.sparkSession.createDataFrame([], out).select(
                "query_id", F.lit(0).alias("rank"), "doc_id", "score")
        candidates = pool.mapInArrow(_scan(*head, k, decimals, to_arrow_schema(out)), out)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = candidates.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "doc_id", F.round("score", SHOWN_DECIMALS).alias("score"))


def attach(hits: DataFrame, collection: DataFrame, columns: list[str], broadcast_rows: int = SMALL_ROWS) -> DataFrame:
    """Hits, cheap to read again, with columns of their documents.

    Few hits, in rows and bytes, go to the collection. Otherwise a filter of their ids goes there, so that
    only texts of documents that may be hits are shuffled; a document that very many questions hit is spread over tasks.
    """
    docs = collection.select("doc_id", *columns)
    if fits_broadcast(hits, broadcast_rows):
        return docs.join(F.broadcast(hits), "doc_id")
    named = maybe_among(docs, "doc_id", hits.select("doc_id").distinct())
    return skewed_join(hits, named, ["doc_id"]).select("doc_id", *columns, *(c for c in hits.columns if c != "doc_id"))


def topk_postfilter(vectors: DataFrame, queries: DataFrame, n: int, where: Column, **names) -> DataFrame:
    """Over-fetch ``min(total, max(10 n, 50))`` hits, filter them, keep n.

    A selective condition may leave fewer than n rows; :func:`topk` with
    ``where`` does not have that limit.
    """
    fetched = max(10 * n, 50)
    hits = topk(vectors, queries, fetched, **names)
    key = names.get("doc_id", "doc_id")
    passing = vectors.where(where).select(F.col(key).alias("doc_id"))
    kept = hits.join(passing, "doc_id", "left_semi")
    order = Window.partitionBy("query_id").orderBy("rank")
    return (kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
            .select("query_id", "rank", "doc_id", "score"))


def hits_per_query(hits: DataFrame, *columns: str) -> DataFrame:
    """One row per query with its ranked (document, score) list; at most k entries each."""
    entry = F.struct("rank", "doc_id", "score", *columns)
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("hits"))


def search(collection: DataFrame, questions: DataFrame, k: int, *, where: Column | None = None,
           columns: tuple[str, ...] = ("doc_label", "source_db", "source_table", "text"),
           broadcast_rows: int = SMALL_ROWS) -> DataFrame:
    """Top-k hits of questions (``query_id, question, embedding``) with their documents."""
    found = materialise(topk(collection, questions, k, where=where), "hits")
    named = questions.select("query_id", "question")
    side = F.broadcast(named) if fits_broadcast(named, broadcast_rows) else named
    return attach(found, collection, list(columns), broadcast_rows).join(side, "query_id")
