"""Counts, status rollups and audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lectern.operators.joins import is_chunk
from lectern.operators.merge import top_per_group


def docs_per_table(documents: DataFrame) -> DataFrame:
    """Documents per table, per database and in all (NULL stands for "all")."""
    return documents.rollup("source_db", "source_table").agg(F.count("*").alias("docs"))


def group_listing(df: DataFrame, group: Sequence[str], item: str) -> DataFrame:
    """Sorted list of the distinct items per group, with counts.

    Rows are counted per (group, item) first; the list holds names of tables
    or sources, whose number is that of a catalog and not that of the rows.
    """
    counted = df.groupBy(*group, item).agg(F.count("*").alias("n"))
    return counted.groupBy(*group).agg(
        F.array_join(F.array_sort(F.collect_list(F.col(item))), ",").alias("items"),
        F.count("*").alias("n_items"), F.sum("n").alias("n_rows"))


def flag_counts(df: DataFrame, group: Sequence[str], flag: Column) -> DataFrame:
    return df.groupBy(*group).agg(F.count_if(flag).alias("selected"), F.count("*").alias("total"))


def file_batch_rollup(results: DataFrame) -> DataFrame:
    """Totals over file results (``extracted``, ``text_length``, ``error``)."""
    failed = ~F.col("extracted") & F.col("error").isNotNull()
    return results.agg(
        F.count("*").alias("total_files"),
        F.count_if(F.col("extracted")).alias("extracted"),
        F.count_if(failed).alias("failed"),
        F.count_if(~F.col("extracted") & F.col("error").isNull()).alias("skipped"),
        F.coalesce(F.sum("text_length"), F.lit(0)).cast("bigint").alias("text_length"),
    )


def latest_state(log: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Last run per table of an append-only run log."""
    last = log.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_row"))
    return last.select(key, "_row.*")


def status_rollup(modes: DataFrame, state: DataFrame) -> DataFrame:
    """Per mode: last run, records of the tables whose last run succeeded, ``never_run`` without runs."""
    ran = state.groupBy("mode").agg(
        F.max("run_ts").alias("last_run"), F.count("*").alias("n"),
        F.sum(F.when(F.col("status") == "success", F.col("records"))).alias("done"))
    return modes.join(ran, "mode", "left").select(
        "mode", "last_run", F.when(F.col("n").isNull(), "never_run").otherwise("success").alias("status"),
        F.coalesce("done", F.lit(0)).cast("bigint").alias("records"))


def collection_audit(documents: DataFrame, samples: int = 10) -> DataFrame:
    """Per database: documents, chunks, distinct tables and the first ids."""
    ids = documents.select(
        F.split_part("doc_id", F.lit("."), F.lit(1)).alias("db"),
        F.split_part("doc_id", F.lit("."), F.lit(2)).alias("tab"), "doc_id")
    per_table = ids.groupBy("db", "tab").agg(F.count("*").alias("n"),
                                             F.count_if(is_chunk(F.col("doc_id"))).alias("c"))
    counts = per_table.groupBy("db").agg(F.sum("n").alias("docs"), F.sum("c").alias("chunk_docs"),
                                         F.count("*").alias("tables"))
    first = top_per_group(ids.select("db", "doc_id"), ["db"], ["doc_id"], samples)
    listed = first.groupBy("db").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("sample_ids"))
    return counts.join(listed, "db")


def table_row_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table, with a mark on empty ones."""
    counts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
              for name, df in frames.items()]
    return reduce(DataFrame.unionByName, counts).withColumn("is_empty", F.col("n_rows") == 0)


def hit_rate(hits: DataFrame, expected: DataFrame, label: str = "label", threshold: float = 0.7) -> DataFrame:
    """Share of queries with an expected label among their hits, and whether it reaches the threshold."""
    wanted = expected.select("query_id", F.col("label").alias("wanted"))
    found = hits.join(wanted, "query_id").groupBy("query_id").agg(F.bool_or(F.col(label) == F.col("wanted")).alias("hit"))
    scored = wanted.select("query_id").distinct().join(found, "query_id", "left")
    rate = F.avg(F.coalesce("hit", F.lit(False)).cast("int"))
    return scored.agg(F.count("*").alias("queries"), F.round(rate, 6).alias("hit_rate"),
                      (rate >= threshold).alias("passed"))
