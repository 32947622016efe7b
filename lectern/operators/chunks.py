"""Long texts to overlapping chunks."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions import text as X
from lectern.operators.joins import CHUNK_MARK
from lectern.session import materialise

CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
#: Texts of a file that are counted through in one task.
PARTS_BLOCK = 4096


def _pieces(text: str, separator: str) -> list[str]:
    """Parts of a text, each but the first led by the separator."""
    if separator == "":
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in (head, *(separator + r for r in rest)) if p]


def _pack(pieces: Sequence[str], size: int, overlap: int) -> list[str]:
    """Fill windows up to ``size`` characters, each starting with up to ``overlap`` of the one before."""
    window: deque[str] = deque()
    used = 0
    out = []
    for piece in pieces:
        if window and used + len(piece) > size:
            out.append("".join(window).strip())
            while window and (used > overlap or used + len(piece) > size):
                used -= len(window.popleft())
        window.append(piece)
        used += len(piece)
    out.append("".join(window).strip())
    return [c for c in out if c]


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
               separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Split at the coarsest separator present; parts still too long go on with the finer ones."""
    level = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    finer = separators[level + 1:]
    out: list[str] = []
    short: list[str] = []
    for piece in _pieces(text, separators[level]):
        if len(piece) < size:
            short.append(piece)
            continue
        if short:
            out += _pack(short, size, overlap)
            short = []
        out += split_text(piece, size, overlap, finer) if finer else [piece]
    return out + _pack(short, size, overlap) if short else out


def chunk_recursive(c: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Recursive separator chunks. Splitting with look-back has no SQL form, hence an Arrow UDF."""
    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap) if t else [])

    return split.asNondeterministic()(c)  # keeps the optimizer from copying the call


def explode_chunks(df: DataFrame, chunks: Column, parent: str = "doc_id") -> DataFrame:
    """One row per chunk with its position, the number of chunks and its id.

    The total is the size of the row's own array: no shuffle.
    """
    cut = df.withColumn("_chunks", chunks).withColumn("total_chunks", F.size("_chunks"))
    # An inner posexplode makes the optimizer test the array's size first, in a copy of the whole expression.
    return (cut.select("*", F.posexplode_outer("_chunks").alias("chunk_index", "chunk_text")).drop("_chunks")
            .where(F.col("chunk_index").isNotNull())
            .withColumn("chunk_id", F.concat(F.col(parent).cast("string"), F.lit(CHUNK_MARK), F.col("chunk_index"))))


def chunks_through(texts: DataFrame, group: Sequence[str], recursive: bool = False, block: int = PARTS_BLOCK) -> DataFrame:
    """Chunks of texts that belong together, counted through: ``group``, ``chunk_index``, ``total_chunks``, ``text``.

    ``parts`` says how many texts the row's group has, ``part`` which one it is. Texts that are alone are counted in
    their row. The others' counts, without texts, are added up by blocks of ``block`` parts, then blocks by group: no task
    holds a group of very many texts.
    """
    fn = chunk_recursive(F.col("text")) if recursive else X.chunk_sliding(F.col("text"), CHUNK_SIZE, CHUNK_OVERLAP)
    cut = materialise(texts.select(*group, "parts", "part", fn.alias("_chunks")), "cut")
    one = cut.where("parts = 1").withColumn("_before", F.lit(0).cast("bigint")).withColumn("total_chunks", F.size("_chunks"))
    several = cut.where("parts > 1")
    sizes = several.select(*group, "part", F.size("_chunks").cast("bigint").alias("_n"), F.floor(F.col("part") / block).alias("_block"))
    by_block = sizes.groupBy(*group, "_block").agg(F.sum("_n").alias("_n"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = by_block.select(*group, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"),
                             F.sum("_n").over(whole).cast("int").alias("total_chunks"))
    inside = Window.partitionBy(*group, "_block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = (sizes.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(blocks, [*group, "_block"])
              .select(*group, "part", (F.col("_base") + F.col("_in")).alias("_before"), "total_chunks"))
    numbered = one.unionByName(several.join(places, [*group, "part"]))
    out = numbered.select(*group, "_before", "total_chunks", F.posexplode_outer("_chunks").alias("_at", "text")).where(F.col("_at").isNotNull())
    return out.select(*group, (F.col("_before") + F.col("_at")).cast("int").alias("chunk_index"), "total_chunks", "text")


def chunk_documents(docs: DataFrame, text: str = "text", parent: str = "doc_id", recursive: bool = False) -> DataFrame:
    cut = chunk_recursive(F.col(text)) if recursive else X.chunk_sliding(F.col(text), CHUNK_SIZE, CHUNK_OVERLAP)
    return explode_chunks(docs, cut, parent)
