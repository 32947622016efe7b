"""In how many documents of a collection each term occurs, kept up to date batch by batch.

``terms`` below the collection's folder holds rows (table, origin, term, n). An origin is a snapshot's folder, with the
counts of its documents, or a batch of changes, with what the batch adds: one for each term of a
document's new text, minus one for each term of the text it replaces or removes. So a batch reads the texts of the
documents it touches and no others, a snapshot its own once, and a question about frequencies no text at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, functions as F

from lectern.functions import text as X
from lectern.operators.merge import SMALL_KEYS
from lectern.operators.prefilter import maybe_among
from lectern.operators.skew import fits_broadcast
from lectern.sources.collection import Collection, _any, _of

SCHEMA = "term string, n bigint, source_db string, source_table string, origin string"


def _counts(docs: DataFrame, sign: Column) -> DataFrame:
    """Documents by table and term, each with its sign; texts hold every term once here."""
    words = docs.select("source_db", "source_table", F.explode(X.terms(F.col("text"))).alias("term"), sign.cast("bigint").alias("n"))
    added = words.groupBy("source_db", "source_table", "term").agg(F.sum("n").alias("n"))
    return added.where("n != 0")


class TermIndex:
    """Document frequencies of a collection's terms."""

    def __init__(self, collection: Collection, small_keys: int = SMALL_KEYS):
        self.collection = collection
        self.spark = collection.spark
        self.small_keys = small_keys

    @staticmethod
    def _origin(batch: Row) -> str:
        return f"batch-{batch['writer']}-{batch['epoch']}"

    def _rows(self) -> DataFrame | None:
        return self.collection._table("terms", SCHEMA)

    def _write(self, counts: DataFrame, origin: str, tables: list) -> None:
        """The counts of one origin; a row without term says that a table was counted, also where it has no terms."""
        marks = self.spark.createDataFrame([(None, 0, *t) for t in tables], "term string, n bigint, source_db string, source_table string")
        rows = counts.select("term", "n", "source_db", "source_table").unionByName(marks).withColumn("origin", F.lit(origin))
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("source_db", "source_table", "origin").parquet(f"{self.collection.root}/terms"))

    def _touched(self, batch: DataFrame, before: DataFrame) -> DataFrame:
        """Documents that a batch replaces or removes."""
        keys = batch.select("doc_id").distinct()
        docs = before.select("doc_id", "source_db", "source_table", "text")
        if fits_broadcast(keys, self.small_keys):
            return docs.join(F.broadcast(keys), "doc_id", "left_semi")
        return maybe_among(docs, "doc_id", keys).join(keys, "doc_id", "left_semi")

    def refresh(self) -> None:
        """Count what is new: snapshots as a whole, batches by what they change, in their order."""
        store = self.collection
        rows = self._rows()
        done = set() if rows is None else {
            tuple(r) for r in rows.where("term IS NULL").select("source_db", "source_table", "origin").distinct().collect()}
        heads = store._newest(store._heads())
        new: dict[str, list] = {}
        for h in heads:
            table = (h["source_db"], h["source_table"])
            if h["folder"] and (*table, h["folder"]) not in done:
                new.setdefault(h["folder"], []).append(table)
        for folder, tables in new.items():
            docs = store._snapshot([h for h in heads if (h["source_db"], h["source_table"]) in tables])
            self._write(_counts(docs, F.lit(1)), folder, tables)
        for b in sorted(store._live(), key=lambda b: (b["batch"], b["writer"])):
            table = (b["source_db"], b["source_table"])
            if (*table, self._origin(b)) in done:
                continue
            batch = store._changes([b], -1, None)
            last = F.max_by(F.struct("text", "deleted"), F.struct("version", "text"))
            now = batch.groupBy("source_db", "source_table", "doc_id").agg(last.alias("_row")).select(
                "source_db", "source_table", "doc_id", "_row.*")
            before = store.read(b["batch"] - 1).where(_of(table))
            change = (now.where("NOT deleted").select("source_db", "source_table", "text", F.lit(1).alias("sign"))
                      .unionByName(self._touched(batch, before).select("source_db", "source_table", "text", F.lit(-1).alias("sign"))))
            self._write(_counts(change, F.col("sign")), self._origin(b), [table])

    def frequencies(self) -> DataFrame:
        """``term, df`` of the collection as of the last refresh."""
        rows = self._rows()
        store = self.collection
        origins: dict[str, list] = {}
        for h in store._newest(store._heads()):
            if h["folder"]:
                origins.setdefault(h["folder"], []).append((h["source_db"], h["source_table"]))
        for b in store._live():
            origins.setdefault(self._origin(b), []).append((b["source_db"], b["source_table"]))
        if rows is None or not origins:
            return self.spark.createDataFrame([], "term string, df bigint")
        own = _any((F.col("origin") == o) & _any(map(_of, tables)) for o, tables in origins.items())
        counted = rows.where(own).where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df"))
        return counted.where("df > 0")
