"""Incremental sync as a stream of changed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.config import TableConfig
from lectern.functions.vectors import embed_hashed
from lectern.operators.documents import build_documents, drop_sensitive
from lectern.plans.sync import Embed
from lectern.sources.collection import Collection

PLACE = "_place"


def last_events(rows: DataFrame, cfg: TableConfig, order: Sequence[Column | str]) -> DataFrame:
    """The last document of each key so far, by an order that the rows carry and not by when they arrive.

    Of equal places the newer version wins, then the greater text, so that the result is the same however
    rows are dealt out to files and batches. The last row of each key is the state of the stream: a streaming
    aggregate, merged per task before the shuffle, kept with the checkpoint. It gives a key's last row
    whenever rows of the key arrive, late ones too.
    """
    placed = drop_sensitive(rows).withColumn(PLACE, F.struct(*order))
    docs = build_documents(placed, cfg, keep=(PLACE,))
    row = F.struct(*(c for c in docs.columns if c not in ("doc_id", PLACE)))
    last = docs.groupBy("doc_id").agg(F.max_by(row, F.struct(PLACE, "version", "text")).alias("_row"))
    return last.select("doc_id", "_row.*")


def stream_changes(rows: DataFrame, cfg: TableConfig, collection: Collection, checkpoint: str, *,
                   every: str | None = None, embed: Embed = embed_hashed,
                   event_order: Sequence[Column | str] = ()) -> StreamingQuery:
    """Upsert a stream of rows into a collection.

    Each micro-batch becomes one batch of changes, after all that are committed
    by then, so that rows win in the order of their arrival. With ``event_order``, columns of the
    rows such as a date, a file name and a position in it, the last row by that order wins, in whatever order files
    come; the state then holds one document per key, for which a large stream needs a state store on disk.
    A micro-batch that is run again after a failure overwrites itself, known by its
    checkpoint and number. ``every`` is a processing-time interval; without it the stream ends
    when all available rows are read.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        docs = batch if event_order else build_documents(drop_sensitive(batch), cfg)
        collection.append_changes(docs, embed, writer=checkpoint, epoch=batch_id, table=(cfg.db, cfg.table))

    changes = last_events(rows, cfg, event_order) if event_order else rows
    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.outputMode("update" if event_order else "append")
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def stream_parquet(spark, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
