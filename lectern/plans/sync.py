"""Keeping a collection current: full builds, incremental syncs, rescans, files.

Loops run over configured tables only, never over rows. A table that fails
leaves an error row in the ledger and keeps its watermark. Where a sync is given
files, the chunks of the files that a row refers to are written with the row's
document and go with it; without files, stored chunks stay as long as their row does.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

from lectern.config import TableConfig
from lectern.functions.text import UPLOAD_PREFIXES
from lectern.functions.vectors import embed_hashed
from lectern.operators import chunks as C
from lectern.operators.documents import build_documents, drop_sensitive
from lectern.operators.joins import CHUNK_MARK, is_chunk, stale_documents
from lectern.operators.merge import top_per_group
from lectern.operators.predicates import scope
from lectern.operators.skew import skewed_join
from lectern.session import materialise, scratch
from lectern.sources.collection import COLUMNS, COMPACT_AFTER, Collection, Snapshot
from lectern.sources.files import Extractors, file_documents, file_refs, place_refs
from lectern.sources.ledger import Ledger
from lectern.sources.tables import Source, scan_changed, widen

# Tables whose jobs run side by side in a full build.
TABLES_AT_ONCE = 3
NEVER = 1 << 62

Embed = Callable[[Column], Column]
Rows = Callable[[DataFrame, TableConfig], DataFrame]


def all_rows(df: DataFrame, cfg: TableConfig) -> DataFrame:
    return df


def embed_documents(docs: DataFrame, embed: Embed = embed_hashed) -> DataFrame:
    return docs.withColumn("embedding", embed(F.col("text")))


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


@dataclass(frozen=True)
class Files:
    """Where the files of file columns are and how they become chunks."""
    listing: Callable[[], DataFrame]
    extractors: Extractors | None = None
    recursive: bool = True
    prefixes: Sequence[str] = UPLOAD_PREFIXES


def record_id(docs: DataFrame) -> Column:
    """The record that a document belongs to: a chunk's parent, else the document itself."""
    parent = F.concat_ws(".", "source_db", "source_table", "pk_value")
    return F.when(is_chunk(F.col("doc_id")), parent).otherwise(F.col("doc_id"))


class Sync:
    """The sync runs of one collection."""

    def __init__(self, source: Source, configs: Sequence[TableConfig], collection: Collection,
                 embed: Embed = embed_hashed, files: Files | None = None):
        self.source = source
        self.configs = list(configs)
        self.collection = collection
        self.spark = collection.spark
        self.ledger = Ledger(self.spark, collection.root)
        self.embed = embed
        self.files = files

    def _record(self, mode: str, results: list[tuple[str, datetime | None, int, str | None, float]]) -> None:
        run = uuid.uuid4().hex
        self.ledger.append([
            (run, _now(), key, mode, mark, records, "error" if error else "success", error, took)
            for key, mark, records, error, took in results])

    def _rows(self, cfg: TableConfig, rows: Rows, since=None) -> DataFrame:
        table = rows(drop_sensitive(self.source.read(self.spark, cfg.table)), cfg)
        return table if since is None else scan_changed(table, cfg.date_column, since, ordered=False)

    def _documents(self, cfg: TableConfig, table: DataFrame) -> DataFrame:
        """A document for every row; keys may repeat."""
        docs = build_documents(widen(table, *([cfg.pk_column] if cfg.pk_column else [])), cfg)
        return embed_documents(docs, self.embed).select(*COLUMNS)

    def _chunks(self, cfg: TableConfig, table: DataFrame) -> DataFrame | None:
        """Chunks of the files that the rows refer to."""
        if self.files is None or not cfg.file_columns:
            return None
        f = self.files
        return table_file_chunks(table, f.listing(), cfg, extractors=f.extractors, recursive=f.recursive, embed=self.embed,
                                 prefixes=f.prefixes).select(*COLUMNS)

    def _kept_chunks(self, cfg: TableConfig, docs: DataFrame, before: DataFrame) -> DataFrame:
        """Stored chunks of a table whose records are still there."""
        chunks = before.where(scope(cfg.db, cfg.table)).where(is_chunk(F.col("doc_id")))
        return (chunks.withColumn("_record", record_id(chunks))
                .join(docs.select(F.col("doc_id").alias("_record")), "_record", "left_semi").select(*COLUMNS))

    def _all_chunks(self, cfg: TableConfig, table: DataFrame, docs: DataFrame, before: DataFrame) -> DataFrame:
        """The chunks that a table's documents have now: those of their files, or the stored ones where no files are given."""
        chunks = self._chunks(cfg, table)
        return self._kept_chunks(cfg, docs, before) if chunks is None else chunks

    def _index_table(self, part: int, rows: Rows, snapshot: Snapshot, before: DataFrame) -> tuple[str | None, float]:
        """Write one table to a snapshot. Its rows are read and rendered once, unless keys repeat."""
        cfg, start, error = self.configs[part], time.perf_counter(), None
        n = len(self.configs)
        try:
            with scratch(self.spark):
                table = self._rows(cfg, rows)
                docs = snapshot.add_last(self._documents(cfg, table), part, n + part, (cfg.db, cfg.table))
                if (self.files and cfg.file_columns) or (cfg.db, cfg.table) in snapshot.known:
                    snapshot.add(self._all_chunks(cfg, table, docs, before), 2 * n + part, (cfg.db, cfg.table))
        except Exception as exc:  # one failing table must not stop the others
            error = str(exc).split("\n")[0]
        return error, round((time.perf_counter() - start) * 1000, 2)

    def build(self, rows: Rows = all_rows, mode: str = "full") -> DataFrame:
        """Index all configured tables into a new snapshot. Rows gone from a table are gone from the snapshot;
        the documents of a table that cannot be read, and those of tables not configured, stay where they are."""
        upto = self.collection.last_batch()
        before, snapshot = self.collection.read(upto), self.collection.new_snapshot(upto)
        with ThreadPoolExecutor(TABLES_AT_ONCE) as tables:
            runs = list(tables.map(lambda part: self._index_table(part, rows, snapshot, before), range(len(self.configs))))
        done = [(cfg.db, cfg.table) for cfg, (error, _) in zip(self.configs, runs) if not error]
        snapshot.finish(done)
        written = self.collection.read()
        found = written.groupBy(F.concat_ws(".", "source_db", "source_table").alias("k")).agg(
            F.count_if(~is_chunk(F.col("doc_id"))).alias("n"), F.max("version").alias("mark"))
        stats = {r["k"]: (r["n"], r["mark"]) for r in found.collect()}
        results = []
        for cfg, (error, took) in zip(self.configs, runs):
            n, mark = (0, None) if error else stats.get(cfg.key, (0, None))
            results.append((cfg.key, mark, n, error, took))
        self._record(mode, results)
        return written

    def _changes(self, cfg: TableConfig, table: DataFrame) -> DataFrame:
        """Documents and chunks of changed rows, and removal marks for chunks these rows no longer have."""
        docs = self._documents(cfg, table)
        chunks = self._chunks(cfg, table)
        if chunks is None:
            return docs.withColumn("deleted", F.lit(False))
        new = materialise(docs.unionByName(chunks), "changes")
        stored = self.collection.read().where(scope(cfg.db, cfg.table)).where(is_chunk(F.col("doc_id")))
        changed = new.where(~is_chunk(F.col("doc_id"))).select(F.col("doc_id").alias("_record"))
        old = stored.withColumn("_record", record_id(stored)).join(changed, "_record", "left_semi").select(*COLUMNS)
        gone = stale_documents(old, new)
        return new.withColumn("deleted", F.lit(False)).unionByName(gone.withColumn("deleted", F.lit(True)))

    def _append(self, cfg: TableConfig, batch: DataFrame) -> tuple[int, datetime | None]:
        """Records of a table written and the highest date among them."""
        number = self.collection.append_changes(batch, compact_after=NEVER, table=(cfg.db, cfg.table))
        written = self.collection.changes(number - 1, number)
        if written is None:
            return 0, None
        live = written.where(~F.col("deleted") & ~is_chunk(F.col("doc_id")))
        records, mark = live.agg(F.count_distinct("doc_id"), F.max("version")).first()
        return records, mark

    def incremental(self, rows: Rows = all_rows) -> DataFrame:
        """Changed rows of every table with a date column, from its watermark on (inclusive)."""
        marks = self.ledger.watermarks()
        results = []
        for cfg in (c for c in self.configs if c.date_column):
            start = time.perf_counter()
            mark, records, error = None, 0, None
            try:
                with scratch(self.spark):
                    records, mark = self._append(cfg, self._changes(cfg, self._rows(cfg, rows, marks.get(cfg.key))))
            except Exception as exc:  # one failing table must not stop the others
                error = str(exc).split("\n")[0]
            results.append((cfg.key, mark, records, error, round((time.perf_counter() - start) * 1000, 2)))
        self._record("incremental", results)
        if len(self.collection.batches()) > COMPACT_AFTER:
            self.collection.compact()
            self.collection.vacuum()
        return self.collection.read()

    def rescan(self, rows: Rows = all_rows) -> DataFrame:
        """Full rescan: documents whose source row is gone disappear."""
        return self.build(rows, mode="rescan")

    def reindex(self, cfg: TableConfig, rows: Rows = all_rows) -> DataFrame:
        """All rows of one table, with their chunks, as one batch of changes; removal marks for documents gone from it."""
        start = time.perf_counter()
        before = self.collection.read()
        with scratch(self.spark):
            table = self._rows(cfg, rows)
            docs = materialise(self._documents(cfg, table), "documents")
            now = docs.unionByName(materialise(self._all_chunks(cfg, table, docs, before), "chunks"))
            gone = stale_documents(before.where(scope(cfg.db, cfg.table)), now).withColumn("deleted", F.lit(True))
            batch = now.withColumn("deleted", F.lit(False)).unionByName(gone.select(*COLUMNS, "deleted"))
            records, mark = self._append(cfg, batch)
        self._record("reindex", [(cfg.key, mark, records, None, round((time.perf_counter() - start) * 1000, 2))])
        return self.collection.read()


def file_chunk_documents(refs: DataFrame, files: DataFrame, cfg: TableConfig, extractors: Extractors | None = None,
                         recursive: bool = True, embed: Embed = embed_hashed,
                         prefixes: Sequence[str] = UPLOAD_PREFIXES) -> DataFrame:
    """Chunks of the files a table refers to, as documents ``{parent}.chunk_{i}``.

    A file is extracted, cut and embedded once, whatever the number of rows
    that name it; a file of records (CSV) gives one text per record. References of a second file column carry its name in their
    key; rows that share a key share one reference, so every id occurs once.
    """
    single = top_per_group(refs, ["parent_id", "path_no"], ["path", "file_type"])
    placed = place_refs(single, files, prefixes)
    pieces = C.chunks_through(file_documents(placed, files, extractors), ["resolved_path", "extension"], recursive)
    cut = skewed_join(placed, embed_documents(pieces, embed), ["resolved_path", "extension"])
    parent = F.when(F.col("path_no") == 0, F.col("parent_id")).otherwise(F.concat_ws(".", "parent_id", "path_col"))
    meta = F.create_map(
        F.lit("source_db"), F.lit(cfg.db), F.lit("source_table"), F.lit(cfg.table), F.lit("doc_label"), F.lit(cfg.label),
        F.lit("pk_value"), F.col("row_id"), F.lit("file_path"), F.col("path"), F.lit("file_type"), F.col("file_type"),
        F.lit("chunk_index"), F.col("chunk_index").cast("string"),
        F.lit("total_chunks"), F.col("total_chunks").cast("string"))
    return cut.select(
        F.concat(parent, F.lit(CHUNK_MARK), "chunk_index").alias("doc_id"), "parent_id", "chunk_index", "total_chunks",
        F.lit(cfg.db).alias("source_db"), F.lit(cfg.table).alias("source_table"), F.lit(cfg.label).alias("doc_label"),
        F.col("row_id").alias("pk_value"), "text", meta.alias("metadata"),
        F.lit(None).cast("timestamp_ntz").alias("version"), "embedding")


def table_file_chunks(df: DataFrame, files: DataFrame, cfg: TableConfig, **options) -> DataFrame:
    """File pipeline of one table: references, paths, text, chunks, embeddings."""
    return file_chunk_documents(file_refs(df, cfg), files, cfg, **options)
