"""A document collection on disk: snapshots of tables and changes on top of them, all plain Parquet.

``documents``: snapshots, one folder each, by table. ``heads``: one row per table and finished snapshot; the
last one names the folder that holds the table. A snapshot without heads, whether still being written or left by a
crash, is nobody's. A snapshot replaces the tables it was finished for and no others.

``changes``: batches partitioned by table, writer and epoch, written by dynamic partition overwrite. A batch
that a stream writes again after a failure lands in its old place, with its old number, however much came between.
A reader takes the last row of each key by batch number, then by version, then by text, so that
a batch may hold a key several times.

A head also carries marks: the last epoch of each writer that its snapshot contains. Batches up to their
writer's mark are part of the snapshot; all others lie on top of it, whoever wrote them and when they were
committed, also while the snapshot was being written. Numbers rise with each batch of a process; equal
numbers of two processes go by writer.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable
from functools import reduce
from hashlib import md5

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from lectern.operators.merge import changed_parts, one_per_key
from lectern.session import remove

DOCUMENT_SCHEMA = ("doc_id string, doc_label string, pk_value string, text string, metadata map<string,string>, "
                   "version timestamp_ntz, embedding array<float>, source_db string, source_table string")
COLUMNS = [part.split()[0] for part in DOCUMENT_SCHEMA.replace("map<string,string>", "map").split(", ")]
CHANGE_SCHEMA = f"{DOCUMENT_SCHEMA}, deleted boolean, batch bigint, writer string, epoch bigint"
HEAD_SCHEMA = "source_db string, source_table string, generation bigint, folder string, upto bigint, marks map<string,bigint>"
NO_BATCH = -1
#: Batches on top of the snapshots after which ``append_changes`` folds them into new ones.
COMPACT_AFTER = 200
#: Generations whose files stay for readers that have begun.
KEPT_GENERATIONS = 2
#: Writers that write one batch and no more; their marks go when their batch is gone.
ONCE = "once-"

Table = tuple[str | None, str | None]


def _of(table: Table) -> Column:
    return F.col("source_db").eqNullSafe(F.lit(table[0])) & F.col("source_table").eqNullSafe(F.lit(table[1]))


def _in_table(rows: DataFrame, table: Table | None) -> DataFrame:
    """Rows that are known to belong to one table, with its names as constants: a task that writes them by table then
    need not sort them, with their texts and vectors, first."""
    if table is None:
        return rows
    return rows.withColumns({c: F.lit(name).cast("string") for c, name in zip(("source_db", "source_table"), table)})


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))


class Snapshot:
    """A snapshot being written part by part; readers see it once it is finished.

    Every part has a folder of its own, so that parts may be written side by side.
    """

    def __init__(self, collection: Collection, upto: int | None = None):
        self.collection = collection
        heads, batches = collection._heads(), collection._batches()
        self.generation = max((h["generation"] for h in heads), default=-1) + 1
        self.upto = collection._last(heads, batches) if upto is None else upto
        self.folder = f"{self.generation}-{uuid.uuid4().hex}"
        self.known: dict[Table, dict[str, int]] = {}
        present = {b["writer"] for b in batches}
        for h in Collection._newest(heads):
            own = h["marks"] or {}
            self.known[h["source_db"], h["source_table"]] = {w: e for w, e in own.items() if w in present or not w.startswith(ONCE)}
        for b in batches:
            if b["batch"] <= self.upto:
                marks = self.known.setdefault((b["source_db"], b["source_table"]), {})
                marks[b["writer"]] = max(marks.get(b["writer"], -1), b["epoch"])

    @property
    def path(self) -> str:
        return f"{self.collection.root}/documents/folder={self.folder}"

    def add(self, documents: DataFrame, part: int = 0, table: Table | None = None) -> None:
        """Documents with one row per key; all of one table, if it is given."""
        _in_table(documents, table).select(*COLUMNS).write.mode("overwrite").partitionBy("source_db", "source_table").parquet(f"{self.path}/part={part}")

    def _written(self, part: int) -> DataFrame:
        return self.collection.spark.read.schema(DOCUMENT_SCHEMA).parquet(f"{self.path}/part={part}")

    def add_last(self, documents: DataFrame, part: int, spare: int, table: Table | None = None) -> DataFrame:
        """The last row of each key, by version, then by text; returns what was written.

        The rows are computed and written once. Only where keys repeat among the written ones, they are read again and
        written to the ``spare`` part in place of ``part``.
        """
        self.add(documents, part, table)
        written = self._written(part)
        if written.groupBy("doc_id").count().where("count > 1").isEmpty():
            return written
        self.add(one_per_key(written), spare, table)
        remove(self.collection.spark, f"{self.path}/part={part}")
        return self._written(spare)

    def finish(self, tables: Iterable[Table] | None = None) -> str:
        """From now on the snapshot is the state of these tables, by default of all there are."""
        spark = self.collection.spark
        try:
            rows = spark.read.schema(f"{DOCUMENT_SCHEMA}, part int").parquet(self.path).select("source_db", "source_table").distinct().collect()
        except AnalysisException:  # no part was added
            rows = []
        filled = {(r["source_db"], r["source_table"]) for r in rows}
        heads = [(*t, self.generation, self.folder if t in filled else None, self.upto, self.known.get(t, {}))
                 for t in ({*filled, *self.known} if tables is None else {*tables})]
        spark.createDataFrame(heads, HEAD_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.collection.root}/heads")
        return self.path


class Collection:
    _lock = threading.Lock()
    _given: dict[str, int] = {}

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # ---- what there is

    def _table(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException:  # nothing written yet
            return None

    def _heads(self) -> list[Row]:
        """Finished snapshots by table: as many rows as builds and compactions have tables."""
        heads = self._table("heads", HEAD_SCHEMA)
        return [] if heads is None else heads.collect()

    def _batches(self) -> list[Row]:
        """Stored batches by table; compaction bounds their number."""
        changes = self._table("changes", CHANGE_SCHEMA)
        return [] if changes is None else changes.groupBy("source_db", "source_table", "writer", "epoch").agg(
            F.max("batch").alias("batch")).collect()

    @staticmethod
    def _newest(heads: list[Row], generations: int = 1) -> list[Row]:
        """The heads of each table's last snapshots."""
        out = []
        for table in {(h["source_db"], h["source_table"]) for h in heads}:
            own = [h for h in heads if (h["source_db"], h["source_table"]) == table]
            if generations == 1:
                out.append(max(own, key=lambda h: (h["generation"], h["folder"] or "")))
            else:
                last = sorted({h["generation"] for h in own})[-generations:]
                out += [h for h in own if h["generation"] in last]
        return out

    @staticmethod
    def _covered(batch: Row, heads: list[Row]) -> bool:
        """Do all these heads' snapshots contain the batch? Not without a head of its table."""
        own = [h for h in heads if (h["source_db"], h["source_table"]) == (batch["source_db"], batch["source_table"])]
        return bool(own) and all((h["marks"] or {}).get(batch["writer"], -1) >= batch["epoch"] for h in own)

    @staticmethod
    def _last(heads: list[Row], batches: list[Row]) -> int:
        return max([h["upto"] for h in heads] + [b["batch"] for b in batches], default=NO_BATCH)

    def _live(self) -> list[Row]:
        newest = self._newest(self._heads())
        return [b for b in self._batches() if not self._covered(b, newest)]

    def batches(self) -> list[int]:
        """Numbers of the batches on top of the snapshots."""
        return sorted({b["batch"] for b in self._live()})

    def last_batch(self) -> int:
        return self._last(self._heads(), self._batches())

    # ---- writing

    def new_snapshot(self, upto: int | None = None) -> Snapshot:
        """An unfinished snapshot that contains every batch up to a number, by default the last one."""
        return Snapshot(self, upto)

    def write_snapshot(self, documents: DataFrame, upto: int | None = None) -> str:
        """All documents at once as a new snapshot."""
        snapshot = self.new_snapshot(upto)
        snapshot.add(documents)
        return snapshot.finish()

    def _number(self, writer: str, epoch: int) -> int:
        """The number that a batch has, or the next one."""
        heads, batches = self._heads(), self._batches()
        for b in batches:
            if (b["writer"], b["epoch"]) == (writer, epoch):
                return b["batch"]
        with self._lock:
            number = max(self._last(heads, batches), self._given.get(self.root, NO_BATCH)) + 1
            self._given[self.root] = number
        return number

    def append_changes(self, documents: DataFrame, embed: Callable[[Column], Column] | None = None, unique: bool = False,
                       writer: str = "", epoch: int = -1, compact_after: int = COMPACT_AFTER,
                       table: Table | None = None) -> int:
        """One batch of changed documents; ``deleted`` marks removed ones. Returns its number.

        Rows are computed and written once, embedded when ``embed`` is given. Of a key's rows in the batch readers take the
        last; ``unique`` says that there is only one, ``table`` that all rows are of this table. A batch whose ``writer`` and ``epoch``
        were written before overwrites itself, and one that a snapshot contains changes nothing.
        """
        rows = documents if "deleted" in documents.columns else documents.withColumn("deleted", F.lit(False))
        if embed:
            rows = rows.withColumn("embedding", embed(F.col("text")))
        name, place = (md5(writer.encode()).hexdigest(), epoch) if writer else (f"{ONCE}{uuid.uuid4().hex}", 0)
        number = self._number(name, place)
        placed = _in_table(rows, table).select(*COLUMNS, "deleted").withColumns(
            {"batch": F.lit(number).cast("bigint"), "writer": F.lit(name), "epoch": F.lit(place).cast("bigint")})
        (placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("source_db", "source_table", "writer", "epoch").parquet(f"{self.root}/changes"))
        if len(self.batches()) > compact_after:
            self.compact()
            self.vacuum()
        return number

    def compact(self) -> None:
        """Fold the changes into new snapshots of their tables. Batches committed meanwhile stay on top of them."""
        snapshot = self.new_snapshot()
        tables = {(b["source_db"], b["source_table"]) for b in self._live()}
        if tables:
            rows = self._parts()
            # Each part is written by itself: of a union of parts it is not known that all rows belong to one table.
            for part, (table, own) in enumerate((t, r) for t in sorted(tables, key=str) for r in rows):
                snapshot.add(own.where(_of(table)), part, table)
            snapshot.finish(tables)

    def vacuum(self) -> None:
        """Delete files of snapshots that later ones replaced, and batches that the snapshots contain.

        What the last ``KEPT_GENERATIONS`` of a table need stays, so that readers may end, and so that of
        two snapshots of one generation neither needs a batch that the other has made away with.
        """
        heads = self._heads()
        kept = self._newest(heads, KEPT_GENERATIONS)
        used = {h["folder"] for h in kept}
        for folder in {h["folder"] for h in heads if h["folder"]} - used:
            remove(self.spark, f"{self.root}/documents/folder={folder}")
        # A table with one generation may have another of the same number on its way.
        several = {t for t in {(h["source_db"], h["source_table"]) for h in kept}
                   if len({h["generation"] for h in kept if (h["source_db"], h["source_table"]) == t}) == KEPT_GENERATIONS}
        gone = [b for b in self._batches() if (b["source_db"], b["source_table"]) in several and self._covered(b, kept)]
        changes = self._table("changes", CHANGE_SCHEMA)
        if gone and changes is not None:
            names = {(b["writer"], b["epoch"]) for b in gone}
            tables = {(b["source_db"], b["source_table"]) for b in gone}
            for file in changes.where(_any(map(_of, tables))).inputFiles():
                folder = file.rpartition("/")[0]
                writer, epoch = (x.partition("=")[2] for x in folder.split("/")[-2:])
                if (writer, int(epoch)) in names:
                    remove(self.spark, folder)

    # ---- reading

    def _snapshot(self, heads: list[Row]) -> DataFrame:
        heads = [h for h in heads if h["folder"]]
        if not heads:
            return self.spark.createDataFrame([], DOCUMENT_SCHEMA)
        base = f"{self.root}/documents"
        rows = (self.spark.read.schema(f"{DOCUMENT_SCHEMA}, folder string, part int").option("basePath", base)
                .parquet(*sorted({f"{base}/folder={h['folder']}" for h in heads})))
        own = _any((F.col("folder") == h["folder"]) & _of((h["source_db"], h["source_table"])) for h in heads)
        return rows.where(own).select(*COLUMNS)

    def _changes(self, live: list[Row], after: int, upto: int | None) -> DataFrame | None:
        chosen = [b for b in live if b["batch"] > after and (upto is None or b["batch"] <= upto)]
        rows = self._table("changes", CHANGE_SCHEMA)
        if not chosen or rows is None:
            return None
        # Partition columns only, so that files of other batches are not opened.
        place = F.concat_ws("/", "writer", "epoch")
        by_table: dict[Table, list[str]] = {}
        for b in chosen:
            by_table.setdefault((b["source_db"], b["source_table"]), []).append(f"{b['writer']}/{b['epoch']}")
        own = _any(_of(table) & place.isin(names) for table, names in by_table.items())
        return rows.where(own).select(*COLUMNS, "batch", "deleted", "writer")

    def changes(self, after: int = NO_BATCH, upto: int | None = None) -> DataFrame | None:
        """Rows of the batches on top of the snapshots, with their numbers as ``batch``."""
        rows = self._changes(self._live(), after, upto)
        return None if rows is None else rows.drop("writer")

    def _parts(self, upto: int | None = None) -> list[DataFrame]:
        newest = self._newest(self._heads())
        live = [b for b in self._batches() if not self._covered(b, newest)]
        log = self._changes(live, NO_BATCH, upto)
        current = self._snapshot(newest)
        return [current] if log is None else [p.select(*COLUMNS) for p in changed_parts(current, log, then=("writer", "text"))]

    def read(self, upto: int | None = None) -> DataFrame:
        """Current documents: each table's last snapshot with all later changes applied."""
        return reduce(DataFrame.unionByName, self._parts(upto))
