"""The collection's files: replays, writers side by side, clean-up, event order."""

from __future__ import annotations

import datetime as dt
import os
from itertools import permutations

import pytest
from pyspark.sql import DataFrameWriter, functions as F

from lectern.config import TableConfig
from lectern.operators.documents import build_documents
from lectern.operators.merge import apply_changes
from lectern.plans.sync import Sync, embed_documents
from lectern.sources.collection import Collection
from lectern.streaming.sync import stream_changes, stream_parquet

CFG = TableConfig("db", "notes", ("body",), ("n",), "id", "Note", date_column="changed")
SCHEMA = "id int, body string, n double, changed timestamp_ntz"


def day(n):
    return dt.datetime(2024, 1, n)


def docs(spark, *rows, cfg=CFG):
    full = [(i, body, 1.0, day(n)) for i, body, n in rows]
    return embed_documents(build_documents(spark.createDataFrame(full, SCHEMA), cfg))


def content(store):
    return {r["doc_id"].rpartition(".")[2]: r["text"].rpartition(": ")[2] for r in store.read().collect()}


def test_a_replay_long_after(spark, tmp_path):
    """A batch that comes again keeps its place below later ones, also after it was folded and cleaned away."""
    store = Collection(spark, str(tmp_path / "c"))
    first = store.append_changes(docs(spark, (1, "old", 9)), writer="stream", epoch=0)
    for i in range(3):
        store.append_changes(docs(spark, (1, f"new{i}", 1)), writer=f"other{i}", epoch=0)
    assert store.append_changes(docs(spark, (1, "old", 9)), writer="stream", epoch=0) == first
    assert content(store) == {"1": "new2"} and len(store.batches()) == 4
    for _ in range(3):
        store.compact()
        store.vacuum()
        store.append_changes(docs(spark, (2, "x", 1)))
        store.append_changes(docs(spark, (1, "old", 9)), writer="stream", epoch=0)
        assert content(store) == {"1": "new2", "2": "x"}


def test_a_batch_keeps_the_last_row_of_a_key(spark, tmp_path):
    store = Collection(spark, str(tmp_path / "c"))
    store.append_changes(docs(spark, (1, "a", 1), (1, "b", 3), (1, "c", 2), (2, "y", 1), (2, "z", 1)))
    assert content(store) == {"1": "b", "2": "z"}
    store.append_changes(docs(spark, (1, "d", 1)))
    gone = store.read().where("doc_id = 'db.notes.2'").withColumn("deleted", F.lit(True))
    store.append_changes(gone)
    assert content(store) == {"1": "d"}
    store.compact()
    assert content(store) == {"1": "d"} and store.batches() == []


def test_a_batch_committed_during_a_compaction_stays(spark, tmp_path):
    store = Collection(spark, str(tmp_path / "c"))
    store.append_changes(docs(spark, (1, "a", 1)))
    slow = store.new_snapshot()
    before = store.read()
    store.append_changes(docs(spark, (1, "b", 1)), writer="w", epoch=0)
    slow.add(before)
    slow.finish()
    assert content(store) == {"1": "b"}
    store.vacuum()
    assert content(store) == {"1": "b"}


def test_two_snapshots_of_one_generation(spark, tmp_path):
    """Both were begun together; one contains a batch that the other, which wins, does not: clean-up must not lose it."""
    store = Collection(spark, str(tmp_path / "c"))
    store.append_changes(docs(spark, (1, "a", 1)))
    early = store.new_snapshot()
    early.folder = "z"  # wins over the other folder of its generation
    early.add(store.read())
    store.append_changes(docs(spark, (2, "b", 1)))
    late = store.new_snapshot()
    late.folder = "a"
    late.add(store.read())
    late.finish()
    early.finish()
    store.vacuum()
    assert content(store) == {"1": "a", "2": "b"}


def test_vacuum_leaves_what_is_needed(spark, tmp_path):
    root = tmp_path / "c"
    store = Collection(spark, str(root))
    other = TableConfig("db", "memos", ("body",), (), "id", "Memo")
    store.append_changes(docs(spark, (7, "memo", 1), cfg=other))
    store.compact()
    for i in range(4):
        store.append_changes(docs(spark, (i, f"t{i}", 1)))
        store.compact()
        store.vacuum()
    folders = [x for x in os.listdir(root / "documents") if x.startswith("folder=")]
    assert len(folders) == 3  # two of the notes, one of the memos
    assert content(store) == {"7": "memo", **{str(i): f"t{i}" for i in range(4)}}
    batches = [d for d, _, names in os.walk(root / "changes") if any(x.endswith(".parquet") for x in names)]
    assert len(batches) == 2  # the one that only the last snapshot of the notes contains, and that of the memos


def test_an_empty_snapshot_empties_its_tables(spark, tmp_path):
    store = Collection(spark, str(tmp_path / "c"))
    store.append_changes(docs(spark, (1, "a", 1)))
    store.write_snapshot(store.read().where("false"))
    assert content(store) == {} and store.batches() == []
    store.append_changes(docs(spark, (1, "b", 1)))
    assert content(store) == {"1": "b"}


def test_a_build_reads_and_renders_each_row_once(spark, tmp_path):
    spark.range(200).selectExpr("cast(id as int) id", "'b' || id body", "1.0D n", "timestamp_ntz'2024-01-01' changed").write.parquet(str(tmp_path / "in"))
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(body):
        calls.add(1)
        return body

    class Source:
        def read(self, spark, table):
            return spark.read.parquet(str(tmp_path / "in")).withColumn("body", counted.asNondeterministic()("body"))

    sync = Sync(Source(), [CFG], Collection(spark, str(tmp_path / "c")))
    assert sync.build().count() == 200 and calls.value == 200
    assert sync.incremental().count() == 200 and calls.value == 400


@pytest.mark.parametrize("small", [0, 1000])
def test_changes_of_a_hot_key(spark, small):
    """A third of the changes are of one key; both ways of leaving changed keys out give the same."""
    current = spark.range(300).selectExpr("cast(id as string) doc_id", "'old' text", "timestamp_ntz'2024-01-01' version")
    log = spark.range(900).selectExpr("cast(if(id % 3 = 0, 5, id) as string) doc_id", "'new' || id text", "timestamp_ntz'2024-01-01' version",
                                      "id batch", "id % 7 = 1 deleted")
    got = {r["doc_id"]: r["text"] for r in apply_changes(current, log, small_keys=small).collect()}
    want = {str(i): "old" for i in range(300)}
    for i in range(900):
        key = "5" if i % 3 == 0 else str(i)
        want[key] = f"new{i}"
        if i % 7 == 1:
            del want[key]
    assert got == want


@pytest.mark.parametrize("order", list(permutations(range(3)))[1:])
def test_events_in_any_order_of_their_files(spark, tmp_path, order):
    files = [[(1, "a", 1.0, day(1)), (2, "b", 1.0, day(1))], [(1, "a5", 1.0, day(5)), (2, "tie x", 1.0, day(2))],
             [(1, "a3", 1.0, day(3)), (2, "tie y", 1.0, day(2)), (3, "no date", 1.0, None), (None, "no key", 1.0, day(1))]]
    place = str(tmp_path / "in")
    store = Collection(spark, str(tmp_path / "c"))
    for k in order:
        spark.createDataFrame(files[k], SCHEMA).coalesce(1).write.mode("append").parquet(place)
        rows = stream_parquet(spark, place, spark.createDataFrame([], SCHEMA).schema)
        stream_changes(rows, CFG, store, str(tmp_path / "check"), event_order=("changed",)).awaitTermination()
    got = content(store)
    assert {k: got[k] for k in "123"} == {"1": "a5", "2": "tie y", "3": "no date"} and len(got) == 4


def _plans(spark, run):
    """Plans of what is written meanwhile, by their commands' text."""
    seen = []
    write = DataFrameWriter.parquet

    def parquet(self, path, *args, **kwargs):
        seen.append((path, self._df._jdf.queryExecution().optimizedPlan().toString()))
        return write(self, path, *args, **kwargs)

    DataFrameWriter.parquet = parquet
    try:
        run()
    finally:
        DataFrameWriter.parquet = write
    return seen


def test_compaction_writes_constants_as_table_names(spark, tmp_path):
    """A task sorted all its documents by table before it wrote them, though they were of one table."""
    store = Collection(spark, str(tmp_path / "c"))
    store.write_snapshot(docs(spark, *((i, "old", 1) for i in range(5))))
    store.append_changes(docs(spark, (1, "new", 1), (1, "newer", 2), (9, "new", 1)))
    written = [plan for path, plan in _plans(spark, store.compact) if "/documents/" in path]
    assert len(written) == 3
    for plan in written:
        top = plan.split("\n")[0]
        assert plan.startswith("LocalRelation") or "AS source_table" in top, top
    assert content(store) == {"0": "old", "1": "newer", "2": "old", "3": "old", "4": "old", "9": "new"}


def test_changes_of_single_keys_are_not_aggregated(spark, tmp_path):
    """Changes whose key occurs once went through a sorted aggregate of whole rows, vectors and all."""
    store = Collection(spark, str(tmp_path / "c"))
    store.write_snapshot(docs(spark, (1, "old", 1)))
    store.append_changes(docs(spark, (1, "new", 1), (2, "new", 1)))
    kept, once, several = store._parts()
    assert "max_by" not in once.select("doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 0 and several.count() == 0 and once.count() == 2
