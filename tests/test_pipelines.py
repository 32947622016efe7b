from __future__ import annotations

import datetime as dt
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lectern.config import TableConfig
from lectern.functions import models as U, text as X, vectors as V
from lectern.operators import answers as A, chunks as C
from lectern.plans import answering as Q
from lectern.plans.sync import Sync, file_chunk_documents
from lectern.sources import files as S
from lectern.sources.collection import Collection
from lectern.sources.ledger import Ledger

# ---- chunks ------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_recursive_chunks_lose_only_white_space(text, size, overlap):
    chunks = C.split_text(text, size, overlap)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    place = 0
    for c in chunks:  # chunks follow each other in the text
        at = text.find(c, max(0, place - overlap - size))
        assert at >= 0
        place = at
    kept = set("".join(chunks)) - set(" \n")
    assert kept == set(text) - set(" \n")
    if overlap == 0:
        assert "".join("".join(chunks).split()) == "".join(text.split())


def test_recursive_chunks_by_hand():
    assert C.split_text("aaa\n\nbbb\n\nccc", 8, 0) == ["aaa\n\nbbb", "ccc"]
    assert C.split_text("aaaa bbbb cccc dddd", 10, 5) == ["aaaa bbbb", "bbbb cccc", "cccc dddd"]
    assert C.split_text("abcdefghij", 4, 2) == ["abcd", "cdef", "efgh", "ghij"]
    assert C.split_text("", 4, 2) == [] and C.split_text("  \n ", 10, 2) == []


def test_chunk_rows(spark):
    df = spark.createDataFrame([("a", "x" * 1900), ("b", ""), ("c", None)], "doc_id string, text string")
    for recursive in (False, True):
        rows = C.chunk_documents(df, recursive=recursive).orderBy("chunk_index").collect()
        assert [r["chunk_id"] for r in rows] == [f"a.chunk_{i}" for i in range(len(rows))]
        assert {r["total_chunks"] for r in rows} == {len(rows)}


# ---- files -------------------------------------------------------------------


def test_two_file_columns_never_collide(spark, tmp_path):
    body = spark.createDataFrame([("a.txt", bytearray(b"alpha")), ("b.csv", bytearray(b'x,"y\nz"\n1,2\n')), ("c.html", bytearray(b"<p>gamma</p>"))],
                                 "name string, content binary")
    root = str(tmp_path / "up")
    assert S.write_files(body, root, "name", "content").count() == 3
    cfg = TableConfig("db", "tab", ("note",), (), None, "Tab", file_columns=(("one", ""), ("two", "kind")))
    rows = [("n1", f"{root}/a.txt", "b.csv", None), ("n2", " ", f"{root}/c.html", "HTM"), ("n3", f"{root}/a.txt", None, None), ("n4", "/missing", None, None)]
    df = spark.createDataFrame(rows, "note string, one string, two string, kind string")
    refs = S.file_refs(df, cfg)
    assert refs.count() == 5
    files = S.scan_files(spark, root)
    out = {(r["row_id"], r["path_col"]): (r["text"], r["extension"]) for r in S.extract_refs(refs, files, prefixes=(f"{root}/",)).collect()}
    assert sorted(v for v in out.values() if v[0]) == [("alpha", "txt"), ("alpha", "txt"), ("gamma", "htm"), ("x | y\nz\n1 | 2", "csv")]
    docs = file_chunk_documents(refs, files, cfg, prefixes=(f"{root}/",)).collect()
    assert len(docs) == 4 and len({d["doc_id"] for d in docs}) == 4
    assert sum(".two.chunk_0" in d["doc_id"] for d in docs) == 2
    assert all(d["doc_id"].startswith(d["parent_id"]) and len(d["embedding"]) == V.HASHED_DIM for d in docs)


def test_extractor_errors_stay_with_their_file(spark):
    def picky(data: bytes) -> str:
        if data == b"bad":
            raise ValueError("no")
        return data.decode()

    e = S.Extractors()
    e.register_python([".ZZZ"], picky)
    assert e.supported() == ["csv", "htm", "html", "log", "md", "rst", "text", "tsv", "txt", "zzz"]
    df = spark.createDataFrame([(1, bytearray(b"bad"), "zzz"), (2, bytearray(b"good"), "zzz"), (3, bytearray(b"x"), "pdf"), (4, bytearray(b" \n"), "txt"),
                                (5, bytearray(b"a\tb\r\nc"), "tsv"), (6, bytearray("é\r\nx".encode("latin-1")), "txt")],
                               "id int, content binary, extension string")
    got = {r["id"]: (r["text"], r["error"]) for r in e.extract(df).collect()}
    assert got == {1: (None, "ValueError: no"), 2: ("good", None), 3: (None, None), 4: (None, None), 5: ("a\tb\nc", None), 6: ("é\nx", None)}


# ---- models ------------------------------------------------------------------


def test_embedder_failures_become_zero_vectors(spark):
    def factory():
        def embed(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("model down")
            return [[len(t), 1.0] for t in texts]
        return embed

    df = spark.createDataFrame([("a",), ("bad",), ("ccc",)], "t string")
    got = {r["t"]: r["m"] for r in df.select("t", U.embed_with(factory, F.col("t"), 2).alias("m")).collect()}
    assert got["bad"]["embedding"] == [0.0, 0.0] and not got["bad"]["embed_ok"]
    assert got["ccc"]["embed_ok"] and got["ccc"]["embedding"] == pytest.approx([3 / 10 ** 0.5, 1 / 10 ** 0.5])


def test_model_slots(spark):
    def scorer():
        def score(questions, texts):
            if "bad" in texts:
                raise RuntimeError("no")
            return [float(len(t)) for t in texts]
        return score

    def writer():
        def write(questions, contexts):
            if "bad" in contexts:
                raise RuntimeError("no")
            return ["" if c == "none" else f"{q}:{c}" for q, c in zip(questions, contexts)]
        return write

    hits = spark.createDataFrame([(1, "q", "bad", 0.5, 1, "x"), (1, "q", "fine", 0.4, 2, "y")],
                                 "query_id int, question string, text string, score double, rank int, doc_id string")
    ranked = A.rerank(hits, scorer=lambda q, t: U.score_with(scorer, q, t)).orderBy("rank").collect()
    assert [(r["doc_id"], r["rerank_score"]) for r in ranked] == [("x", 5.0), ("y", 4.0)]
    kept = A.grade(hits, grader=lambda q, t: U.score_with(scorer, q, t) > 100).collect()
    assert {r["doc_id"]: r["relevant"] for r in kept} == {"x": True, "y": False}
    asked = spark.createDataFrame([(1, "q"), (2, "q"), (3, "q")], "query_id int, question string")
    contexts = spark.createDataFrame([(1, "bad"), (2, "none"), (3, "ctx")], "query_id int, context string")
    got = {r["query_id"]: r["answer"] for r in A.generate(asked, contexts, lambda q, c: U.generate_with(writer, q, c)).collect()}
    assert got == {1: A.FAILED_ANSWER, 2: A.EMPTY_ANSWER, 3: "q:ctx"}


# ---- answers -----------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("db.t.1", "Red foxes hunt at night. They sleep by day."), ("db.t.2", "Blue whales eat krill."),
            ("db.t.3", "Foxes and whales are mammals."), ("db.t.3.chunk_0", "Attached: mammals have hair."), ("db.t.4", "Nothing here.")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    return df.select("doc_id", F.lit("T").alias("doc_label"), F.lit("db").alias("source_db"), F.lit("t").alias("source_table"),
                     "text", V.embed_hashed(F.col("text")).alias("embedding"))


def test_answers_cite_the_best_sentence(spark, corpus):
    asked = spark.createDataFrame([(1, "when do red foxes hunt"), (2, "are whales mammals")], "query_id int, question string")
    rows = {r["query_id"]: r for r in Q.answer_questions(corpus, asked, 2).collect()}
    assert rows[1]["answer"].startswith("Red foxes hunt at night. [1]")
    assert rows[1]["grounded"] and rows[1]["sources"][0]["doc_id"] == "db.t.1"
    ids = [s["doc_id"] for s in rows[2]["sources"]]
    assert "db.t.3" in ids and "db.t.3.chunk_0" in ids  # the first file chunk joins its record
    assert rows[2]["n_sources"] == len(ids)


def test_best_sentence_against_brute_force(spark):
    import re

    rng = random.Random(5)
    words = ["ab", "cd", "ef", "gh", "ij"]
    cases = [(" ".join(rng.choices(words, k=3)), " ".join(" ".join(rng.choices(words, k=4)) + rng.choice([".", "!", "?"]) for _ in range(4)))
             for _ in range(40)]
    df = spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(cases)], "i int, q string, t string")
    got = [r["s"] for r in df.orderBy("i").select(A.best_sentence(F.col("q"), F.col("t")).alias("s")).collect()]
    for s, (q, t) in zip(got, cases):
        sentences = re.split(r"(?<=[.!?])\s+", t)
        best = max(sentences, key=lambda x: len(set(re.findall(r"\w+", x)) & set(q.split())))
        assert s == best


def test_no_hits_give_the_fixed_answer(spark, corpus):
    asked = spark.createDataFrame([(1, "foxes")], "query_id int, question string")
    (row,) = Q.answer_questions(corpus, asked, 3, where=F.col("source_db") == "other").collect()
    assert row["answer"] == A.NO_HITS and not row["has_hits"] and row["n_sources"] == 0


def test_retry_keeps_ungraded_hits_as_last_resort(spark, corpus):
    asked = spark.createDataFrame([(1, "red foxes hunt"), (2, "zebra crossing rules")], "query_id int, question string")
    kept = Q.retrieve_graded(corpus, asked, 2, 0.9).collect()
    assert {r["doc_id"] for r in kept if r["query_id"] == 1} == {"db.t.1"}
    assert len([r for r in kept if r["query_id"] == 2 and not r["relevant"]]) == 2


def test_regeneration_happens_once(spark, corpus):
    def writer():
        return lambda questions, contexts: ["invented words only" for _ in questions]

    asked = spark.createDataFrame([(1, "red foxes")], "query_id int, question string")
    models = Q.Models(generator=lambda q, c: U.generate_with(writer, q, c))
    (row,) = Q.answer_questions(corpus, asked, 2, models=models).collect()
    assert row["answer"] == "invented words only" and not row["grounded"]


# ---- collections and syncs ---------------------------------------------------


class Tables:
    """A source over data frames."""

    def __init__(self, frames):
        self.frames = frames

    def read(self, spark, table):
        return self.frames[table]


CFG = TableConfig("db", "notes", ("body",), ("n",), "id", "Note", date_column="changed")
SCHEMA = "id int, body string, n double, changed timestamp_ntz"


def day(n):
    return dt.datetime(2024, 1, n)


def content(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_incremental_equals_full_build(spark, tmp_path):
    source = Tables({"notes": spark.createDataFrame([(1, "a", 1.0, day(1)), (2, "b", 2.0, day(2)), (3, "c", 0.0, None)], SCHEMA)})
    sync = Sync(source, [CFG], Collection(spark, str(tmp_path / "one")))
    assert len(content(sync.build())) == 3
    # One row changed on the day of the watermark, one is new, one is late and too old to be seen.
    rows = [(1, "a", 1.0, day(1)), (2, "b2", 2.0, day(2)), (4, "d", 0.0, day(3)), (3, "c", 0.0, None)]
    source.frames["notes"] = spark.createDataFrame(rows, SCHEMA)
    after = content(sync.incremental())
    full = Sync(source, [CFG], Collection(spark, str(tmp_path / "two")))
    assert after == content(full.build())
    assert after["db.notes.2"] == "Note\nBody: b2"
    again = content(sync.incremental())
    assert again == after
    sync.collection.compact()
    assert content(sync.collection.read()) == after and sync.collection.changes(sync.collection.last_batch()) is None
    assert [r["records"] for r in sync.ledger.read().orderBy("run_ts").collect()] == [3, 2, 1]


def test_a_failing_table_keeps_its_watermark(spark, tmp_path):
    good = spark.createDataFrame([(1, "a", 1.0, day(1))], SCHEMA)
    source = Tables({"notes": good})
    other = TableConfig("db", "gone", ("body",), (), "id", "Gone", date_column="changed")
    sync = Sync(source, [CFG, other], Collection(spark, str(tmp_path / "c")))
    sync.build()
    sync.incremental()
    state = {r["table_key"]: r for r in sync.ledger.latest().collect()}
    assert state["db.notes"]["status"] == "success" and state["db.gone"]["status"] == "error" and state["db.gone"]["error"]
    assert sync.ledger.watermarks() == {"db.notes": day(1)}
    del source.frames["notes"]
    assert content(sync.rescan()) == {"db.notes.1": "Note\nBody: a"}  # an unreadable table loses nothing
    assert sync.ledger.watermarks() == {"db.notes": day(1)}


def test_rescan_and_reindex_remove_gone_rows(spark, tmp_path):
    rows = [(i, f"t{i}", 0.0, day(1)) for i in range(1, 6)]
    source = Tables({"notes": spark.createDataFrame(rows, SCHEMA)})
    sync = Sync(source, [CFG], Collection(spark, str(tmp_path / "c")))
    sync.build()
    source.frames["notes"] = spark.createDataFrame(rows[:3], SCHEMA)
    assert len(content(sync.reindex(CFG))) == 3
    source.frames["notes"] = spark.createDataFrame(rows[:2], SCHEMA)
    assert len(content(sync.rescan())) == 2


def test_a_batch_written_twice_counts_once(spark, tmp_path):
    store = Collection(spark, str(tmp_path / "c"))
    assert store.read().count() == 0 and store.last_batch() == -1
    from lectern.operators.documents import build_documents
    from lectern.plans.sync import embed_documents

    docs = embed_documents(build_documents(spark.createDataFrame([(1, "a", 1.0, day(1)), (1, "z", 1.0, day(2))], SCHEMA), CFG))
    for _ in range(2):
        store.append_changes(docs, writer="w", epoch=5)
    assert len(store.batches()) == 1
    store.append_changes(docs, writer="v", epoch=5)
    assert len(store.batches()) == 2
    assert content(store.read()) == {"db.notes.1": "Note\nBody: z"}


def test_absent_ledger_is_empty(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "none"))
    assert ledger.read().count() == 0 and ledger.watermarks() == {} and ledger.latest().count() == 0


def test_stream_restart_continues(spark, tmp_path):
    from lectern.streaming.sync import stream_changes, stream_parquet

    store = Collection(spark, str(tmp_path / "c"))

    def arrive(name, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream_changes(stream_parquet(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema), CFG, store,
                       str(tmp_path / "check")).awaitTermination()

    arrive("one", [(1, "a", 1.0, day(1)), (2, "b", 1.0, day(1))])
    run()
    arrive("two", [(1, "a2", 1.0, day(3)), (2, "late", 1.0, dt.datetime(2023, 1, 1))])
    run()
    run()
    assert store.batches() == [0, 1]
    assert content(store.read()) == {"db.notes.1": "Note\nBody: a2", "db.notes.2": "Note\nBody: late"}


def _stream(spark, tmp_path, store, rows, name="s"):
    from lectern.streaming.sync import stream_changes, stream_parquet

    place = str(tmp_path / f"{name}-in")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(place)
    frames = stream_parquet(spark, place, spark.createDataFrame([], SCHEMA).schema)
    stream_changes(frames, CFG, store, str(tmp_path / f"{name}-check")).awaitTermination()


def test_streams_and_syncs_keep_each_others_changes(spark, tmp_path):
    source = Tables({"notes": spark.createDataFrame([(1, "a", 1.0, day(1)), (2, "b", 1.0, day(1))], SCHEMA)})
    sync = Sync(source, [CFG], Collection(spark, str(tmp_path / "c")))
    sync.build()
    source.frames["notes"] = spark.createDataFrame([(1, "a", 1.0, day(1)), (2, "b2", 1.0, day(2))], SCHEMA)
    sync.incremental()
    _stream(spark, tmp_path, sync.collection, [(3, "c", 1.0, day(3))])
    want = {"db.notes.1": "Note\nBody: a", "db.notes.2": "Note\nBody: b2", "db.notes.3": "Note\nBody: c"}
    assert content(sync.collection.read()) == want
    sync.collection.compact()
    _stream(spark, tmp_path, sync.collection, [(4, "d", 1.0, day(1))], "t")
    assert content(sync.collection.read()) == {**want, "db.notes.4": "Note\nBody: d"}


def test_build_of_some_tables_keeps_the_others(spark, tmp_path):
    rows = [(1, "a", 1.0, day(1))]
    source = Tables({"notes": spark.createDataFrame(rows, SCHEMA), "memos": spark.createDataFrame(rows, SCHEMA)})
    memos = TableConfig("db", "memos", ("body",), ("n",), "id", "Memo", date_column="changed")
    store = Collection(spark, str(tmp_path / "c"))
    Sync(source, [CFG, memos], store).build()
    assert set(content(Sync(source, [CFG], store).build())) == {"db.notes.1", "db.memos.1"}


def test_a_crashed_build_leaves_nothing(spark, tmp_path):
    source = Tables({"notes": spark.createDataFrame([(9, "a", 1.0, day(1))], SCHEMA)})
    store = Collection(spark, str(tmp_path / "c"))
    sync = Sync(source, [CFG], store)
    sync.build()
    left = store.new_snapshot()
    left.add(store.read(), 0)
    left.add(store.read(), 1)  # never finished
    store.compact()
    assert store.read().count() == 1


def test_two_writers_and_a_snapshot_between(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from lectern.operators.documents import build_documents
    from lectern.plans.sync import embed_documents

    store = Collection(spark, str(tmp_path / "c"))

    def docs(i, text):
        return embed_documents(build_documents(spark.createDataFrame([(i, text, 1.0, day(1))], SCHEMA), CFG))

    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda i: store.append_changes(docs(i, f"t{i}")), range(6)))
    assert len(set(numbers)) == 6 and store.read().count() == 6
    upto = store.last_batch()
    before, snapshot = store.read(upto), store.new_snapshot(upto)
    store.append_changes(docs(0, "meanwhile"))
    snapshot.add(before)
    snapshot.finish()
    assert content(store.read())["db.notes.0"] == "Note\nBody: meanwhile" and store.read().count() == 6
    for i in range(3):
        store.append_changes(docs(20 + i, "x"), compact_after=2)
    assert len(store.batches()) <= 2 and store.read().count() == 9


def test_dates_moved_back_or_lost(spark, tmp_path):
    source = Tables({"notes": spark.createDataFrame([(1, "a", 1.0, day(9)), (2, "b", 1.0, day(9))], SCHEMA)})
    sync = Sync(source, [CFG], Collection(spark, str(tmp_path / "c")))
    sync.build()
    source.frames["notes"] = spark.createDataFrame([(1, "a2", 1.0, day(1)), (2, "b2", 1.0, None)], SCHEMA)
    assert content(sync.reindex(CFG)) == {"db.notes.1": "Note\nBody: a2", "db.notes.2": "Note\nBody: b2"}


def test_file_chunks_follow_their_records(spark, tmp_path):
    """Chunks of changed, kept and removed records through build, incremental sync, re-index and rescan."""
    from lectern.plans.sync import Files
    from lectern.sources import files as S

    root = tmp_path / "files"
    root.mkdir()
    for name, text in (("a.txt", "alpha " * 300), ("b.txt", "beta"), ("c.csv", "k,v\n1,x\n2,y\n")):
        (root / name).write_text(text)
    cfg = TableConfig("db", "notes", ("body",), ("n",), "id", "Note", date_column="changed", file_columns=(("doc", ""),))
    schema = f"{SCHEMA}, doc string"
    rows = [(1, "one", 1.0, day(1), f"{root}/a.txt"), (2, "two", 1.0, day(1), f"{root}/b.txt"), (3, "three", 1.0, day(1), f"{root}/c.csv")]
    source = Tables({"notes": spark.createDataFrame(rows, schema)})
    store = Collection(spark, str(tmp_path / "c"))
    sync = Sync(source, [cfg], store, files=Files(lambda: S.scan_files(spark, str(root)), prefixes=(f"{root}/",)))
    built = content(sync.build())
    first = {k for k in built if ".1.chunk_" in k}
    assert len(first) > 1 and "db.notes.2.chunk_0" in built and built["db.notes.3.chunk_0"] == "k: 1\nv: x" and "db.notes.3.chunk_1" in built
    # Row 1 now names the short file: its second chunk goes. Row 2 keeps its chunk.
    rows[0] = (1, "one", 1.0, day(2), f"{root}/b.txt")
    source.frames["notes"] = spark.createDataFrame(rows, schema)
    after = content(sync.incremental())
    assert after["db.notes.1.chunk_0"] == "beta" and "db.notes.1.chunk_1" not in after and "db.notes.2.chunk_0" in after
    source.frames["notes"] = spark.createDataFrame(rows[:2], schema)
    again = content(sync.reindex(cfg))
    assert set(again) == {"db.notes.1", "db.notes.2", "db.notes.1.chunk_0", "db.notes.2.chunk_0"}
    source.frames["notes"] = spark.createDataFrame(rows[:1], schema)
    # Without files at hand, stored chunks stay with the records that are left.
    assert set(content(Sync(source, [cfg], store).rescan())) == {"db.notes.1", "db.notes.1.chunk_0"}
    assert sync.ledger.latest().first()["records"] == 1
