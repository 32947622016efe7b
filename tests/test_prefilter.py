"""Key filters before shuffles, and the kept index of terms."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lectern.config import TableConfig
from lectern.operators import joins as J, prefilter
from lectern.operators.documents import build_documents
from lectern.operators.search import attach
from lectern.plans.answering import rewrite_rarest
from lectern.sources.collection import Collection
from lectern.sources.terms import TermIndex

CFG = TableConfig("db", "notes", ("body",), (), "id", "Note")


def keys(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "doc_id string")


@pytest.mark.parametrize("most", [prefilter.MOST, prefilter.WORD])
def test_no_key_is_lost(spark, monkeypatch, most):
    monkeypatch.setattr(prefilter, "MOST", most)
    df = spark.range(60_000).selectExpr("if(id = 7, null, 'k' || id) doc_id", "id", "1 _word0", "2 text")
    wanted = spark.range(0, 60_000, 20).selectExpr("'k' || id doc_id").unionByName(keys(spark, "k20", None, "other"))
    got = prefilter.maybe_among(df, "doc_id", wanted)
    assert got.columns == df.columns
    ids = {r["id"] for r in got.collect()}
    assert set(range(0, 60_000, 20)) <= ids and len(ids) == got.count()
    if most == prefilter.MOST:
        assert len(ids) < 3000 + 0.04 * 57_000
    assert prefilter.maybe_among(df, "doc_id", keys(spark)).count() == 0


def test_only_texts_of_hits_are_shuffled(spark):
    """Below every exchange that carries texts stands the filter."""
    docs = spark.range(5000).selectExpr("'d' || id doc_id", "repeat('x', 50) || id text")
    hits = spark.range(60).selectExpr("id % 6 query_id", "'d' || if(id % 3 = 0, 1, id) doc_id", "1.0D score")
    found = attach(hits, docs, ["text"], broadcast_rows=0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    for exchange in re.split(r"\n.*(?=Exchange hashpartitioning)", plan)[1:]:
        if "repeat(" in exchange:
            assert exchange.index("getbit") < exchange.index("repeat(")
    few = attach(hits, docs, ["text"])
    assert sorted(map(tuple, found.select(few.columns).collect())) == sorted(map(tuple, few.collect()))


def test_documents_without_a_base_record(spark):
    """Records are no chunks and have no base: they must not meet in one task of the last join."""
    ids = spark.range(4000).selectExpr("'t.' || id doc_id").unionByName(keys(spark, "t.1.chunk_3", "t.9.chunk_0"))
    docs = spark.createDataFrame([("t.1", "/a"), ("t.2.chunk_0", "/b"), ("t.9.chunk_0", "/c"), ("t.9", "/d")], "doc_id string, f string")
    for small in (False, True):
        found = J.file_path_for_doc(ids, docs, F.col("f"), small=small)
        got = {r["doc_id"]: r["file_path"] for r in found.where("file_path IS NOT NULL").collect()}
        assert got == {"t.1": "/a", "t.2": "/b", "t.9": "/d", "t.1.chunk_3": "/a", "t.9.chunk_0": "/c"} and found.count() == 4002
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = J.file_path_for_doc(ids, docs, F.col("f")).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes < 1000


# ---- terms ---------------------------------------------------------------------


def docs(spark, *rows):
    table = spark.createDataFrame([(i, body) for i, body in rows], "id int, body string")
    return build_documents(table, CFG).withColumn("embedding", F.lit(None).cast("array<float>"))


def counted(index):
    return {r["term"]: r["df"] for r in index.frequencies().collect()}


def plain(store):
    out = {}
    for r in store.read().collect():
        for t in set(re.findall(r"[^\W_]+", r["text"].lower())):
            out[t] = out.get(t, 0) + 1
    return out


@pytest.mark.parametrize("small", [0, 1000])
def test_terms_follow_the_collection(spark, tmp_path, small):
    store = Collection(spark, str(tmp_path / "c"))
    index = TermIndex(store, small)
    assert counted(index) == {}
    index.refresh()
    store.append_changes(docs(spark, (1, "red fox fox"), (2, "blue fox"), (2, "blue whale")), writer="w", epoch=0)
    store.append_changes(docs(spark, (1, "red hen"), (3, "green hen")))
    index.refresh()
    assert counted(index) == plain(store) and counted(index)["hen"] == 2 and "fox" not in counted(index)
    store.append_changes(docs(spark, (1, "red fox fox"), (2, "blue fox"), (2, "blue whale")), writer="w", epoch=0)
    index.refresh()
    assert counted(index) == plain(store)
    store.compact()
    index.refresh()
    store.append_changes(store.read().where("doc_id = 'db.notes.3'").withColumn("deleted", F.lit(True)))
    store.append_changes(docs(spark, (2, ""), (4, "hen")))
    index.refresh()
    index.refresh()
    assert counted(index) == plain(store) and counted(index)["hen"] == 2
    store.write_snapshot(store.read().where("false"))
    index.refresh()
    assert counted(index) == {}


def test_rewriting_reads_no_texts(spark, tmp_path):
    store = Collection(spark, str(tmp_path / "c"))
    store.write_snapshot(docs(spark, *((i, f"common word{i % 50} rare{i}") for i in range(300))))
    index = TermIndex(store)
    index.refresh()
    asked = spark.createDataFrame([(1, "common word7 rare7 unknown"), (2, "nothing known")], "query_id int, question string")
    short = rewrite_rarest(asked, store.read(), 2, index.frequencies())
    whole = rewrite_rarest(asked, store.read(), 2)
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, whole.collect())) == [(1, "rare7 word7", True), (2, "nothing known", False)]
    read = re.findall(r"ReadSchema: (\S+)", short._jdf.queryExecution().executedPlan().toString())
    assert read and not any("text:" in schema for schema in read)
