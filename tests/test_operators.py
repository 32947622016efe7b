from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import joins as J, merge as M, profile as P, search as S
from lectern.operators.predicates import compile_where, scope
from lectern.operators.skew import skewed_join


def found(df, where):
    return sorted(r["id"] for r in df.where(compile_where(where)).collect())


def test_predicates(spark):
    rows = [(1, {"a": "10"}), (2, {"a": "9.5"}), (3, {"a": "abc"}), (4, {}), (5, {"a": "None"}), (6, {"a": "True", "b": "x"})]
    df = spark.createDataFrame(rows, "id int, metadata map<string,string>")
    assert found(df, {"a": 10}) == [1]
    assert found(df, {"a": {"$eq": None}}) == [4, 5]
    assert found(df, {"a": {"$ne": "abc"}}) == [1, 2, 4, 5, 6]
    assert found(df, {"a": {"$in": [10, "abc"]}}) == [1, 3]
    assert found(df, {"a": {"$nin": [10, "abc"]}}) == [2, 4, 5, 6]
    assert found(df, {"a": {"$gt": 9.5}}) == [1]
    assert found(df, {"a": {"$gte": "9.5"}}) == [1, 2]
    assert found(df, {"a": {"$lt": 10}}) == [2]
    assert found(df, {"a": True, "b": "x"}) == [6]
    assert found(df, {"$or": [{"a": 10}, {"$and": [{"a": True}, {"b": {"$ne": "y"}}]}]}) == [1, 6]
    assert found(df, {"$or": []}) == [] and len(found(df, {"$and": []})) == 6


@pytest.mark.parametrize("bad", [{"a": {"$gt": 1, "$lt": 2}}, {"a": {"$like": "x"}}, {"$not": [{}]},
                                 {"$and": [{"a": 1}], "b": 2}])
def test_bad_predicates(spark, bad):
    with pytest.raises(ValueError):
        compile_where(bad)


def test_scope_prunes_partitions(spark, tmp_path):
    rows = spark.range(20).select(F.concat(F.lit("d"), F.col("id") % 2).alias("source_db"),
                                  F.concat(F.lit("t"), F.col("id") % 5).alias("source_table"), "id")
    rows.write.partitionBy("source_db", "source_table").parquet(str(tmp_path / "c"))
    read = spark.read.parquet(str(tmp_path / "c")).where(scope("d1", "t3"))
    assert "PartitionFilters: [isnotnull(source_db" in read._jdf.queryExecution().executedPlan().toString().replace("\n", "")
    assert sorted(r["id"] for r in read.collect()) == [3, 13]


def brute(docs, queries, k):
    out = []
    for q, v in queries:
        scored = sorted((-round(float(np.dot(np.float32(v).astype(float), np.float32(d).astype(float))), 6), i) for i, d in docs)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    docs = [(f"d{i}", rng.normal(size=8).astype("float32").tolist()) for i in range(300)]
    # A third of the collection are copies of one vector, and so ties.
    docs += [(f"copy{i:03d}", docs[0][1]) for i in range(150)]
    queries = [(i, rng.normal(size=8).astype("float32").tolist()) for i in range(25)] + [(99, docs[0][1])]
    return docs, queries


@pytest.mark.parametrize("options", [{}, {"max_queries": 4}])
def test_topk_is_exact(spark, vectors, options):
    docs, queries = vectors
    d = spark.createDataFrame(docs + [("null", None)], "doc_id string, embedding array<float>").repartition(7)
    q = spark.createDataFrame(queries, "query_id int, embedding array<float>")
    got = sorted(tuple(r) for r in S.topk(d, q, 6, **options).collect())
    want = brute(docs, queries, 6)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_failed_embeddings_are_no_hits(spark):
    d = spark.createDataFrame([("zero", [0.0, 0.0]), ("far", [-1.0, 0.0]), ("null", None)], "doc_id string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    assert [tuple(r) for r in S.topk(d, q, 5).collect()] == [(1, 1, "far", -1.0)]


def test_topk_edge_cases(spark, vectors):
    docs, queries = vectors
    d = spark.createDataFrame(docs, "doc_id string, embedding array<float>")
    none = spark.createDataFrame([], "query_id int, embedding array<float>")
    assert S.topk(d, none, 3).count() == 0
    q = spark.createDataFrame(queries[:2], "query_id int, embedding array<float>")
    assert S.topk(d, q, 1000).count() == 2 * len(docs)
    assert S.topk(d, q, 3, where=F.col("doc_id") == "d7").count() == 2


def test_postfilter_finds_less_than_prefilter(spark, vectors):
    docs, queries = vectors
    d = spark.createDataFrame(docs, "doc_id string, embedding array<float>")
    q = spark.createDataFrame(queries, "query_id int, embedding array<float>")
    rare = F.col("doc_id").isin([f"d{i}" for i in range(5)])
    post = {(r["query_id"], r["doc_id"]) for r in S.topk_postfilter(d, q, 3, rare).collect()}
    pre = {(r["query_id"], r["doc_id"]) for r in S.topk(d, q, 3, where=rare).collect()}
    assert post < pre and len(pre) == 3 * len(queries)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skewed_join_equals_join(spark, how):
    left = spark.range(3000).select(F.when(F.col("id") < 1000, 7).when(F.col("id") > 1500, F.col("id") % 40).alias("k"), "id")
    right = spark.createDataFrame([(i, f"v{j}") for i in range(30) for j in range(i % 3)], "k bigint, v string")
    plain = sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
    salted = skewed_join(left, right, ["k"], how, rows_per_copy=50)
    assert sorted(map(tuple, salted.collect()), key=str) == plain


def test_skewed_join_of_equal_rows_and_maps(spark):
    left = spark.range(900).select(F.lit(1).alias("k"), F.create_map(F.lit("a"), F.lit("b")).alias("m"))
    right = spark.createDataFrame([(1, "x")], "k int, v string")
    out = skewed_join(left, right, ["k"], rows_per_copy=100)
    assert out.count() == 900
    bare = skewed_join(left.select("k"), right, ["k"], "left_semi", rows_per_copy=100)
    assert bare.count() == 900


def test_small_sides_are_measured(spark):
    from lectern.operators.skew import fits_broadcast

    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    assert fits_broadcast(df) and not fits_broadcast(df, rows=99) and not fits_broadcast(df, size=100_000)
    left = spark.range(200).withColumn("v", F.lit(1))
    for how in ("inner", "left", "left_semi", "left_anti"):
        small = skewed_join(left, df, ["id"], how, cheap=True)
        assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
        assert small.count() == left.join(df, "id", how).count()


def test_one_per_key_both_ways(spark):
    from datetime import datetime as dt

    rows = [(f"d{i}", dt(2024, 1, 1), "t") for i in range(30)] + [("d1", dt(2024, 1, 2), "new"), ("d2", dt(2024, 1, 1), "u")]
    df = spark.createDataFrame(rows, "doc_id string, version timestamp_ntz, text string")
    for bound in (0, 100):
        got = {r["doc_id"]: r["text"] for r in M.one_per_key(df, small_keys=bound).collect()}
        assert len(got) == 30 and got["d1"] == "new" and got["d2"] == "u"


def test_proposals_skip_malformed_items(spark):
    answers = spark.createDataFrame([(1, '```json\n[{"table": "t", "file_columns": [["p", "k"], [], ["q"]]}, {"label": "x"}, 7]\n```'), (2, "no")],
                                    "id int, answer string")
    (row,) = P.proposed_configs(answers, "answer", "db").collect()
    assert (row["id"], row["table_name"], row["label"], row["description"], row["text_columns"]) == (1, "t", "t", "", [])
    assert [tuple(f) for f in row["file_columns"]] == [("p", "k"), ("q", "")]


def test_skewed_join_spreads_null_and_hot_keys(spark):
    """With 90 % NULL keys, and with thousands of hot keys, no partition of the joined rows is far above the mean."""
    right = spark.range(6000).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    rows = spark.range(0, 200_000, numPartitions=16)
    empty = rows.select(F.when(F.col("id") % 10 == 0, F.col("id") % 6000).alias("k"), "id")
    many = rows.select((F.col("id") % 5000).alias("k"), "id")
    for left in (empty, many):
        sizes = [r[1] for r in skewed_join(left, right, ["k"], "left", rows_per_copy=20).groupBy(
            F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 200_000 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_answers_after_the_head_of_a_text(spark):
    from lectern.operators import answers as A

    text = "nothing here. " * 400 + "The velocity of zebras is high."
    hits = spark.createDataFrame([(1, 1, "d", "velocity zebras", text, 0.5)],
                                 "query_id int, rank int, doc_id string, question string, text string, score double")
    assert A.grade(hits, 0.9).first()["relevant"] and not A.grade(hits, 0.9, chars=1500).first()["relevant"]
    assert A.extractive_answer(hits).first()["answer"] == "The velocity of zebras is high. [1]"


def test_models_are_called_once(spark, tmp_path):
    """A filter on the outcome does not make the optimizer call the model again."""
    from lectern.functions import models as U

    log = str(tmp_path / "calls")

    def factory():
        def model(texts):
            with open(log, "a") as f:
                f.write("".join("x\n" for _ in texts))
            return [[1.0, 2.0]] * len(texts)
        return model

    df = spark.range(10).select("id", U.embed_with(factory, F.col("id").cast("string"), 2).alias("m"))
    assert df.where("m.embed_ok").select("id", "m.embedding").where(F.size("embedding") > 0).count() == 10
    assert len(open(log).read().split()) == 10


def test_upsert_is_idempotent(spark):
    schema = "doc_id string, version timestamp_ntz, text string"
    from datetime import datetime as dt

    cur = spark.createDataFrame([("a", dt(2024, 1, 1), "old"), ("b", dt(2024, 1, 1), "b")], schema)
    delta = spark.createDataFrame([("a", dt(2024, 1, 1), "new"), ("c", dt(2024, 1, 2), "c"), ("b", dt(2023, 1, 1), "late")], schema)
    once = M.upsert_latest(cur, delta)
    twice = M.upsert_latest(once, delta)
    want = [("a", "new"), ("b", "late"), ("c", "c")]
    for df in (once, twice):
        assert sorted((r["doc_id"], r["text"]) for r in df.collect()) == want


def test_apply_changes_both_ways(spark):
    from datetime import datetime as dt

    cur = spark.createDataFrame([(f"d{i}", dt(2024, 1, 1), "old") for i in range(50)], "doc_id string, version timestamp_ntz, text string")
    log = spark.createDataFrame(
        [("d1", dt(2024, 1, 2), "new", 0, False), ("d1", dt(2024, 1, 2), "newer", 1, False), ("d2", dt(2024, 1, 1), "gone", 0, True),
         ("d3", dt(2023, 1, 1), "late", 1, False), ("x", dt(2024, 1, 1), "x", 0, False),
         ("d4", None, "undated", 1, False), ("d5", dt(2024, 1, 5), "first", 2, False), ("d5", dt(2024, 1, 3), "earlier", 2, False)],
        "doc_id string, version timestamp_ntz, text string, batch bigint, deleted boolean")
    for bound in (0, 100):
        got = {r["doc_id"]: r["text"] for r in M.apply_changes(cur, log, small_keys=bound).collect()}
        assert got["d1"] == "newer" and "d2" not in got and got["d3"] == "late" and got["x"] == "x" and len(got) == 50
        assert got["d4"] == "undated" and got["d5"] == "first"


def test_physical_dedup_keeps_unknown(spark):
    df = spark.createDataFrame([(1, "h", 0), (2, "h", 1), (3, None, 0), (4, None, 1)], "id int, place string, prio int")
    assert sorted(r["id"] for r in M.physical_dedup(df, ["place"], ["prio"]).collect()) == [1, 3, 4]


def test_overlay(spark):
    base = spark.createDataFrame([(1, "a", ["x"]), (2, "b", ["y"])], "k int, v string, l array<string>")
    patch = spark.createDataFrame([(1, "", []), (2, "B", ["z"]), (3, "c", [])], "k int, v string, l array<string>")
    assert sorted(tuple(r) for r in J.overlay(base, patch, ["k"]).collect()) == [(1, "a", ["x"]), (2, "B", ["z"]), (3, "c", [])]


def test_resolve_paths_takes_the_first_place(spark):
    refs = spark.createDataFrame([(1, "/a/x.txt"), (2, "/gone/y.txt"), (3, "nowhere"), (4, None), (5, "/gone/y.txt")], "id int, path string")
    listing = spark.createDataFrame([("/a/x.txt",), ("/up/x.txt",), ("/up/y.txt",), ("/var/y.txt",)], "path string")
    got = {r["id"]: r["resolved_path"] for r in J.resolve_paths(refs, listing, prefixes=("/var/", "/up/")).collect()}
    assert got == {1: "/a/x.txt", 2: "/var/y.txt", 3: None, 4: None, 5: "/var/y.txt"}


def test_profile_rules(spark):
    import datetime

    rows = [(i, "n", "u", "/f", "pdf", "att", "doc", "b", datetime.date(2024, 1, 1 + i), datetime.date(2024, 2, 1)) for i in range(3)]
    things = spark.createDataFrame(rows, "thing_no int, note string, short string, spec_path string, spec_type string, attachment string, "
                                   "my_documents_list string, password string, seen date, created_at date")
    frames = {"things": things, "thing_log": things, "bare": spark.createDataFrame([(1, 2)], "a int, b int")}
    columns = P.catalog(spark, frames, {("things", "short"): "MUL"})
    assert {r["table_name"] for r in columns.collect()} == {"things", "bare"}
    (cfg,) = P.configs(columns, "db").collect()
    assert cfg["pk_column"] == "thing_no" and cfg["date_column"] == "created_at" and cfg["label"] == "Things"
    # A name that only contains a file pattern is text and file at once.
    assert cfg["text_columns"] == ["note", "spec_type", "my_documents_list"]
    assert cfg["metadata_columns"] == ["thing_no", "short", "seen", "created_at"]
    pairs = {f["path_col"]: f["type_col"] for f in cfg["file_columns"]}
    assert pairs == {"spec_path": "spec_type", "attachment": "", "my_documents_list": ""}
    assert "password" not in [r["column_name"] for r in columns.collect()]


def test_lookup_sorts_no_texts(spark):
    """Ids too many to be sent to every task made each task sort the texts of its documents."""
    docs = spark.createDataFrame([(f"d{i}", f"text {i}") for i in range(40)], "doc_id string, text string")
    ids = spark.createDataFrame([("d1",), ("d1",), ("d7",), ("none",), (None,)], "doc_id string")
    for bound in (0, 100):
        found = J.lookup(docs, ids, small_ids=bound)
        assert sorted(map(tuple, found.collect())) == [("d1", "text 1"), ("d7", "text 7")]
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
