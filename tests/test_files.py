"""Comma-separated files in the JVM against Python's reader, and chunks of files with many records."""

from __future__ import annotations

import csv
import io
from itertools import zip_longest

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lectern.operators import chunks as C
from lectern.queries import syncing
from lectern.sources import files as S


def plain_rows(text):
    csv.field_size_limit(1 << 30)
    return list(csv.reader(io.StringIO(text, newline=None)))


def plain_text(text):
    return "\n".join(map(" | ".join, plain_rows(text))).strip()


def plain_documents(text):
    rows = iter(plain_rows(text))
    header = next(rows, [])
    out = ["\n".join(f"{n}: {v}" for n, v in zip_longest(header, row[: len(header)], fillvalue="")) for row in rows if row]
    return [t for t in out if t.strip()]


def check(spark, texts):
    df = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate(texts)], "i int, content binary").withColumn("extension", F.lit("csv"))
    found = S.Extractors().documents(df).select("i", "text", "texts")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for r in found.collect():
        t = texts[r["i"]]
        assert (r["text"] or "").strip() == plain_text(t), repr(t)
        assert r["texts"] == plain_documents(t), repr(t)


def test_csv_by_hand(spark):
    big = '"' + 'long ""quoted"" field, with\nlines ' * 20_000 + '",x'
    check(spark, ["a,b\n1,2\n", 'x,"y\nz"\n1,2\n', "", "\n", "\n\na,b\n", "a\r\nb\rc\n", ',,\n,"",\n', '5" pipe,7\n"q""q",""""\n"tail"end,z',
                  '"open,never\nclosed', 'a,b\n1\n1,2,3\n\n\n4,5', '"a" ,b', f"h1,h2\n{big}\n3,4", "é,日本\n😀,ß\n", 'a,"b"\n"', '""\n""'])


def test_csv_any(spark):
    cases = []

    @settings(max_examples=300, deadline=None, derandomize=True)
    @given(st.text('ab,"\n\r é', max_size=25))
    def gather(text):
        cases.append(text)

    gather()
    check(spark, cases)


def test_chunks_are_counted_through(spark):
    """One file of very many records, files of one text, and empty texts; by blocks of several sizes."""
    rows = [("many", 5000, i, "" if i % 10 == 3 else f"record {i} " * (150 if i % 50 == 0 else 1)) for i in range(5000)]
    rows += [(f"one{i}", 1, 0, "x" * (1 + 700 * i)) for i in range(5)]
    texts = spark.createDataFrame(rows, "file string, parts int, part int, text string").repartition(8)
    want = []
    for file in dict.fromkeys(r[0] for r in rows):
        cut = [c for r in rows if r[0] == file for c in ([r[3][a : a + 1000] for a in range(0, max(len(r[3]) - 200, 1), 800)] if r[3] else [])]
        want += [(file, i, len(cut), c) for i, c in enumerate(cut)]
    for block in (64, 4096):
        got = C.chunks_through(texts, ["file"], block=block)
        assert got.columns == ["file", "chunk_index", "total_chunks", "text"]
        assert sorted(map(tuple, got.collect())) == sorted(want)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        held = C.chunks_through(texts, ["file"], block=64).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert held < 2500


def test_texts_of_a_file_do_not_carry_all_of_them(spark):
    """Counted beside the generator, the texts of a file went along with each of them: memory by their square."""
    content = "id,note\n" + "\n".join(f"{i},n{i}" for i in range(50))
    files = spark.createDataFrame([("a", content.encode(), "csv"), ("b", b"", "csv"), ("c", b"one", "txt")], "name string, content binary, extension string")
    parts = S.text_parts(S.Extractors().documents(files), "name")
    got = sorted((r["name"], r["parts"], r["part"], r["text"]) for r in parts.collect())
    assert got == sorted([("a", 50, i, f"id: {i}\nnote: n{i}") for i in range(50)] + [("c", 1, 0, "one")])
    plan = parts._jdf.queryExecution().executedPlan().toString()
    generate = next(line for line in plan.split("\n") if "Generate posexplode(" in line)
    carried = generate.split("], ")[0].split(", [")[1]
    assert "parts#" in carried and "texts#" not in carried


def test_small_files_share_tasks(spark, tmp_path):
    n = 2_000
    for i in range(n):
        (tmp_path / f"{i}.txt").write_text(f"file {i}")
    files = S.scan_files(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() <= S.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    found = {r["path"].rpartition("/")[2]: (r["length"], bytes(r["content"])) for r in files.collect()}
    assert found == {f"{i}.txt": (len(f"file {i}"), f"file {i}".encode()) for i in range(n)}


def found_files(files):
    return {r["path"]: (r["length"], bytes(r["content"])) for r in files.collect()}


def test_driver_holds_no_list_of_files(spark, tmp_path):
    """Spark's reader of files kept every file's status on the driver, and its name once more in each scan."""
    for i in range(500):
        (tmp_path / f"{i}.txt").write_text(f"file {i}")
    files = S.scan_files(spark, str(tmp_path))
    assert len(files.inputFiles()) <= S.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    plan = files.select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "EvalPython" not in plan  # nor is any file opened for its name
    twice = files.where(F.length("content") > 6).select(F.md5("content"), F.length("content"))
    assert twice._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 2


def test_scan_finds_what_sparks_reader_finds(spark, tmp_path):
    """Folders of several depths, odd and hidden names, links, empty and large files, and a folder named by a URI."""
    root = tmp_path / "a b%20#c"
    for name, data in (("x.txt", b"x"), ("empty.txt", b""), ("d/e/f/deep er.txt", "é".encode()), ("d/100%.txt", b"%"), ("d/k=1/y.txt", b"y"),
                       ("_hidden/z.txt", b"z"), (".dot/z.txt", b"z"), ("d/_z.txt", b"z"), ("d/.z.txt", b"z"), ("d/_k=1/z.txt", b"z"),
                       ("_metadata", b"m"), ("_metadata_of/m.txt", b"m"), ("d/z._COPYING_", b"z"), *((f"d/large{i}.bin", bytes([i]) * (3 << 20)) for i in range(6))):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "none").mkdir()
    (tmp_path / "elsewhere").mkdir()
    (tmp_path / "elsewhere" / "linked.txt").write_text("linked")
    (root / "link").symlink_to(tmp_path / "elsewhere")
    (root / "broken").symlink_to(tmp_path / "nothing")
    want = found_files(S._scan_by_spark(spark, str(root)))
    assert f"{root}/d/e/f/deep er.txt" in want and f"{root}/link/linked.txt" in want and len(want) == 13
    assert found_files(S.scan_files(spark, str(root))) == want
    assert found_files(S.scan_files(spark, f"file://{root}/")) == want
    assert sorted(S._entries(S.fs.SubTreeFileSystem("/", S.fs.LocalFileSystem()), f"{root}/d/e")) == [("f", f"{root}/d/e/f".lstrip("/"), None)]
    assert S.scan_files(spark, str(root / "none")).count() == 0
    assert found_files(S.scan_files(spark, f"{tmp_path}/else*")) == {f"{tmp_path}/elsewhere/linked.txt": (6, b"linked")}
    with pytest.raises(AnalysisException):
        S.scan_files(spark, str(root / "missing"))


def test_files_below_a_folder_named_by_a_uri(spark, sf, tmp_path, monkeypatch):
    """References and found files met in no path where the shared folder was given as a URI, so that no file had a text."""
    monkeypatch.setattr(syncing, "scratch_path", lambda spark, name: f"file://{tmp_path}/{name}")
    pages = spark.read.parquet(f"{sf}/pages.parquet").count()
    assert syncing.file_scan_text(spark, sf).where("text_md5 IS NOT NULL").count() == pages
