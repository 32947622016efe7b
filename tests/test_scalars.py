from __future__ import annotations

import base64

import numpy as np
import pytest
from pyspark.sql import Row, functions as F, types as T

from lectern.config import Code, Flag, Joined, Name, TableConfig, Template
from lectern.functions import text as X, vectors as V
from lectern.operators import documents as D


def values(spark, rows, expr, schema="v string"):
    df = spark.createDataFrame([(r,) for r in rows], schema).withColumn("_i", F.monotonically_increasing_id())
    return [r[0] for r in df.orderBy("_i").select(expr).collect()]


def test_clean_strips_all_white_space(spark):
    assert values(spark, [None, "", "  ", "\t x \n", " y ", "None"], X.clean(F.col("v"))) == [
        "", "", "", "x", "y", "None"]


def test_clean_renders_numbers_and_nested_values(spark):
    doubles = [0.001, 0.0001, 0.00012345678901234567, 0.00001, -1.5e-7, 2.5e-10, 1e-300, 1e16, 1.25e17, 1e100, -0.0005]
    assert values(spark, doubles, X.clean(F.col("v"), T.DoubleType()), "v double") == [str(d) for d in doubles]
    assert values(spark, [1.5, 100000000.0, 123456789.25, 0.0, None], X.clean(F.col("v"), T.DoubleType()), "v double") == [
        "1.5", "100000000.0", "123456789.25", "0.0", ""]
    assert values(spark, [True, False], X.clean(F.col("v"), T.BooleanType()), "v boolean") == ["True", "False"]
    df = spark.createDataFrame([(Row(a=1, b="x"),)], "v struct<a:int,b:string>")
    assert df.select(X.clean(F.col("v"), df.schema["v"].dataType)).first()[0] == '{"a":1,"b":"x"}'


def test_join_drops_blank_words(spark):
    df = spark.createDataFrame([("a", "NULL", "0", " b ", "nan", None, "None")], "a string,b string,c string,d string,e string,f string,g string")
    assert df.select(X.join_nonblank([X.clean(F.col(c)) for c in df.columns], " | ")).first()[0] == "a | b"


def test_template_features(spark):
    df = spark.createDataFrame([("Ann", " ", "Lee", 0, "1", True, None, "text " * 2000)],
                               "first string, middle string, last string, n int, stat string, deemed boolean, city string, body string")
    t = Template("{who} {n}%\n{stat} {deemed} {zero}|{place}",
                 {"who": Name(("first", "middle", "last")), "stat": Code("stat", {"1": "Active"}, "Inactive"),
                  "deemed": Flag("deemed"), "zero": Flag("n"), "place": Joined(("city", "last"), ", ")}, attachment="body")
    out = df.select(D.render_template(df.schema, t)).first()[0]
    head, body = out.split("\n\nFile Content:\n")
    assert head == "Ann Lee 0%\nActive Yes No|Lee"
    assert len(body) == 5000


def test_document_keys_and_metadata(spark):
    df = spark.createDataFrame([(1, "a", 2.5), (None, "a", None)], "id bigint, t string, n double")
    cfg = TableConfig("db", "tab", ("t",), ("n",), "id", "Label")
    rows = {r["pk_value"]: r for r in D.build_documents(df, cfg).collect()}
    assert rows["1"]["doc_id"] == "db.tab.1" and rows["1"]["metadata"]["n"] == "2.5"
    (other,) = [r for k, r in rows.items() if k != "1"]
    assert len(other["pk_value"]) == 16 and "n" not in other["metadata"]
    assert other["text"] == "Label\nT: a"
    assert other["metadata"] == {"source_db": "db", "source_table": "tab", "doc_label": "Label", "pk_value": other["pk_value"]}


def test_sensitive_columns(spark):
    df = spark.createDataFrame([(1, "x", "y")], "id int, Password string, api_key string")
    assert D.drop_sensitive(df).columns == ["id"]


def test_preview(spark):
    assert values(spark, [None, "", "x" * 70], D.preview_cell(F.col("v"), T.StringType())) == ["NULL", "NULL", "x" * 60]


def test_scores_and_verdicts(spark):
    assert values(spark, ["7/10", "Score: 7", "8.5", "none", "1.2.3", "", "7."], X.parse_score(F.col("v"))) == [
        7.0, 7.0, 8.5, 5.0, 5.0, 5.0, 7.0]
    assert values(spark, ["Yes.", "no", "YES"], X.parse_yesno(F.col("v"))) == [True, False, True]


def test_timestamps(spark):
    out = values(spark, ["2024-01-02 03:04:05", " 2024-01-02T03:04:05 ", "02.01.2024"], X.parse_timestamp(F.col("v")))
    assert [str(o) for o in out] == ["2024-01-02 03:04:05", "2024-01-02 03:04:05", "None"]


def html_rule(text):
    """The rule character by character."""
    runs, run, inside = [], "", False
    for ch in text:
        if ch == "<":
            if run:
                runs.append(run)
            run, inside = "", True
        elif ch == ">":
            inside = False
        elif not inside:
            run += ch
    return " ".join(runs + ([run] if run else [])).strip()


def test_html(spark):
    cases = ["", "plain", "a<b>c</b>d", "x > y", "<script>if (a>b) c</script> d", "&amp;<p>", "a < b", "<p", "<<b>>t", "a<br>\n<br>b"]
    assert values(spark, cases, X.html_to_text(F.col("v"))) == [html_rule(c) for c in cases]


def test_decode(spark):
    raw = ["é".encode(), "é".encode("latin-1"), b"", b"ascii"]
    assert values(spark, [bytearray(r) for r in raw], X.decode_bytes(F.col("v")), "v binary") == ["é", "é", "", "ascii"]


def test_extension(spark):
    cases = ["a/b.PDF", "b.tar.gz", ".bashrc", "dir.x/file", "/a/..b.txt", "x."]
    assert values(spark, cases, X.file_extension(F.col("v"))) == ["pdf", "gz", "", "", "txt", ""]
    df = spark.createDataFrame([("a.pdf", " .Html "), ("a.pdf", " "), ("a.pdf", None)], "p string, t string")
    assert [r[0] for r in df.select(X.file_extension(F.col("p"), F.col("t"))).collect()] == ["html", "pdf", "pdf"]


def test_path_candidates(spark):
    def found(p):
        return [c["candidate"] for c in values(spark, [p], X.path_candidates(F.col("v"), ("/up/",)))[0]]

    assert found(" /a/b.txt ") == ["/a/b.txt", "/up/b.txt"]
    coded = base64.b64encode(b"/a/b c.txt").decode()
    assert found(coded)[:2] == [coded, "/a/b c.txt"]
    assert found("/a/b%20c+d.txt") == ["/a/b%20c+d.txt", "/a/b c+d.txt", "/up/b%20c+d.txt"]
    assert found("no base64!")[0] == "no base64!"
    assert values(spark, [None, " "], X.path_candidates(F.col("v"))) == [None, None]


@pytest.mark.parametrize("length", [0, 1, 999, 1000, 1001, 1800, 1801, 5000])
def test_sliding_chunks(spark, length):
    text = "".join(chr(97 + i % 26) for i in range(length))
    chunks = values(spark, [text], X.chunk_sliding(F.col("v")))[0]
    assert all(len(c) <= 1000 for c in chunks)
    assert (chunks[0] + "".join(c[200:] for c in chunks[1:]) if chunks else "") == text
    assert len(chunks) == (0 if length == 0 else max(0, -(-(length - 1000) // 800)) + 1)


def test_json_array(spark):
    shape = "array<struct<table:string,label:string>>"
    cases = ['```json\n[{"table": "a"}, {"label": "x"}]\n```', 'Sure: [{"table": "b", "label": "B"}] ok', "none", "[broken"]
    out = values(spark, cases, X.parse_json_array(F.col("v"), shape))
    assert [r["table"] for r in out[0]] == ["a", None] and out[1][0]["label"] == "B"
    assert not out[2] and not out[3]


def test_normalise(spark):
    out = values(spark, [[3.0, 4.0], [0.0, 0.0], None], V.normalise(F.col("v")), "v array<float>")
    assert out[0] == pytest.approx([0.6, 0.8]) and out[1] == [0.0, 0.0] and out[2] is None


def test_hashed_embedding(spark):
    from lectern.queries.searching import hashed_model

    texts = ["", "one", "a b a c", "Straße ÉTÉ 42 été", "x " * 5000]
    out = values(spark, texts, V.embed_hashed(F.col("v")))
    want = hashed_model()(texts)
    for got, counts in zip(out, want):
        length = (counts.astype(float) ** 2).sum() ** 0.5 or 1.0
        assert len(got) == V.HASHED_DIM and got == pytest.approx(list(counts / length), abs=1e-6)


def test_embedder_keeps_a_bounded_number_of_short_tokens(monkeypatch):
    """Tokens of any length were kept, and a batch was held as Python objects."""
    monkeypatch.setattr(V, "TOKENS_KEPT", 10)
    places = V._Places(V.HASHED_DIM)
    long = "x" * 1000
    texts = [" ".join(f"t{i}" for i in range(30)), "", f"{long} t1 t1", "ünï 5"]
    got = V._unit_counts(texts, places)
    assert len(places) <= 10 and long not in places
    for text, row in zip(texts, got):
        tf = np.zeros(V.HASHED_DIM)
        for word in V._TOKEN.findall(text):
            tf[V._bucket(word, V.HASHED_DIM)] += 1
        assert (row == (tf / (np.sqrt(tf @ tf) or 1.0)).astype(np.float32)).all()
