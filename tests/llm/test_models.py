"""Language, toxicity, URLs, chat and the pipeline: learned models on held-out rows, the rest against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lectern.llm import chat, langid, toxicity, urls
from lectern.llm.common import held_out, training_rows

SYLLABLES = {"aa": "ba ke lo mi tu ran sel vor dun pik hes jal".split(), "bb": "zho xir qua wen yix ptal grü".split()}


def prose(lang, seed, n=60):
    r = random.Random(f"{lang}{seed}")
    return ". ".join(" ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 3))) for _ in range(8)) for _ in range(n // 8))


@pytest.fixture(scope="module")
def marked(spark):
    rows = [(i, prose(lang := ("aa", "bb")[i % 2], i), lang) for i in range(240)]
    rows += [(900, prose("aa", 900), None), (901, None, "aa"), (902, "123 !!", "bb"), (None, prose("bb", 1), "bb"), (903, "qjvkwf " * 30, None)]
    return spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, lang string, score double, rejected string")


def test_split(spark):
    ids = spark.range(500).withColumnRenamed("id", "doc_id")
    rows = ids.select("doc_id", held_out().alias("h"), training_rows().alias("t")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["t"] != r["h"] for r in rows)


def test_language(marked):
    model = langid.train(marked)
    assert model.langs == ["aa", "bb"]
    rows = {r["doc_id"]: r for r in langid.predict(marked, model).collect()}
    assert all(rows[i]["lang_pred"] == ("aa", "bb")[i % 2] and not rows[i]["rejected"] for i in range(240))
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    for i in (901, 902):
        assert rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 and rows[i]["rejected"]
    assert rows[900]["lang_pred"] == "aa" and rows[903]["rejected"]
    kept = marked.where(langid.accepted(marked, model))
    assert kept.columns == marked.columns and kept.count() == 242


def test_no_ngram_is_left_out(spark, monkeypatch):
    """A language whose n-grams all occur once stays whole beside one with many."""
    monkeypatch.setattr(langid, "MAX_NGRAMS", 400, raising=False)
    one = next(i for i in range(900, 999) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows = [(i, prose("aa", i), "aa") for i in range(60)] + [(one, "quick brown fox", "zz")]
    learned = [t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    code, place = langid.windows([langid.letters(t) for t in learned], 4)
    assert model.langs == ["aa", "zz"]
    assert len(model.grams[4]) == len(np.unique(langid.hashes(code, 4)[4][place]))


def test_rare_language_is_calibrated(spark):
    """Each language's bound comes from its own learning rows, however many rows the others have."""
    rows = [(i, prose("aa", i % 40, 16), "aa") for i in range(13000)] + [(20000 + i, prose("bb", i), "bb") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    learned = [t for i, t, lang in rows if lang == "bb" and zlib.crc32(str(i).encode()) % 3 != 1]
    model = langid.train(docs)
    bits, n = model.entropies(learned)
    assert model.langs == ["aa", "bb"] and len(learned) > 1
    own = bits[:, 1]
    mean = (own * n).sum() / n.sum()
    assert abs(model.mean[1] - mean) < 1e-9
    assert abs(model.spread[1] - np.sqrt((n * (own - mean) ** 2).mean())) < 1e-6


def test_one_learning_row_has_the_common_spread(spark):
    one = next(i for i in range(900, 999) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows = [(i, prose("aa", i), "aa") for i in range(60)] + [(one, prose("bb", 1), "bb")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.spread[1] == model.spread[0] > 0


def test_language_without_rows(marked):
    empty = marked.where("false")
    model = langid.train(empty)
    assert langid.predict(empty, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(marked, model).collect()} == {"und"}


def test_kneser_ney():
    """Probabilities of all characters after a context add up to one, but for the share of unseen characters."""
    text = "abracadabra cabra abra " * 3
    code, place = langid.windows([langid.letters(text)], 4)
    grams: dict = {}
    for i in place:
        grams[tuple(code[i - 3 : i + 1])] = grams.get(tuple(code[i - 3 : i + 1]), 0) + 1
    at = np.array(list(grams), np.int64)
    model = langid.build(["x"], np.zeros(len(at), np.int64), at[:, 0] << 21 | at[:, 1], at[:, 2] << 21 | at[:, 3],
                         np.array(list(grams.values())))
    alphabet = sorted(set(code.tolist()))
    for context in ("bra", "zzz", "a c"):
        total = 0.0
        for c in alphabet:
            seq = np.array([ord(x) if x != " " else 0 for x in context] + [c], np.uint32)
            h = langid.hashes(seq, 4)
            gram = [g[3:4] for g in h]
            total += float(model.prob(4, gram, [gram[0], *(h[k - 1][2:3] for k in range(1, 5))])[0, 0])
        assert 0.85 < total <= 1 + 1e-9


TOXIC = ["vilword", "badname", "slurry"]


@pytest.fixture(scope="module")
def judged(spark):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(500):
        toxic = i % 4 == 0
        parts = prose("aa", i, 80).split(". ")
        if toxic:
            parts[r.randrange(len(parts))] += " " + " ".join(r.choices(TOXIC, k=2))
        docs.append((i, ". ".join(parts)))
        labels.append((i, int(toxic)))
    docs += [(900, None), (901, ""), (902, "... !!"), (None, "vilword badname"), (3, docs[3][1])]
    labels += [(3, 0), (901, None), (None, 1), (5000, 1)]
    return (spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, score double"),
            spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, toxic int, label int"))


def test_toxicity(judged):
    docs, labels = judged
    model = toxicity.train(docs, labels)
    rows = toxicity.predict(docs, model).collect()
    by = {r["doc_id"]: r for r in rows}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = [by[i]["predicted"] == (i % 4 == 0) for i in held]
    assert len(held) > 100 and np.mean(right) > 0.97
    assert all(by[i]["score"] == 0 and by[i]["predicted"] == 0 for i in (900, 901))
    texts = dict(docs.select("doc_id", "text").collect())
    for i in held:
        for s in by[i]["offending"]:
            assert i % 4 or any(t in texts[i][s["start"] : s["end"]] for t in TOXIC)
    assert sum(bool(by[i]["offending"]) for i in held if i % 4 == 0) > 0.9 * sum(i % 4 == 0 for i in held)
    kept = docs.where(toxicity.clean(docs, model))
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in rows)


def test_toxicity_without_labels(judged):
    docs, labels = judged
    model = toxicity.train(docs, labels.where("toxic = 0"))
    assert {r["score"] < 1e-6 for r in toxicity.predict(docs, model).collect()} == {True}
    assert toxicity.predict(docs.where("false"), toxicity.train(docs.where("false"), labels)).count() == 0


RULES = (urls.Rule("block", "net/"), urls.Rule("allow", "example.net/en/"), urls.Rule("block", "example.com/de/"),
         urls.Rule("allow", "org/fr/"))
URLS = [None, "", "no scheme", "http://", "https://A.Example.NET/en/1?x#y", "http://example.net/en", "ftp://x.net", "ftp://x.net/?q",
        "http://notexample.com/de/x", "http://m.example.com/de/x", "x://org/fr/", "x://a.org/FR/", "http://net?a/b", "a://b://c/d",
        "http://u@h.net:80/p;x?y", "http://example.com/de", "http://x.org\n/fr/"]


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text), default=None)


def test_urls(spark):
    df = spark.createDataFrame([(i % 15, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    model = urls.fit([], [])
    got = urls.judge(df, RULES, model).collect()
    want = []
    for i, u in enumerate(URLS):
        host, path, rule = plain_rule(u)
        want.append((i % 15, host, path, rule.text if rule else None, rule.verdict if rule else "allow"))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert urls.judge(df.where("false"), RULES, model).count() == 0


def test_url_model(spark):
    rows = [(f"http://s{i}.{'shady' if i % 2 else 'fine'}.com/{'win' if i % 2 else 'news'}/{i}", i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "url string, blocked int")
    model = urls.train(df.where("pmod(xxhash64(url), 3) != 0"))
    host, path = urls.host_path(F.col("url"))
    held = df.where("pmod(xxhash64(url), 3) = 0").select("blocked", (model.logit(host, path) >= 0).alias("said")).collect()
    assert len(held) > 50 and all(bool(r["blocked"]) == r["said"] for r in held)
    # The expression is the dot product of the learned weights.
    one = df.limit(1).select(urls.grams(host, path).alias("g"), model.logit(host, path).alias("z")).first()
    assert one["z"] == pytest.approx(model.bias + sum(model.weights[g] for g in one["g"]), abs=1e-6)


@given(st.text("<|\\im_end>a", max_size=30))
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_chat(spark):
    tricky = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", tricky), (1, 2, "user", None), (2, 5, "assistant", "x"), (2, 1, "user", "y<\\|"),
            (3, 0, None, "z"), (3, None, "user", ""), (None, 0, "user", "q"), (None, 1, "assistant", "r"), (4, 0, "user|<|", "\n"),
            (5, 0, "assistant", "same"), (5, 0, "assistant", "same")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "conv_id long, turn long, role string, text string, state string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert len(got) == 6
    for key in {r[0] for r in rows}:
        turns = sorted((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == key)
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        g = got[key]
        assert (g["n_turns"], g["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[2]["valid"] and got[None]["valid"] and not got[5]["valid"] and not got[3]["valid"] and not got[1]["valid"]
    assert chat.read_back(chat.format_turns(df.where("false"))).count() == 0


def test_pipeline(spark, sf):
    """Each stage against its operator on the stage's own input."""
    import corpus_pipeline
    from lectern.llm import simhash
    from lectern.llm.common import stored

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "toxicity", "near_duplicates", "packing"]
    one = stored(stages["language"](spark, docs, sf), "one")
    said = langid.predict(docs, langid.train(docs)).where("not rejected")
    assert one.columns == columns and sorted(r[0] for r in one.select("doc_id").collect()) == sorted(r[0] for r in said.select("doc_id").collect())
    two = stored(stages["toxicity"](spark, one, sf), "two")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    said = toxicity.predict(one, toxicity.train(one, labels)).where("predicted = 0")
    assert two.columns == columns and sorted(r[0] for r in two.select("doc_id").collect()) == sorted(r[0] for r in said.select("doc_id").collect())
    three = stored(stages["near_duplicates"](spark, two, sf), "three")
    first = simhash.groups(two).where("doc_id = component_id")
    assert three.columns == columns and sorted(r[0] for r in three.select("doc_id").collect()) == sorted(r[0] for r in first.select("doc_id").collect())
    last = stages["packing"](spark, three, sf).collect()
    assert {r["doc_id"] for r in last} == {r[0] for r in three.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, sf).count() == len(last)
