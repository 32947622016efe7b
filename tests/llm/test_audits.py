"""Filter and source audits against plain Python, and piece counts against the public library."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from lectern.llm import divergence, piececount, survival

PIECES = P.path("piece_bpe_32k.model")


# ---- filters -------------------------------------------------------------------

FILTER_TEXTS = [None, "", "word " * 200, "word " * 199, " ".join(f"w{i}" for i in range(250)), "A" + "b" * 49, "A" + "b" * 48, "x # y",
                "one word", "\x1f \x0b tab\tand", " ".join(f"w{i}" for i in range(260)) + " 50%", "éÀ" * 30, "same", "same"]


def plain_fails(text: str) -> str:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return "".join(f for f, bad in zip("ABCD", (
        len(words) < 200, 100 * len(set(words)) < 50 * len(words),
        100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), any(c in "#$%&*|" for c in text))) if bad)


def plain_audit(rows, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    docs = defaultdict(list)
    for i, text, source in rows:
        text = text or ""
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)
        docs[source or ""].append((plain_fails(text) + "E" * copy, i in good, i in toxic))
    out = []
    for part, own in docs.items():
        shapley = Counter()
        rows_of_part = []
        for order in permutations("ABCDE"):
            alive = own
            for step, f in enumerate(order, 1):
                gone = [d for d in alive if f in d[0]]
                alive = [d for d in alive if f not in d[0]]
                shapley[f] += len(gone)
                rows_of_part.append((f, (part, "".join(order), step, len(alive), len(gone), sum(f in d[0] for d in own) - len(gone),
                                         sum(d[0] == f for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone))))
        out += [(*r, shapley[f]) for f, r in rows_of_part]
    return sorted(out)


def test_filter_audit(spark):
    rows = [(i, t, (None, "", "web", "code")[i % 4]) for i, t in enumerate(FILTER_TEXTS * 3)]
    rows += [(None, "same", "web"), (None, None, None), (3, "same", "web"), (3, "same", "web"), (2, "other text of id 2", "code")]
    labels = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(0, 40, 2)] + [(4, None, 1), (6, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).withColumns(
        {c: F.lit(7) for c in ("part", "digest", "words", "fails", "first", "good", "kept", "_n", "_salt")})
    given_labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("first", F.lit(1))
    got = survival.audit(docs, given_labels)
    assert got.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, labels)


def test_filter_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert survival.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "x" * 3_000_000 + " #", "s")], docs.schema)
    assert sorted(map(tuple, survival.audit(one, labels).collect())) == plain_audit([(1, "x" * 3_000_000 + " #", "s")], [])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=70), max_size=5))
def test_carry_save_counts(batches):
    counter = survival.Counter()
    for batch in batches:
        counter.add(np.array(batch, np.uint32))
        counter.reduce()
        assert all(len(left) <= 2 for (left,) in counter.planes.values())
    want = [sum(w >> s & 1 for b in batches for w in b) for s in range(32)]
    assert counter.totals() == want


# ---- sources -------------------------------------------------------------------


def plain_divergence(rows, least, top):
    docs = [(lang or "", source or "", Counter(x.translate({i: i + 32 for i in range(65, 91)})
             for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in d[2])
        kept = {t for t in df if df[t] >= least}
        by_source = defaultdict(Counter)
        for _, source, terms in own:
            by_source[source].update({t: n for t, n in terms.items() if t in kept})

        def share(counts):
            whole = sum(counts.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // whole for t in kept}

        all_of = share(sum(by_source.values(), Counter()))
        p = {s: share(c) for s, c in by_source.items()}
        for s in p:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o != s]
            terms = [(p[s][t] - all_of[t], t) for t in kept if by_source[s][t] and p[s][t] > all_of[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(found, 1) if part == "pair" or r <= top]
    return sorted(out)


def term_rows():
    words = "the of Émile émile ÀB ab AB x1y don't 日本 ß \U0001f600a zeta Zeta".split()
    rows = [(" ".join(words[(i * j) % len(words)] for j in range(1, 9)) + f" only{'abcdefghij'[i % 10]}",
             ("en", "de", None)[i % 3], (None, "", "web", "code", "ß")[i % 5 if i % 4 else 2]) for i in range(200)]
    return [*rows, (None, "fr", "web"), ("", "fr", "x"), ("\x00a\x7fb[c`d{e", "en", "rare"), *rows[:7] * 3]


@pytest.mark.parametrize("sizes", [{}, {"MERGE": 20, "GIVE": 60, "TOGETHER": 50, "SHARD_ROWS": 9, "SOURCES": 2, "CELLS": 12}])
def test_divergence(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(divergence, name, value)
    rows = term_rows()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3).withColumns(
        {c: F.lit(7) for c in ("term", "n", "docs", "df", "terms", "shard", "part", "item", "value", "rank")})
    got = divergence.audit(docs, least=8, top=5)
    assert got.columns == "lang source part item value rank".split()
    assert sorted(map(tuple, got.collect())) == plain_divergence(rows, 8, 5)


def test_divergence_of_nothing(spark):
    none = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(none).count() == 0
    few = spark.createDataFrame([("a b", "en", "x"), ("c", "en", "y"), (None, "en", "z")], none.schema)
    assert sorted(map(tuple, divergence.audit(few).collect())) == plain_divergence([("a b", "en", "x"), ("c", "en", "y"), (None, "en", "z")], 30, 50)


def test_shares_are_exact():
    counts = np.array([[10**14 + 7, 3], [0, 10**12]])
    totals = np.array([10**14 + 17, 9 * 10**14])
    want = [[1 + 10**9 * (int(c) + 5) // int(t) for c, t in zip(r, totals)] for r in counts]
    assert divergence.shares(counts, totals, 10**9, 5).tolist() == want


# ---- pieces --------------------------------------------------------------------


def test_piece_counts_of_any_text():
    own, model = piececount.PieceCounter(PIECES), SentencePieceProcessor(model_file=PIECES)

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.text("ab éé\n\t▁<s>/語日\x00　. the1😀", max_size=60), max_size=5))
    def check(texts):
        assert own.count(texts) == [len(x) for x in model.encode(texts)]

    check()


def test_remembering_is_bounded():
    own, model = piececount.PieceCounter(PIECES), SentencePieceProcessor(model_file=PIECES)
    own.marked.limit = own.bare.limit = 4000
    texts = [f"word{i} {'y' * 5000}\nline{i}" for i in range(60)]
    assert own.count(texts) == [len(x) for x in model.encode(texts)]
    assert len(own.marked) < 30 and all(len(p) <= piececount.LONGEST for p in [*own.marked, *own.bare])


def plain_merges(symbols, ranks):
    done = 0
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in ranks]
        if not found:
            return done
        i = min(found)[1]
        symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
        done += 1


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=25), st.dictionaries(st.text("abc", min_size=2, max_size=4), st.integers(0, 6)))
def test_merges_by_heap(text, ranks):
    assert piececount.merges(list(text), ranks) == plain_merges(list(text), ranks)


def test_piece_counts(spark, odd_docs, no_docs):
    model = SentencePieceProcessor(model_file=PIECES)
    docs = odd_docs.withColumns({c: F.lit("x") for c in ("n_bytes", "n_tokens", "over_limit")})
    got = piececount.token_counts(docs, PIECES, limit=20)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = []
    for i, text in odd_docs.select("doc_id", "text").collect():
        n = len(model.encode(text or ""))
        want.append((i, len((text or "").encode()), n, n > 20))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert piececount.token_counts(no_docs, PIECES, limit=20).count() == 0
