"""SimHash groups, vector links and paragraph sketches against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
import xxhash

from lectern.llm import simhash, sketch, vecgraph
from lectern.llm.components import components


def smallest(ids, linked):
    """Smallest id reachable, by plain search."""
    out = {}
    for i in sorted(ids):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = i
                todo += linked[x]
    return out


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(i, i + 1) for i in range(100, 160)] + [tuple(map(int, rng.integers(0, 60, 2))) for _ in range(30)] + [(5, 5)]
    linked: dict[int, set] = {}
    for a, b in links:
        linked.setdefault(a, set()).add(b)
        linked.setdefault(b, set()).add(a)
    linked = {k: v - {k} for k, v in linked.items() if v - {k}}
    got = components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()
    assert {r["node"]: r["component"] for r in got} == smallest(linked, linked)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text):
    words = [w.encode() for w in __import__("re").findall("[^\x20\x09-\x0d]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_hash_is_sparks(spark):
    got = spark.sql("select xxhash64('alpha beta gamma')").first()[0]
    assert got % 2**64 == xxhash.xxh64_intdigest("alpha beta gamma", 42)


def test_groups(odd_docs):
    rows = simhash.groups(odd_docs).collect()
    want = sorted((str(d["doc_id"]), f"{fingerprint(d['text']):016x}") for d in odd_docs.collect())
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in rows) == want
    prints = {r["fingerprint"] for r in rows}
    linked = {p: [q for q in prints if (int(p, 16) ^ int(q, 16)).bit_count() <= 2] for p in prints}
    for r in rows:
        todo, seen = [r["fingerprint"]], set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += linked[x]
        ids = [q["doc_id"] for q in rows if q["fingerprint"] in seen and q["doc_id"] is not None]
        assert r["component_id"] == min(ids, default=None)


@pytest.mark.parametrize("bucket", [512, 3])
def test_links_of_close_fingerprints(spark, bucket):
    """Fingerprints around a few centres, so that buckets are full; with a small bound they are cut by the longer key."""
    rng = np.random.default_rng(3)
    prints = set()
    for centre in rng.integers(0, 2**63, 4).tolist():
        for _ in range(120):
            x = centre
            for bit in rng.integers(0, 64, rng.integers(0, 4)).tolist():
                x ^= 1 << bit
            prints.add(x if x < 2**63 else x - 2**64)
    df = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(5)
    got = components(simhash.links(df, 2, bucket)).collect()
    linked = {p: [q for q in prints if q != p and ((p ^ q) % 2**64).bit_count() <= 2] for p in prints}
    linked = {p: v for p, v in linked.items() if v}
    assert {r["node"]: r["component"] for r in got} == smallest(linked, linked)


def test_keep_one(odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    groups = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.groups(odd_docs).collect()}
    rows = kept.collect()
    ids = [(r["doc_id"], f"{fingerprint(r['text']):016x}") for r in rows]
    assert {groups[i] for i in ids} == set(groups.values()) and len(set(ids)) == len(ids)
    assert simhash.keep_one(no_docs).count() == 0


def test_keep_one_row_of_each_group(spark):
    """Null ids, repeated ids and near texts under one id: as many rows are kept as there are groups."""
    a, b = ("".join(f"{w}{i} " for i in range(60)) for w in ("north", "south"))
    c, d, e = ("".join(f"{w}{i} " for i in range(60)) for w in ("east", "west", "up"))
    rows = [(5, a), (3, b), (5, b), (None, c), (None, c), (None, b), (None, d), (None, a), (7, e), (7, e.upper()), (7, e), (8, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r["doc_id"], (r["text"] or "").lower()) for r in simhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(5, a), (3, b), (None, c), (None, d), (7, e), (8, "")], key=str)


def links_of(rows, threshold=0.93):
    n = len(rows)
    out = [set() for _ in range(n)]
    for i in range(n):
        for j in range(n):
            a, b = rows[i], rows[j]
            if i != j and a[2] is not None and a[2] == b[2] and ok(a[1]) and ok(b[1]) and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    out[i].add(j)
    return out


def ok(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


VECTORS = "vec_id long, embedding array<float>, label int, n long, cells string, h string"


def vectors(seed=5, n=260, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = centres[i % 12] + rng.normal(size=dim) * (0.25 if i % 3 else 0.02)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 24 // 12)))
    return [*rows, (900, rows[0][1], rows[0][2]), (901, rows[0][1], rows[0][2]), (901, rows[0][1], rows[0][2]), (902, None, 1),
            (903, [0.0] * dim, 1), (904, [None, *rows[0][1][1:]], 0), (905, [float("nan"), *rows[0][1][1:]], 0),
            (906, [float("inf"), *rows[0][1][1:]], 0), (907, rows[0][1], None), (908, rows[0][1][:3], rows[0][2]), (909, [], 1)]


@pytest.mark.parametrize("small", [False, True])
def test_vector_links(spark, monkeypatch, small):
    if small:  # several shards, sub-shards and blocks of searches
        for name, value in (("SHARD", 30), ("SHARD_MOST", 25), ("BLOCK_QUERIES", 20)):
            monkeypatch.setattr(vecgraph, name, value)
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], VECTORS).repartition(4)
    got = sorted(vecgraph.link_counts(df).collect())
    want = links_of(rows)
    assert len(got) == len(rows)
    counts: dict[int, list[int]] = {}
    for r, w in zip(rows, want, strict=True):
        counts.setdefault(r[0], []).append(len(w))
    assert all(g["n_links"] <= max(counts[g["vec_id"]]) for g in got)
    total = sum(map(len, want))
    assert total > 1000 and sum(g["n_links"] for g in got) >= 0.97 * total
    assert all(g["kept"] == (g["vec_id"] == g["component_id"]) for g in got)
    reach = smallest(range(len(rows)), want)
    first = {}
    for i, r in enumerate(rows):
        first[reach[i]] = min(first.get(reach[i], 10**9), r[0])
    same = sum(first[reach[i]] == g for i, g in zip(range(len(rows)), (next(
        x["component_id"] for x in got if x["vec_id"] == r[0]) for r in rows), strict=True))
    assert same >= 0.98 * len(rows)


def test_links_between_many_shards(spark, monkeypatch):
    """Links whose ends lie in different shards are all counted, at both ends."""
    monkeypatch.setattr(vecgraph, "SHARD", 8)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 4))
    rows = [(i, [float(np.float32(a)) for a in v], 1) for i, v in enumerate(x)]
    want = links_of(rows)
    got = sorted(vecgraph.link_counts(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)).collect())
    assert sum(map(len, want)) > 500
    assert [g["n_links"] for g in got] == [len(w) for w in want]
    first = smallest(range(len(rows)), want)
    assert [g["component_id"] for g in got] == [first[i] for i in range(len(rows))]


def test_audit_sees_rare_links():
    """A few links among many searches without any: the audit goes on until it has compared enough of them."""
    rng = np.random.default_rng(3)
    x = vecgraph.unit(rng.normal(size=(900, 32)))
    x[500:505] = vecgraph.unit(x[100:105] + 0.02 * rng.normal(size=(5, 32)))
    pairs, truth, _ = vecgraph.audited(x, [np.zeros(0, np.int64)] * 900, x, np.arange(900), 0.93)
    assert sum(len(r) for r, _ in pairs) == 910 and truth == 10


def test_no_vectors(spark):
    assert vecgraph.link_counts(spark.createDataFrame([], VECTORS)).count() == 0


def test_graph_search_and_audit():
    rng = np.random.default_rng(2)
    x = vecgraph.unit(rng.normal(size=(300, 6)))
    lists = vecgraph.build(x)
    assert max(map(len, lists)) <= 2 * vecgraph.DEGREE
    pairs, truth, got = vecgraph.audited(x, lists, x, np.arange(300), 0.93)
    found = sum(len(r) for r, _ in pairs)
    assert found >= 0.97 * sum(len(r) for r, _ in vecgraph.exact(x, x, 0.93)) and got <= truth
    # Without a graph the audit fails, and everything is compared.
    bare = [np.zeros(0, np.int64)] * 300
    pairs, _, _ = vecgraph.audited(x, bare, x, np.full(300, -1), 0.93)
    assert sum(len(r) for r, _ in pairs) == sum(len(r) for r, _ in vecgraph.exact(x, x, 0.93))


def lines(text):
    return {x for x in text.split("\n") if x.strip(" ")}


def jaccard(a, b):
    a, b = lines(a), lines(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("groups", [1, 5])
def test_sketches(odd_docs, groups):
    rows = sketch.fingerprint_edits(odd_docs, groups=groups).collect()
    docs = sorted(((d["doc_id"] is not None, d["doc_id"] or 0, d["text"] or "") for d in odd_docs.collect()))
    want, prints = [], {}
    for i, (known, key, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][2]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        want.append((key if known else None, len(text), hashlib.sha256(edited.encode()).hexdigest(),
                     round(jaccard(text, edited), 12), round(jaccard(text, following), 12)))
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 12), round(r["near_next"], 12)) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    by_text = {}
    for d in docs:
        by_text.setdefault((d[0] and d[1], len(d[2])), set()).add(d[2])
    same = [r["fingerprint"] for r in rows if r["doc_id"] in (21, 22)]
    assert len(same) == 2 and same[0] == same[1]


def test_sketch_of_no_or_one_document(spark, no_docs):
    assert sketch.fingerprint_edits(no_docs).count() == 0
    one = sketch.fingerprint_edits(spark.createDataFrame([(3, "a\nb")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def test_peeling_recovers_digests(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a\nb\nc\nd", "a\nc\nx")], "one string, two string").select(
        sketch.paragraphs(F.col("one")).alias("a"), sketch.paragraphs(F.col("two")).alias("b"))
    cells = [sketch.sketch(sketch._signed(F.col(c), 1)) for c in "ab"]
    apart = df.select(sketch.difference(F.col("a"), F.col("b"), *cells).alias("d")).first()["d"]
    h = dict(spark.sql("select x, xxhash64(x) from values ('b'),('d'),('x') as t(x)").collect())
    assert {(r["key"], r["sign"]) for r in apart} == {(h["b"], 1), (h["d"], 1), (h["x"], -1)}
