"""Near-duplicate vectors by a robust-pruned flat graph, within equal labels.

Equal vectors are one class, counted once. Classes go to overlapping shards around
centroids: each is indexed in its ``HOMES`` nearest shards. There vectors are inserted one group after the other: each
is searched for in the graph so far, what the search meets is pruned robustly (a neighbour is left out if a nearer one lies
much closer to it), and links back are pruned too; a second round does the same with the whole graph. A vector's
lists from all its shards are united and pruned again into one flat graph.

Searches go to the shards of a vector's nearest centroids. How many, an audit of each label says: ``ROUTED`` vectors are
compared with all others, and searches go to as many shards as it takes to meet every link of theirs in a home of the vector
that is found. So the work of a search does not grow with the number of shards. A link that may be met in two shards is
counted in one. A search
starts at the shard's medoids and the vector's own place, follows the graph greedily with a beam, then widens through everything in range. Hits
are verified in double precision. Each shard audits ``AUDIT`` searches against all its vectors, at the threshold or, where
these have fewer than ``AUDIT_LINKS`` links, at the lower one that has as many pairs; below ``RECALL`` it searches with a
wider beam, and at last compares all in blocks.

Shards of more than ``SHARD_MOST`` vectors are dealt out to several graphs, all
of which are searched; many searches in one shard go in blocks. So no task holds
more than a bounded number of vectors, and no links are written out in pairs: only their counts
and a spanning forest of each shard.

Defined cases: vectors that are null, zero, or hold null or non-finite numbers, and those with a null label,
link with nothing; only vectors of equal length are compared; equal rows link with each other and count one by one;
rows with a null id count, but never name a component; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm.common import stored
from lectern.llm.components import Forest, components

THRESHOLD = 0.93
SHARD = 400
SHARD_MOST = 4000
BLOCK_QUERIES = 8000
#: Vectors from which centroids are fitted, and centroids, at most; more vectors make larger shards, which are dealt out.
SAMPLE = 40_000
CENTROIDS = 8192
#: Vectors compared with all others to learn how many shards a search needs, about.
ROUTED = 2000
DEGREE = 16
POOL = 32
ALPHA = 1.2
BEAM = 16
MEDOIDS = 8
MARGIN = 0.03
#: Searches audited, and pairs that they hold at least.
AUDIT = 64
AUDIT_LINKS = 400
#: Shards that index a vector; vectors that a graph begins with, and those inserted at a time.
HOMES = 2
FIRST = 64
INSERTED = 1024
RECALL = 0.995
TOGETHER = 256
#: What rounding may add to a bound.
SLACK = 1e-9


def unit(rows) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in rows])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_centroids(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from evenly spread rows."""
    k = min(k, len(x))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds if k > 1 else 0):
        near = np.concatenate([(x[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def prune(x: np.ndarray, own: np.ndarray, pool: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning of candidates, nearest first (-1: none): up to ``degree`` for each vector of ``own``."""
    out = np.full((len(own), degree), -1, np.int64)
    alive = pool >= 0
    vectors = x[np.maximum(pool, 0)]
    far = 2 - 2 * np.einsum("nd,ncd->nc", x[own], vectors)
    rows = np.arange(len(own))
    for step in range(degree):
        pick = alive.argmax(1)
        some = alive[rows, pick]
        if not some.any():
            break
        out[some, step] = pool[rows, pick][some]
        between = 2 - 2 * np.einsum("nd,ncd->nc", vectors[rows, pick], vectors)
        alive &= alpha * between > far
        alive[rows, pick] = False
    return out


def nearest_first(x: np.ndarray, own: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Candidates (-1: none) without the vector itself and without repeats, nearest first."""
    pool = np.where(pool == own[:, None], -1, np.sort(pool, 1))
    pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
    sims = np.where(pool >= 0, np.einsum("nd,ncd->nc", x[own], x[np.maximum(pool, 0)]), -3)
    return np.take_along_axis(pool, np.argsort(-sims, axis=1, kind="stable"), 1)


def insert(x: np.ndarray, table: np.ndarray, own: np.ndarray, pool: np.ndarray) -> None:
    """Give vectors their pruned candidates as neighbours, and these a link back; full lists are pruned again."""
    for a in range(0, len(own), TOGETHER):
        some = own[a : a + TOGETHER]
        both = nearest_first(x, some, np.concatenate([pool[a : a + TOGETHER], table[some]], 1))
        table[some] = -1
        table[some, :DEGREE] = prune(x, some, both)
    to, frm = table[own, :DEGREE].ravel(), np.repeat(own, DEGREE)
    order = np.argsort(to, kind="stable")
    to, frm = to[order], frm[order]
    to, frm = to[np.searchsorted(to, 0) :], frm[np.searchsorted(to, 0) :]
    nodes, first, counts = np.unique(to, return_index=True, return_counts=True)
    width = table.shape[1]
    for a in range(0, len(nodes), TOGETHER):
        some, n = nodes[a : a + TOGETHER], np.minimum(counts[a : a + TOGETHER], 4 * width)
        back = np.full((len(some), int(n.max())), -1, np.int64)
        at = np.arange(back.shape[1])
        has = at < n[:, None]
        back[has] = frm[(first[a : a + TOGETHER, None] + at)[has]]
        both = nearest_first(x, some, np.concatenate([table[some], back], 1))
        full = (both >= 0).sum(1) > width
        fitted = both[:, :width] if both.shape[1] >= width else np.pad(both, ((0, 0), (0, width - both.shape[1])), constant_values=-1)
        if full.any():
            fitted[full] = prune(x, some[full], both[full], width)
        table[some] = fitted


def build(x: np.ndarray) -> list[np.ndarray]:
    """Neighbour lists of one shard by greedy insertion in a fixed random order, then once more for every vector."""
    n = len(x)
    table = np.full((n, 2 * DEGREE), -1, np.int64)
    order = np.random.default_rng(n).permutation(n)
    head = order[:FIRST]
    insert(x, table, head, np.broadcast_to(head, (len(head), len(head))).copy())
    at, start = len(head), head[:MEDOIDS]
    while at < n:
        own = order[at : at + min(at, INSERTED)]
        insert(x, table, own, beam_search(x, table, x[own], start, None, POOL)[0])
        at += len(own)
    start = medoids(x)
    for a in range(0, n if n > FIRST else 0, INSERTED):
        own = order[a : a + INSERTED]
        insert(x, table, own, beam_search(x, table, x[own], start, own, POOL)[0])
    return [row[row >= 0] for row in table]


def united(x: np.ndarray, lists: list[np.ndarray]) -> list[np.ndarray]:
    """Lists that came from several shards, pruned again."""
    table = table_of(lists)
    out = []
    for a in range(0, len(x), TOGETHER):
        own = np.arange(a, min(a + TOGETHER, len(x)))
        out.append(prune(x, own, nearest_first(x, own, table[own]), 2 * DEGREE))
    return [row[row >= 0] for row in np.concatenate(out)] if out else []


def medoids(x: np.ndarray, count: int = MEDOIDS) -> np.ndarray:
    """The vector nearest to the mean, then those farthest from all chosen before."""
    chosen = [int((x @ x.mean(0)).argmax())]
    near = x @ x[chosen[0]]
    while len(chosen) < min(count, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return np.array(chosen)


def table_of(lists: list[np.ndarray]) -> np.ndarray:
    wide = max((len(a) for a in lists), default=0)
    out = np.full((len(lists), max(wide, 1)), -1, np.int64)
    for i, a in enumerate(lists):
        out[i, : len(a)] = a
    return out


def beam_search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, own: np.ndarray | None, beam: int):
    """The nearest vectors that greedy searches find, ``beam`` for each query (-1: none), and all pairs they looked at."""
    out, looked = [], []
    for a in range(0, len(queries), TOGETHER):
        ids, sims, _, r, v, _ = _greedy(x, links, queries[a : a + TOGETHER], start, None if own is None else own[a : a + TOGETHER], beam)
        ids = np.where(sims > -3, ids, -1)[:, :beam]
        out.append(np.pad(ids, ((0, 0), (0, beam - ids.shape[1])), constant_values=-1))
        looked.append((r + a, v))
    return np.concatenate(out) if out else np.zeros((0, beam), np.int64), looked


def _greedy(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, own: np.ndarray | None, beam: int):
    """One block of greedy searches: the beams and their cosines, the vectors seen, and the pairs looked at with theirs."""
    m, n = len(q), len(x)
    seen = np.zeros((m, n), bool)
    rows = np.arange(m)
    places = np.full((m, 1), -1) if own is None else own[:, None]
    ids = np.concatenate([np.broadcast_to(start, (m, len(start))), places], 1)
    ids = np.where(ids < 0, start[0], ids)
    seen[rows[:, None], ids] = True
    sims = np.einsum("md,mkd->mk", q, x[ids])
    # The own place may be one of the starts: a place twice in the beam is harmless but counted once.
    sims[:, -1] = np.where((ids[:, :-1] == ids[:, -1:]).any(1), -3, sims[:, -1])
    open_ = sims > -3
    r, c = np.nonzero(open_)
    looked = [(r, ids[r, c], sims[r, c])]
    while True:
        best = np.where(open_, sims, -4).argmax(1)
        act = np.flatnonzero(open_[rows, best] & (sims[rows, best] > -3))
        if not len(act):
            break
        node = ids[act, best[act]]
        open_[act, best[act]] = False
        nbr = links[node]
        fresh = (nbr >= 0) & ~seen[act[:, None], np.maximum(nbr, 0)]
        r, c = np.nonzero(fresh)
        v = nbr[r, c]
        seen[act[r], v] = True
        s = np.einsum("kd,kd->k", q[act[r]], x[v])
        looked.append((act[r], v, s))
        new_s = np.full(nbr.shape, -3.0)
        new_s[r, c] = s
        all_i, all_s = np.concatenate([ids[act], np.maximum(nbr, 0)], 1), np.concatenate([sims[act], new_s], 1)
        all_o = np.concatenate([open_[act], new_s > -3], 1)
        keep = min(beam, all_s.shape[1])
        top = np.argpartition(-all_s, keep - 1, axis=1)[:, :keep]
        pad = keep - ids.shape[1]
        if pad > 0:
            ids, sims, open_ = (np.pad(ids, ((0, 0), (0, pad))), np.pad(sims, ((0, 0), (0, pad)), constant_values=-3),
                                np.pad(open_, ((0, 0), (0, pad))))
        ids[act[:, None], np.arange(keep)] = np.take_along_axis(all_i, top, 1)
        sims[act[:, None], np.arange(keep)] = np.take_along_axis(all_s, top, 1)
        open_[act[:, None], np.arange(keep)] = np.take_along_axis(all_o, top, 1)
        if ids.shape[1] > keep:
            sims[act, keep:], open_[act, keep:] = -3, False
    r, v, s = (np.concatenate(column) for column in zip(*looked, strict=True))
    return ids, sims, seen, r, v, s


def search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, own: np.ndarray, threshold: float,
           beam: int = BEAM) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, vector) within range, block by block. ``own`` is a query's own place among the vectors, or -1."""
    found = []
    n = len(x)
    for a in range(0, len(queries), TOGETHER):
        q = queries[a : a + TOGETHER]
        _, _, seen, r, v, s = _greedy(x, links, q, start, own[a : a + TOGETHER], beam)
        near = s >= threshold - MARGIN
        r, v = r[near], v[near]
        # Widen: neighbours of everything in range, until nothing new is.
        all_r, all_v = [r], [v]
        while len(r):
            nbr = links[v]
            rr, vv = np.repeat(r, nbr.shape[1]), nbr.ravel()
            ok = vv >= 0
            rr, vv = rr[ok], vv[ok]
            ok = ~seen[rr, vv]
            key = np.unique(rr[ok] * n + vv[ok])
            rr, vv = key // n, key % n
            seen[rr, vv] = True
            s = np.concatenate([np.einsum("kd,kd->k", q[rr[b : b + 65536]], x[vv[b : b + 65536]])
                                for b in range(0, len(rr), 65536)]) if len(rr) else np.zeros(0)
            hit = s >= threshold - MARGIN
            r, v = rr[hit], vv[hit]
            all_r.append(r)
            all_v.append(v)
        r, v = np.concatenate(all_r), np.concatenate(all_v)
        s = np.concatenate([np.einsum("kd,kd->k", q[r[b : b + 65536]], x[v[b : b + 65536]])
                            for b in range(0, len(r), 65536)]) if len(r) else np.zeros(0)
        found.append((r[s >= threshold] + a, v[s >= threshold]))
    return found


def exact(x: np.ndarray, queries: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same pairs by comparing all, in blocks."""
    out = []
    for a in range(0, len(queries), TOGETHER):
        r, v = np.nonzero(queries[a : a + TOGETHER] @ x.T >= threshold)
        out.append((r + a, v))
    return out


def audited(x, lists, queries, own, threshold, audit=AUDIT, recall=RECALL):
    """Pairs of a shard, and of the audited queries, or of all where all were compared, how many pairs there are and how many
    were found."""
    sample = np.random.default_rng(len(queries)).permutation(len(queries))[:audit]
    sims = queries[sample] @ x.T
    placed = np.flatnonzero(own[sample] >= 0)
    sims[placed, own[sample][placed]] = -3
    some = np.sort(sims[sims > -3])
    if not len(some):
        return exact(x, queries, threshold), 0, 0
    least = min(threshold, some[-min(len(some), AUDIT_LINKS)])
    truth = int((some >= least).sum())
    links = table_of(lists)
    beam, starts = BEAM, MEDOIDS
    for _ in range(3):
        start = medoids(x, starts)
        got = sum(int((v != own[sample][r]).sum()) for r, v in search(x, links, queries[sample], start, own[sample], least, beam))
        if got >= recall * truth:
            return search(x, links, queries, start, own, threshold, beam), truth, got
        beam, starts = beam * 3, starts * 3
    pairs = exact(x, queries, threshold)
    truth = sum(int((v != own[r]).sum()) for r, v in pairs)
    return pairs, truth, truth


def _both_ways(pairs, ids: np.ndarray, asking_ids: np.ndarray):
    """The pairs, and those of two vectors that both ask here the other way round, each once."""
    if not pairs:
        return pairs
    r, v = (np.concatenate(column) for column in zip(*pairs, strict=True))
    if not len(r):
        return []
    # Where the found vector is among those asking, and the asking one among those found.
    as_query = np.searchsorted(asking_ids, ids[v]).clip(max=len(asking_ids) - 1)
    as_point = np.searchsorted(ids, asking_ids[r]).clip(max=len(ids) - 1)
    back = (asking_ids[as_query] == ids[v]) & (ids[as_point] == asking_ids[r])
    key = np.unique(np.concatenate([r * len(ids) + v, as_query[back] * len(ids) + as_point[back]]))
    return [(key // len(ids), key % len(ids))]


def by_cell(batch: pa.RecordBatch, label: int, vector: int):
    """Rows of a batch by label and length of the vector: the places of the rows, and their unit vectors."""
    groups: dict = {}
    vectors = batch.column(vector).to_pylist()
    for i, (lab, v) in enumerate(zip(batch.column(label).to_pylist(), vectors, strict=True)):
        groups.setdefault((lab, len(v)), []).append(i)
    for cell, rows in groups.items():
        for a in range(0, len(rows), INSERTED):
            some = rows[a : a + INSERTED]
            yield cell, some, unit([vectors[i] for i in some])


def nearest(c: np.ndarray, x: np.ndarray, count: int) -> np.ndarray:
    """The places of the ``count`` nearest centroids of each vector, nearest first."""
    sims = x @ c.T
    count = min(count, len(c))
    top = np.argpartition(-sims, count - 1, axis=1)[:, :count]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable"), 1)


def _fit_to_link() -> Column:
    """True for rows whose vector ``v`` and label can link at all."""
    finite = F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))


def _probes(placed: DataFrame, model: dict, total: int, threshold: float, audit: str | None) -> dict:
    """How many shards a search of each label and length goes to: enough for every link of the audited vectors.

    About ``ROUTED`` vectors, chosen by hash, are compared with all others; only counts come back.
    """
    share = max(1, -(-total // ROUTED))
    chosen: dict = {}
    for r in placed.where(F.pmod(F.xxhash64("id", F.lit("routed")), F.lit(share)) == 0).select("id", "label", "v").collect():
        chosen.setdefault((r["label"], len(r["v"])), []).append((r["id"], r["v"]))
    cells = {}
    for cell, rows in chosen.items():
        x = unit([v for _, v in rows])
        order = nearest(model[cell][0], x, len(model[cell][0]))
        place = np.empty_like(order, np.int32)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1], dtype=np.int32), order.shape), 1)
        cells[cell] = (len(cells), np.array([i for i, _ in rows]), x, place)

    def needed(batches):
        for b in batches:
            keys, found = b.column(0).to_numpy(), {}
            homes = b.column(3).to_pylist()
            for cell, rows, x in by_cell(b, 1, 2):
                if cell not in cells:
                    continue
                number, ids, own, place = cells[cell]
                q, v = np.nonzero((own @ x.T >= threshold) & (ids[:, None] != keys[rows]))
                at = np.array([homes[i] for i in rows], np.int64)[v] - model[cell][1]
                least = place[q[:, None], at].min(1) + 1 if len(q) else np.zeros(0, np.int64)
                for p, n in zip(*np.unique(least, return_counts=True), strict=True):
                    found[number, int(p)] = found.get((number, int(p)), 0) + int(n)
            yield pa.RecordBatch.from_pylist([{"cell": c, "probes": p, "n": n} for (c, p), n in found.items()],
                                             schema=pa.schema([("cell", pa.int32()), ("probes", pa.int32()), ("n", pa.int64())]))

    counted = placed.select("id", "label", "v", "homes").mapInArrow(needed, "cell int, probes int, n long").groupBy("cell", "probes").agg(
        F.sum("n").alias("n")).collect()
    number = {c: cell for cell, (c, *_) in cells.items()}
    out: dict = {}
    for r in counted:
        out[number[r["cell"]]] = max(out.get(number[r["cell"]], HOMES), r["probes"])
    if audit:
        links = sum(r["n"] for r in counted)
        placed.sparkSession.createDataFrame([("routing", links, links, max(out.values(), default=HOMES))],
                                            "kind string, audited long, met long, probes int").write.mode("append").parquet(audit)
    return out


def link_counts(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding",
                label: str = "label", audit: str | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. What the shards' audits compared and found goes to ``audit``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    rows = rows.withColumn("h", F.xxhash64("label", "v"))
    valid = rows.where(_fit_to_link())
    same = ["h", "label", "v"]
    classes = stored(valid.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
                     .withColumn("id", F.coalesce("rep", "h")), "classes")
    sizes = classes.groupBy("label", F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()
    total = sum(r["n"] for r in sizes)
    # The sample is taken by hash; its expected size is bounded by SAMPLE.
    share = max(1, -(-total // SAMPLE))
    some = classes.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(share)) == 0).select("label", "v").collect()
    by: dict = {}
    for r in some:
        by.setdefault((r["label"], len(r["v"])), []).append(r["v"])
    model, base = {}, 0
    for r in sorted(sizes, key=lambda r: (str(r["label"]), r["dim"])):
        cell = (r["label"], r["dim"])
        k = max(1, min(round(r["n"] / SHARD), max(1, CENTROIDS * r["n"] // total)))
        x = unit(by[cell]) if cell in by else np.eye(1, r["dim"])
        model[cell] = (fit_centroids(x, k), base)
        base += len(model[cell][0])

    def assign(batches):
        for b in batches:
            homes = [None] * b.num_rows
            for cell, rows, x in by_cell(b, 1, 2):
                c, first = model[cell]
                for i, own in zip(rows, (first + nearest(c, x, HOMES)).tolist(), strict=True):
                    homes[i] = own
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(homes, pa.list_(pa.int32()))], ["id", "label", "v", "copies", "homes"])

    kinds = dict(classes.dtypes)
    placed = stored(classes.select("id", "label", "v", "copies").mapInArrow(
        assign, f"id long, label {kinds['label']}, v {kinds['v']}, copies long, homes array<int>"), "placed")
    probes = _probes(placed, model, total, threshold, audit)

    def ask(batches):
        for b in batches:
            cells = [None] * b.num_rows
            for cell, rows, x in by_cell(b, 1, 2):
                c, first = model[cell]
                for i, own in zip(rows, (first + nearest(c, x, probes.get(cell, HOMES))).tolist(), strict=True):
                    cells[i] = own
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(cells, pa.list_(pa.int32()))],
                                             ["id", "v", "copies", "cells"])

    indexed = placed.select("id", "v", "copies", F.explode("homes").alias("cell"), "homes")
    held = {r["cell"]: r["n"] for r in indexed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    asked = stored(placed.select("id", "label", "v", "copies").mapInArrow(
        ask, f"id long, v {kinds['v']}, copies long, cells array<int>"), "asked").select("id", "v", "copies", F.explode("cells").alias("cell"), F.col("cells").alias("homes"))
    asking = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(
        [(c, -(-held.get(c, 0) // SHARD_MOST) or 1, -(-asking.get(c, 0) // BLOCK_QUERIES)) for c in sorted({*held, *asking})],
        "cell int, subs int, blocks int")
    spread = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    shards = (indexed.join(F.broadcast(plan), "cell").withColumn("sub", spread("sub", "subs")))

    def graph(_, pdf):
        pdf = pdf.sort_values("id")
        ids = pdf["id"].to_numpy()
        lists = build(unit(pdf["v"]))
        return pd.DataFrame({"id": ids, "near": [ids[a].tolist() for a in lists]})

    edges = stored(shards.groupBy("cell", "sub").applyInPandas(graph, "id long, near array<long>"), "adjacency")
    # A vector has a list in each of its homes: one flat graph, in which a list holds neighbours from all of them.
    flat = edges.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    points = shards.where("blocks > 0").join(flat, "id").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asks = (asked.join(F.broadcast(plan), "cell").withColumn("block", spread("block", "blocks"))
            .withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))))
    columns = ["cell", "sub", "block", "id", "v", "copies", "near", "homes"]
    none = F.lit(None).cast("array<long>")
    both = points.select(*columns, F.lit(True).alias("point")).unionByName(
        asks.withColumn("near", none).select(*columns, F.lit(False).alias("point")))

    def find(_, pdf):
        pts, qs = pdf[pdf["point"]].sort_values("id"), pdf[~pdf["point"]].sort_values("id")
        out = {"id": [], "other": [], "n": [], "audited": [], "met": []}
        if len(pts) and len(qs):
            ids, asking_ids = pts["id"].to_numpy(), qs["id"].to_numpy()
            x, q = unit(pts["v"]), unit(qs["v"])
            lists = []
            for near in pts["near"]:
                at = np.searchsorted(ids, near)
                at = np.minimum(at, len(ids) - 1)
                lists.append(at[ids[at] == np.asarray(near)])
            own = np.searchsorted(ids, asking_ids).clip(max=len(ids) - 1)
            own = np.where(ids[own] == asking_ids, own, -1)
            pairs, truth, met = audited(x, united(x, lists), q, own, threshold)
            copies, own_cell = pts["copies"].to_numpy(), pts["cell"].iloc[0]
            # Only a search that does not go to a vector's first home counts it in the second.
            firsts, tried = np.array([h[0] for h in pts["homes"]]), [frozenset(h) for h in qs["homes"]]
            pairs = _both_ways(pairs, ids, asking_ids)
            forest = Forest()
            counts = np.zeros(len(q), np.int64)
            for r, v in pairs:
                keep = (ids[v] != asking_ids[r]) & np.fromiter(
                    (f == own_cell or f not in tried[q] for f, q in zip(firsts[v].tolist(), r.tolist(), strict=True)), bool, len(r))
                r, v = r[keep], v[keep]
                counts += np.bincount(r, copies[v], len(q)).astype(np.int64)
                for a, b in zip(asking_ids[r].tolist(), ids[v].tolist(), strict=True):
                    forest.join(a, b)
            some = np.flatnonzero(counts)
            links = forest.links()
            out["id"] = [*asking_ids[some], *(a for a, _ in links), None]
            out["other"] = [None] * len(some) + [b for _, b in links] + [None]
            out["n"] = [*counts[some], *[None] * len(links), None]
            out["audited"] = [None] * (len(out["id"]) - 1) + [truth]
            out["met"] = [None] * (len(out["id"]) - 1) + [met]
        return pd.DataFrame({c: pd.array(v, "Int64") for c, v in out.items()})

    said = stored(both.groupBy("cell", "sub", "block").applyInPandas(
        find, "id long, other long, n long, audited long, met long"), "found")
    if audit:
        said.where("audited is not null").select(F.lit("graph").alias("kind"), "audited", "met").write.mode("append").parquet(audit)
    counts = said.where("n is not null").groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(said.where("other is not null").select("id", "other")).withColumnRenamed("node", "id")
    firsts = (classes.join(roots, "id", "left").withColumn("root", F.coalesce("component", "id")))
    least = firsts.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = firsts.join(least, "root").join(counts, "id", "left").select(
        *same, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = valid.join(known, same).select("vec_id", "n_links", "component_id")
    alone = rows.where(~_fit_to_link()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("vec_id").isNull() & F.col("component_id").isNull()))

