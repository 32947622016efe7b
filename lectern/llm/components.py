"""Connected components of a graph given as links between long ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import stored

#: Links a task contracts at once; more are taken in several rounds of this size.
CONTRACT_LINKS = 1 << 20


class Forest:
    """Union-find over any ids; the smallest id of a set is its root."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (above := up.get(root, root)) != root:
            root = above
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        low, high = (a, b) if a < b else (b, a)
        self.up[high] = low
        self.up.setdefault(low, low)
        return True

    def links(self):
        return [(x, self.find(x)) for x in self.up if self.find(x) != x]


def _contract(batches):
    """The links of a task as stars around their smallest ids: the same components, fewer and shorter paths."""
    forest, seen = Forest(), 0

    def flush():
        rows = forest.links()
        at = np.array(rows, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1])], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        seen += batch.num_rows
        if seen >= CONTRACT_LINKS:
            yield flush()
            forest, seen = Forest(), 0
    yield flush()


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link the larger (or the smaller and own) neighbours of every node to its smallest neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = F.least("a", "m")
    if large:
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", low.alias("m"))
        return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    down = both.where("b < a")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for the two columns of ``links``: the smallest node each node can reach.

    Large-star and small-star steps by turns, until every node hangs on its
    smallest one. Only nodes with a link have a row. Steps are written to the
    shared folder, so that no step depends on an executor.
    """
    a, b = links.columns
    rows = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a != b")
    rows = stored(rows.mapInArrow(_contract, "a long, b long"), "links")
    last = None
    while True:
        mark = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not mark["n"] or (mark["n"], mark["h"]) == last:
            break
        last = (mark["n"], mark["h"])
        rows = stored(_star(_star(rows, True), False), "links")
    roots = rows.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return rows.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
