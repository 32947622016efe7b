"""How far the sources of a language differ in their terms, in exact integers.

Tasks turn batches of texts into counts by Arrow kernels alone: ASCII lower case, a
split by pattern, a dictionary of the terms, then hash grouping, first by document and
term, then by language, source and term. A task merges its partial counts as it goes
and gives them away when they grow long. Spark adds them up by language and term, so
that no language or source, however large, is one task's, and keeps the terms that
enough documents of the language have.

The kept terms are dealt into columnar shards by language and hash. A shard holds the
counts of its terms by source, computes every source's share of each term, and gives
the sums of differences between sources, and the best terms of each source among its
own; the sums are added and the best ranked over all shards.

A share is 1 + floor(scale * (count + smooth) / (total + smooth * terms)), the division done
digit by digit in 64-bit integers, exact while totals stay below nine quadrillion.

Defined results: nulls in text, language or source count as empty strings, which are
a language and a source like others. Rows that repeat are documents of their own. A language with no kept
term has differences of 0 and no terms. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from lectern.llm.common import slices, stored

#: What stands between terms: every ASCII character but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
#: Bytes of text that go through the kernels at a time; one longer text goes alone.
TOGETHER = 4 << 20
#: Partial counts after which a task merges them, and beyond which merged ones are given away.
MERGE, GIVE = 400_000, 600_000
#: Rows of a shard, about, and sources that are compared with all others at a time.
SHARD_ROWS, SOURCES = 200_000, 256
#: Shares held at a time.
CELLS = 1 << 20

KEYS = ["lang", "source", "term"]
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def batch_counts(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.Table:
    """Occurrences ``n`` of each term and documents ``docs`` with it, by language and source."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    rows, terms = pc.list_parent_indices(lists), pc.list_flatten(lists)
    some = pc.greater(pc.binary_length(terms), 0)
    coded = pc.dictionary_encode(terms.filter(some))
    per_row = pa.table({"row": rows.filter(some), "code": coded.indices}).group_by(["row", "code"]).aggregate([([], "count_all")])
    groups = pa.table({"lang": langs, "source": sources, "row": pa.array(range(len(texts)), pa.int64())})
    named = groups.group_by(["lang", "source"]).aggregate([("row", "list")])
    code_of = np.zeros(len(texts), np.int64)
    code_of[pc.list_flatten(named["row_list"]).to_numpy()] = pc.list_parent_indices(named["row_list"]).to_numpy()
    per_group = pa.table({"group": code_of[per_row["row"].to_numpy()], "code": per_row["code"], "n": per_row["count_all"]}).group_by(
        ["group", "code"]).aggregate([("n", "sum"), ("n", "count")])
    group = per_group["group"]
    return pa.table([named["lang"].take(group), named["source"].take(group), coded.dictionary.take(per_group["code"]),
                     per_group["n_sum"], per_group["n_count"]], schema=COUNTS)


def merged(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(KEYS).aggregate([("n", "sum"), ("docs", "sum")])
    return out.select([*KEYS, "n_sum", "docs_sum"]).rename_columns(COUNTS.names)


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[pa.Table] = []
    size = 0
    for batch in batches:
        for piece in slices(batch, 2, TOGETHER):
            waiting.append(batch_counts(*piece.columns))
            size += waiting[-1].num_rows
            if size > MERGE:
                waiting = [merged(waiting)]
                if waiting[0].num_rows > GIVE // 2:
                    yield from waiting[0].to_batches(max_chunksize=100_000)
                    waiting = []
                size = sum(t.num_rows for t in waiting)
    if waiting:
        yield from merged(waiting).to_batches(max_chunksize=100_000)


def term_counts(docs: DataFrame, least: int) -> DataFrame:
    """``lang``, ``term``, ``source``, ``n``: the kept terms and their occurrences in each source that has them."""
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    partial = rows.mapInArrow(partial_counts, "lang string, source string, term string, n bigint, docs bigint")
    dealt = partial.repartition("lang", "term")
    added = dealt.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # Both groupings keep the partitioning by language and term.
    found = added.withColumn("df", F.sum("docs").over(Window.partitionBy("lang", "term")))
    return found.where(F.col("df") >= least).select("lang", "term", "source", "n")


def shares(counts: np.ndarray, totals: np.ndarray, scale: int, smooth: int) -> np.ndarray:
    """The shares of counts (terms by groups), given each group's total with all smoothing added."""
    digits = len(str(scale)) - 1
    if 10**digits != scale or digits % 3:
        raise ValueError("the scale must be a power of 1000")
    rest = counts + smooth
    out = np.zeros_like(rest)
    for _ in range(digits // 3):
        q, rest = np.divmod(rest * 1000, totals)
        out = out * 1000 + q
    return out + 1


def compare(shard: pa.Table, top: int, scale: int, smooth: int) -> Iterator[pa.RecordBatch]:
    """Rows ``source, part, item, value`` of one shard: differences of each source to all others, and its best terms.

    Goes by blocks of sources and, in each, by blocks of terms, so that memory is bounded by the shard's own rows.
    """
    known = pc.is_valid(shard["term"])
    groups, cells = shard.filter(pc.invert(known)).sort_by("source"), shard.filter(known)
    names = groups["source"].to_pylist()
    size = len(names)
    terms = pc.dictionary_encode(cells["term"].combine_chunks())
    order = np.array(pc.array_sort_indices(pc.cast(terms.dictionary, pa.binary())))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    row = place[terms.indices.to_numpy()]
    by_row = np.argsort(row, kind="stable")
    row = row[by_row]
    column = pc.index_in(cells["source"], groups["source"].combine_chunks()).to_numpy()[by_row]
    n = cells["n"].to_numpy()[by_row]
    given = groups["n"].to_numpy() + smooth * groups["terms"].to_numpy()
    whole = np.array([groups["n"].to_numpy().sum() + smooth * groups["terms"].to_numpy()[0]])
    step = max(1, CELLS // size)
    for first in range(0, size, SOURCES):
        block = range(first, min(first + SOURCES, size))
        apart = np.zeros((len(block), size), np.int64)
        best: list[list[tuple[np.ndarray, np.ndarray]]] = [[(np.zeros(0, np.int64),) * 2] for _ in block]
        for start in range(0, len(order), step):
            end = min(start + step, len(order))
            a, b = np.searchsorted(row, [start, end])
            counts = np.zeros((end - start, size), np.int64)
            counts[row[a:b] - start, column[a:b]] = n[a:b]
            p = shares(counts, given, scale, smooth)
            q = shares(counts.sum(1, keepdims=True), whole, scale, smooth)[:, 0]
            for i, j in enumerate(block):
                own = p[:, j]
                apart[i] += np.abs(p - own[:, None]).sum(0)
                above = np.flatnonzero((counts[:, j] > 0) & (own > q))
                value = (own - q)[above]
                # Terms are in order, so a stable sort leaves equal values in it.
                chosen = np.argsort(-value, kind="stable")[:top]
                best[i].append((value[chosen], above[chosen] + start))
        sources, parts, items, values = [], [], [], []
        for i, j in enumerate(block):
            others = [x for x in range(size) if x != j]
            value, found = (np.concatenate(x) for x in zip(*best[i], strict=True))
            chosen = np.argsort(-value, kind="stable")[:top]
            sources += [names[j]] * (len(others) + len(chosen))
            parts += ["pair"] * len(others) + ["term"] * len(chosen)
            items += [names[x] for x in others] + terms.dictionary.take(pa.array(order[found[chosen]])).to_pylist()
            values += [*apart[i][others].tolist(), *value[chosen].tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(sources, pa.string()), pa.array(parts, pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())],
            ["source", "part", "item", "value"])


def audit(docs: DataFrame, least: int = 30, top: int = 50, scale: int = SCALE, smooth: int = 5) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.

    Part ``pair``: each other source of the language and the sum of the differences of
    shares over all kept terms. Part ``term``: the ``top`` terms whose share lies furthest
    above that of the whole language.
    """
    spark = docs.sparkSession
    kept = stored(term_counts(docs, least), "terms")
    names = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    held = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("terms"))
    zero = F.lit(0).cast("bigint")
    groups = stored(names.join(held, ["lang", "source"], "left").join(sizes, "lang", "left").select(
        "lang", "source", F.coalesce("n", zero).alias("n"), F.coalesce("terms", zero).alias("terms")), "groups")

    shards = max(1, -(-kept.count() // SHARD_ROWS))
    cells = kept.select("lang", "term", "source", "n", F.lit(None).cast("bigint").alias("terms"),
                        F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"))
    copies = groups.select("lang", F.lit(None).cast("string").alias("term"), "source", "n", "terms",
                           F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def work(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang = key[0].as_py()
        for out in compare(pa.Table.from_batches(batches), top, scale, smooth):
            yield out.add_column(0, "lang", pa.array([lang] * out.num_rows, pa.string()))

    found = cells.unionByName(copies).groupBy("lang", "shard").applyInArrow(
        work, "lang string, source string, part string, item string, value bigint")
    found = stored(found, "found")
    own = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = pairs.withColumn("rank", F.row_number().over(own))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top)
    return ranked.unionByName(terms)
