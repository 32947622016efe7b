"""How filters interact: survivors of every subset of filters, and of every order in which they may run.

Five conditions are found for each document. With them it becomes a 32-bit word
whose bit S says whether the document outlives the subset S of the filters: the
truth table of "no filter in S fails". Tasks add up the words of each part by a carry-save
adder (three words of one weight become a sum word and a carry word of twice the weight), for all
documents and for those of either label, and count the set bits of every position
in what is left. Every figure of the audit follows from these 32 counts.

Texts are read once; what is kept of a document is its id, its part, the digest of
its text and four bits. Whether a smaller id has the same text is found by a join
on digest and id together, so that a text with very many copies meets no single task.

Defined results: null texts count as empty and equal to empty ones, a null source is the part of the
empty string. A null id is smaller than no other and equal to none, so its row is never a copy and has
no label. Rows equal in id and text are not copies of each other; each counts. Of repeated labels of an
id, one with 1 is enough. A table without rows gives no rows. Other columns are not read.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm.common import stored
from lectern.operators.skew import skewed_join

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: White space between words, as a Java pattern.
BETWEEN = r"[\x20\x09-\x0D]+"
MARKS = "[#$%&*|]"
#: A task gives away what it has counted when it holds this many parts.
PARTS = 2000
#: Words of one weight that wait for the adder.
WAITING = 1 << 14


def failures(text: Column, words: Column) -> list[Column]:
    """Conditions A to D of a text and its words."""
    n = F.size(words)
    return [n < 200,
            100 * F.size(F.array_distinct(words)) < 50 * n,
            100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
            text.rlike(MARKS)]


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``part``, ``digest`` of the text and ``fails``, the bits of conditions A to D."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"),
                       F.array_remove(F.split(text, BETWEEN), "").alias("words"))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures(F.col("text"), F.col("words")))]
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), reduce(Column.__add__, bits).alias("fails"))


def truth_word(fails: Column) -> Column:
    """The 32-bit word of the subsets that hold none of the failing filters."""
    everything = (1 << SUBSETS) - 1
    word = F.lit(everything).cast("bigint")
    for i in range(len(FILTERS)):
        without = sum(1 << s for s in range(SUBSETS) if not s >> i & 1)
        word = word.bitwiseAND(F.when(fails.bitwiseAND(F.lit(1 << i)) > 0, without).otherwise(everything).cast("bigint"))
    return word


def words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``word`` and the labels ``good`` and ``toxic`` of every document."""
    rows = stored(judged(docs), "judged")
    # One row per text: the smallest id that has it. Rows of that id are no copies, all others are.
    firsts = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = skewed_join(rows, firsts, ["doc_id", "digest"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    marked = known.select("doc_id", "part", (F.col("fails") + F.when(copy, 16).otherwise(0)).alias("fails"))
    given = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    return skewed_join(marked, given, ["doc_id"], "left").select(
        "part", truth_word(F.col("fails")).alias("word"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


class Counter:
    """Carry-save counts of the bits of words, by position."""

    def __init__(self):
        self.planes: dict[int, list[np.ndarray]] = defaultdict(list)
        self.waiting = 0

    def add(self, words: np.ndarray) -> None:
        self.planes[0].append(words)
        self.waiting += len(words)
        if self.waiting >= WAITING:
            self.reduce()

    def reduce(self) -> None:
        """Leave at most two words of each weight."""
        weight = 0
        while weight <= max(self.planes, default=-1):
            rest = np.concatenate(self.planes[weight]) if self.planes[weight] else np.zeros(0, np.uint32)
            while len(rest) > 2:
                third = len(rest) // 3
                a, b, c = rest[:third], rest[third : 2 * third], rest[2 * third : 3 * third]
                odd = a ^ b
                self.planes[weight + 1].append((a & b) | (odd & c))
                rest = np.concatenate([odd ^ c, rest[3 * third :]])
            self.planes[weight] = [rest]
            weight += 1
        self.waiting = 0

    def totals(self) -> list[int]:
        self.reduce()
        out = [0] * SUBSETS
        for weight, (left,) in self.planes.items():
            for s in range(SUBSETS):
                out[s] += int((left >> np.uint32(s) & np.uint32(1)).sum()) << weight
        return out


def survivors(rows: DataFrame) -> DataFrame:
    """``part``, ``subset`` and how many documents outlive it: ``kept``, of them ``good`` and ``toxic``."""
    names = ["part", "subset", "kept", "good", "toxic"]

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Counter, Counter, Counter]] = {}

        def given() -> pa.RecordBatch:
            columns = [[], [], [], [], []]
            for part, counters in held.items():
                columns[0] += [part] * SUBSETS
                columns[1] += range(SUBSETS)
                for column, counter in zip(columns[2:], counters, strict=True):
                    column += counter.totals()
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], names)

        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            codes = coded.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            word, good, toxic = (batch.column(i).to_numpy(zero_copy_only=False)[order] for i in (1, 2, 3))
            word = word.astype(np.uint32)
            ends = np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))
            for part, first, end in zip(coded.dictionary.to_pylist(), [0, *ends.tolist()], ends.tolist()):
                if part not in held:
                    if len(held) >= PARTS:
                        yield given()
                    held[part] = Counter(), Counter(), Counter()
                own = word[first:end]
                for counter, chosen in zip(held[part], (own, own[good[first:end]], own[toxic[first:end]]), strict=True):
                    counter.add(chosen)
        yield given()

    partial = rows.select("part", "word", "good", "toxic").mapInArrow(tasks, "part string, subset int, kept bigint, good bigint, toxic bigint")
    return partial.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in names[2:]))


def steps() -> list[dict]:
    """Every step of every order: which subset has run before it and after it, and what its filter needs besides.

    ``shares`` has, for each subset, how often the survivors of the subset count for the
    filter's removals over all orders: plus where the filter comes next, minus where it has just run.
    """
    full = SUBSETS - 1
    shares = []
    for i in range(len(FILTERS)):
        share = []
        for s in range(SUBSETS):
            earlier = (s & ~(1 << i)).bit_count()
            orders = factorial(earlier) * factorial(len(FILTERS) - 1 - earlier)
            share.append(-orders if s >> i & 1 else orders)
        shares.append(share)
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            out.append({"filter_order": "".join(FILTERS[j] for j in order), "step": step, "alone": 1 << i, "before": before,
                        "after": before | 1 << i, "others": full & ~(1 << i), "shares": shares[i]})
            before |= 1 << i
    return out


def orders_audit(counts: DataFrame) -> DataFrame:
    """The audit's rows from the survivors of every subset: 600 rows for each part."""
    entry = F.struct("subset", "kept", "good", "toxic")
    # Sorted by subset, so that a subset's number is its place; 32 entries a part.
    parts = counts.groupBy("part").agg(F.array_sort(F.collect_list(entry)).alias("s"))
    kind = ("array<struct<filter_order:string,step:int,alone:int,before:int,after:int,others:int,shares:array<bigint>>>")
    rows = parts.select("part", "s", F.explode(F.from_json(F.lit(json.dumps(steps())), kind)).alias("o"))

    def at(place: str | int, field: str) -> Column:
        return F.get("s", F.lit(place) if isinstance(place, int) else F.col(f"o.{place}"))[field]

    removed = at("before", "kept") - at("after", "kept")
    shapley = F.aggregate(F.zip_with(F.col("s")["kept"], F.col("o.shares"), lambda k, w: k * w), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select(
        "part", "o.filter_order", "o.step", at("after", "kept").alias("kept"), removed.alias("removed"),
        (at(0, "kept") - at("alone", "kept") - removed).alias("redundant"),
        (at("others", "kept") - at(SUBSETS - 1, "kept")).alias("unique_fails"),
        (at("before", "good") - at("after", "good")).alias("good_lost"),
        (at("before", "toxic") - at("after", "toxic")).alias("toxic_lost"), shapley.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes, spares and repeats at every place of every order, by source."""
    return orders_audit(survivors(words(docs, labels)))
