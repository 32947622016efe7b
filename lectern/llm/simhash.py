"""Near-duplicates by SimHash fingerprints, candidates by a pigeonring filter.

A fingerprint has 16 segments of 4 bits on a ring. Two fingerprints that differ
in at most t bits have a chain of consecutive segments, from some segment on,
in which the first l segments differ in at most l*t/16 bits, for every l up to
16. For t = 2 the first seven segments of that chain, 28 bits, are equal, and
the first fourteen differ in at most one bit. So a fingerprint is looked up by
its 16 chain heads; a bucket of more than ``BUCKET`` fingerprints is looked up
again by the 56 bits of fourteen segments with one of the later 28 left out,
which leaves at most 2**(64-56+1) fingerprints in a bucket. Each bucket gives
a spanning forest of its links, never all pairs.

Defined cases: a text without words (null, empty, blank) has fingerprint zero
and links like any other; rows that repeat an id are one group at least; a null
id joins the group of its fingerprint, and counts as the id only of a group
without any other; an empty table gives no rows. ``keep_one`` keeps one row of each group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import free, grouped, held, stored
from lectern.llm.components import Forest, components

SEED = 42
BITS = 64
SEGMENTS = 16
WIDTH = BITS // SEGMENTS
#: Most fingerprints compared with each other at once; larger buckets are cut by a longer key.
BUCKET = 512


def fingerprint(text: str, shingle: int = 3) -> int:
    """64 bits; a bit is set if it is in more than half of the shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams: Iterator[bytes] = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    votes, n = np.zeros(BITS, np.int64), 0
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), "<u8")
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", key: str = "doc_id", hashed: bool = False) -> DataFrame:
    """Rows (doc_id, fp): the fingerprint of each whole text as a signed long; with ``hashed`` also the text's hash."""
    names = ["doc_id", *(["text_hash"] if hashed else []), "fp"]

    def run(batches):
        held("simhash")
        for others, texts in grouped(batches):
            prints = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in others), pa.array(prints)], names)

    more = [_text_hash(text).alias("text_hash")] if hashed else []
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *more).mapInArrow(
        run, ", ".join(f"{n} long" for n in names))


def _text_hash(text: str):
    """Rows of equal text have it in common; a null text has none."""
    return F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text).cast("string")))


def _turned(fp, bits):
    """Rotate to the left by a number of bits that may be a column."""
    return F.call_function("shiftleft", fp, bits).bitwiseOR(F.call_function("shiftrightunsigned", fp, (F.lit(64) - bits) % 64))


def _linked(turned: np.ndarray, head: int, distance: int) -> np.ndarray:
    """Pairs of one bucket within ``distance``; chains from the head on prune before the full check."""
    a, b = np.triu_indices(len(turned), 1)
    diff = turned[a] ^ turned[b]
    for l in range(head + 1, SEGMENTS + 1):
        if not len(diff):
            break
        fits = np.bitwise_count(diff >> np.uint64(BITS - l * WIDTH)) <= l * distance // SEGMENTS
        a, b, diff = a[fits], b[fits], diff[fits]
    return np.stack([a, b], 1)


def links(prints: DataFrame, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Rows (a, b): a spanning forest of the links between the different fingerprints in column ``fp``."""
    head = next(l for l in range(SEGMENTS, 0, -1) if l * distance < SEGMENTS)
    longer = next(l for l in range(SEGMENTS, 0, -1) if l * distance < 2 * SEGMENTS)
    turn = F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("chain")
    rows = (prints.select("fp").distinct().select("fp", turn)
            .withColumn("turned", _turned(F.col("fp"), F.col("chain") * WIDTH))
            .withColumn("run", F.expr(f"shiftrightunsigned(turned, {BITS - head * WIDTH})")))
    sizes = rows.groupBy("chain", "run").agg(F.count("*").alias("n")).where("n > 1")
    busy = rows.join(sizes, ["chain", "run"])
    small = busy.where(F.col("n") <= bucket).groupBy("chain", "run").agg(F.collect_list("turned").alias("all"))
    # One bit after the head may differ up to the longer chain: leave each of them out in turn.
    free = (longer - head) * WIDTH
    lowest = BITS - longer * WIDTH
    cut = (busy.where(F.col("n") > bucket).withColumn("out", F.explode(F.sequence(F.lit(0), F.lit(free - 1))))
           .withColumn("run", F.expr(f"shiftrightunsigned(turned, {lowest}) & ~shiftleft(1L, out)")))
    large = cut.groupBy("chain", "out", "run").agg(F.collect_list("turned").alias("all")).where(F.size("all") > 1)

    def run(batches):
        for batch in batches:
            found = []
            for chain, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                turned = np.sort(values.values.to_numpy().view(np.uint64))
                forest = Forest()
                for x, y in _linked(turned, head, distance).tolist():
                    forest.join(x, y)
                down, up = np.uint64(chain * WIDTH), np.uint64((BITS - chain * WIDTH) % BITS)
                back = (turned >> down | turned << up) if chain else turned
                plain = back.view(np.int64).tolist()
                found += [(plain[x], plain[y]) for x, y in forest.links()]
            at = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1])], ["a", "b"])

    both = small.select("chain", "all").unionByName(large.select("chain", "all"))
    return both.mapInArrow(run, "a long, b long").distinct()


def _rooted(classes: DataFrame, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """The rows of different fingerprints ``fp`` with ``root``, the smallest fingerprint of their group."""
    roots = components(links(classes, distance, bucket)).withColumnRenamed("node", "fp")
    return classes.join(roots, "fp", "left").withColumn("root", F.coalesce("component", "fp"))


def groups(docs: DataFrame, shingle: int = 3, distance: int = 2, text: str = "text", key: str = "doc_id",
           bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, fp, fingerprint (hex) and component_id, the smallest id of its group."""
    prints = stored(fingerprints(docs, shingle, text, key), "prints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    owned = _rooted(classes, distance, bucket)
    least = owned.groupBy("root").agg(F.min("first").alias("component_id"))
    named = owned.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents whose id names their group, one row of each group; all columns stay."""
    prints = stored(fingerprints(docs, shingle, text, key, hashed=True), "prints")
    # Rows of one id and one text are the same to this; they have one fingerprint, so one group.
    same = prints.groupBy("fp", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "rows")).alias("first")
    chosen = _rooted(same.groupBy("fp").agg(first), distance).groupBy("root").agg(F.min("first").alias("first"))
    id_, hash_, rows_ = (free(docs, n) for n in ("kept_id", "kept_hash", "kept_rows"))
    kept = stored(chosen.select(F.col("first.doc_id").alias(id_), F.col("first.text_hash").alias(hash_),
                                F.col("first.rows").alias(rows_)), "kept")
    rows = docs.join(kept, F.col(key).cast("long").eqNullSafe(F.col(id_)) & _text_hash(text).eqNullSafe(F.col(hash_)))
    once = rows.where(F.col(rows_) == 1)
    # Only rows that share both id and text are shuffled once more.
    again = rows.where(F.col(rows_) > 1).dropDuplicates([id_, hash_])
    return once.unionByName(again).select(*[F.col(f"`{c}`") for c in docs.columns])
