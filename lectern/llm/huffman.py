"""Token ids of documents in length-limited canonical Huffman code, in ascending document order.

Files: ``codes`` (symbol, bits: the code lengths, which fix the canonical code)
and ``segments``, one row for a million ids at most: range of document ids and number
in it, document ids, their id counts, the ids before it in its range, a
bit offset (checkpoint) for every block of 256 ids of a document, and the bits.
A block can be decoded alone. Ranges ascend by document id.

Defined cases: null text counts as empty; a null document id sorts first; rows
that repeat an id are kept, all of them; an empty table gives empty files.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm.common import range_of, shuffle_partitions, slices, stored
from lectern.llm.tokenizer import ENCODED, encoder
from lectern.session import scratch_path

BLOCK = 256
SEGMENT_IDS = 1 << 20
#: Ids packed in one go: their arrays stay in a core's cache.
PACKED_IDS = 1 << 16
#: Ranges of ids per shuffle partition.
RANGES = 4
SEGMENTS = ("part int, seq int, ids_before long, n_ids long, doc_ids array<bigint>, counts binary, checkpoints binary, "
            "bits binary")


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Best code lengths of at most ``limit`` bits by package-merge; a count of zero gives no code (0)."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    items, levels = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = len(items) // 2
        both = np.concatenate([leaves, items[0 : 2 * pairs : 2] + items[1 : 2 * pairs : 2]])
        rank = np.argsort(both, kind="stable")
        items = both[rank]
        levels.append(rank < n)
    take = 2 * n - 2
    depth = np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        found = int(is_leaf[:take].sum())
        depth[:found] += 1
        take = 2 * (take - found)
    out[order] = depth
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint64)
    code = bits = 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        n = int(lengths[s])
        if n:
            code = code << (n - bits) if bits else 0
            codes[s], bits = code, n
            code += 1
    return codes


def pack(ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
    """Bits of each document, from a whole byte on, and the bit offsets of its blocks."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    last = np.cumsum(sizes)
    first = last - sizes
    before = np.where(first > 0, ends[first - 1], 0)
    width = (ends[last - 1] - before + 7) >> 3
    byte0 = np.cumsum(width) - width
    start = ends - n + np.repeat(8 * byte0 - before, sizes)
    word, off = start >> 6, start & 63
    over = off + n - 64
    code = codes[ids]
    high = np.where(over <= 0, code << np.maximum(-over, 0).astype(np.uint64), code >> np.maximum(over, 0).astype(np.uint64))
    total = int(width.sum())
    words = np.zeros((total >> 3) + 2, np.uint64)
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[heads]] = np.bitwise_or.reduceat(high, heads)
    spill = np.flatnonzero(over > 0)
    words[word[spill] + 1] |= code[spill] << (64 - over[spill]).astype(np.uint64)
    raw = words.astype(">u8").tobytes()
    bits = [raw[a : a + w] for a, w in zip(byte0.tolist(), width.tolist(), strict=True)]
    marks = [start[a:z:BLOCK] - 8 * b for a, z, b in zip(first.tolist(), last.tolist(), byte0.tolist(), strict=True)]
    return bits, marks


class Decoder:
    """Decodes all blocks of a segment side by side, one table look-up for each id."""

    def __init__(self, lengths: np.ndarray):
        self.width = max(1, int(lengths.max(initial=1)))
        codes = canonical(lengths).astype(np.int64)
        self.symbol = np.zeros(1 << self.width, np.int32)
        self.bits = np.zeros(1 << self.width, np.int64)
        for s in np.flatnonzero(lengths).tolist():
            free = self.width - int(lengths[s])
            at = int(codes[s]) << free
            self.symbol[at : at + (1 << free)] = s
            self.bits[at : at + (1 << free)] = lengths[s]

    def decode(self, bits: bytes, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids of blocks that begin at bit ``at`` and hold ``sizes`` ids, in the order given."""
        raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]).astype(np.int64)
        order = np.argsort(-sizes, kind="stable")
        pos, left = at[order].astype(np.int64), sizes[order]
        out = np.zeros((BLOCK, len(at)), np.int32)
        active = np.searchsorted(-left, -np.arange(1, BLOCK + 1), side="right")
        mask, down = (1 << self.width) - 1, 32 - self.width
        for k in range(BLOCK):
            m = int(active[k])
            if not m:
                break
            p = pos[:m]
            code = (window[p >> 3] >> (down - (p & 7))) & mask
            out[k, :m] = self.symbol[code]
            p += self.bits[code]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        table = out.T[back]
        return table[np.arange(BLOCK) < sizes[:, None]]


def tokenise(docs: DataFrame, path: str, end: int | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (doc_id, ids): the ids of each whole text, with the end id, as little-endian bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        tail = b"" if end is None else np.array([end], enc.dtype).tobytes()
        for batch in batches:
            for part in slices(batch, limit=ENCODED):
                ids = [x + tail for x in enc.encode(part.column(1).fill_null(""))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, ids binary")


def _id_type(path: str) -> np.dtype:
    return encoder(path).dtype


def count_ids(tokens: DataFrame, dtype: np.dtype) -> dict[int, int]:
    """Occurrences of each id in all documents, added up per task first; at most one row per id reaches the driver."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for part in slices(b, 0, 4 * SEGMENT_IDS):
                ids = np.frombuffer(b"".join(part.column(0).to_numpy(zero_copy_only=False)), dtype)
                found = np.bincount(ids)
                if len(found) > len(total):
                    total, found = found, total
                total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in rows.collect()}


def write(docs: DataFrame, path: str, out: str, end: int | None = None, max_bits: int | None = None,
          text: str = "text", key: str = "doc_id") -> None:
    """Write the ids of all documents below ``out``, in ascending order of ``key``."""
    spark = docs.sparkSession
    dtype = _id_type(path)
    tokens = stored(tokenise(docs, path, end, text, key), "ids", "snappy")
    found = count_ids(tokens, dtype)
    counts = np.zeros(max(found, default=0) + 1, np.int64)
    for i, n in found.items():
        counts[i] = n
    limit = max_bits or min(24, max(16, int(np.ceil(np.log2(max(2, len(found))))) + 2))
    lengths = code_lengths(counts, limit)
    codes = canonical(lengths)
    used = np.flatnonzero(lengths).tolist()
    spark.createDataFrame([(i, int(lengths[i])) for i in used], "symbol int, bits int").coalesce(1).write.parquet(f"{out}/codes")

    def coded(batches):
        for b in batches:
            keys, raw = b.column(0).to_pylist(), b.column(1).to_pylist()
            first = 0
            while first < len(raw):
                last, size = first, 0
                while last < len(raw) and (last == first or size + len(raw[last]) <= PACKED_IDS * dtype.itemsize):
                    size += len(raw[last])
                    last += 1
                sizes = np.array([len(x) // dtype.itemsize for x in raw[first:last]], np.int64)
                full = np.flatnonzero(sizes)
                bits, marks = [b""] * (last - first), [np.zeros(0, np.int64)] * (last - first)
                if len(full):
                    some = pack(np.frombuffer(b"".join(raw[first:last]), dtype), sizes[full], lengths, codes)
                    for at, x, m in zip(full.tolist(), *some, strict=True):
                        bits[at], marks[at] = x, m
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[first:last], pa.int64()), pa.array(sizes, pa.int64()),
                     pa.array([m.astype("<u8").tobytes() for m in marks], pa.binary()), pa.array(bits, pa.binary())],
                    ["doc_id", "n", "marks", "bits"])
                first = last

    def segments(batches):
        part, seq, before = -1, 0, 0
        ids, counts, marks, bits, n, size = [], [], [], [], 0, 0

        def row():
            return pa.RecordBatch.from_pylist([{
                "part": part, "seq": seq, "ids_before": before, "n_ids": n, "doc_ids": ids,
                "counts": np.array(counts, "<u8").tobytes(), "checkpoints": b"".join(marks), "bits": b"".join(bits)}],
                schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()),
                                  ("doc_ids", pa.list_(pa.int64())), ("counts", pa.binary()), ("checkpoints", pa.binary()),
                                  ("bits", pa.binary())]))

        for b in batches:
            for key_, k, m, x, at in zip(*(b.column(j).to_pylist() for j in range(5)), strict=True):
                if ids and (at != part or n + k > SEGMENT_IDS):
                    yield row()
                    seq, before = seq + 1, before + n
                    ids, counts, marks, bits, n, size = [], [], [], [], 0, 0
                if at != part:
                    part, seq, before = at, 0, 0
                ids.append(key_)
                counts.append(k)
                marks.append((np.frombuffer(m, "<u8") + 8 * size).astype("<u8").tobytes())
                bits.append(x)
                n, size = n + k, size + len(x)
        if ids:
            yield row()

    rows = tokens.mapInArrow(coded, "doc_id long, n long, marks binary, bits binary")
    # Ranges by a column: Spark's own range partitioning would encode everything once more to sample it.
    parts = shuffle_partitions(spark)
    placed = rows.withColumn("part", range_of(tokens, "doc_id", RANGES * parts))
    ordered = placed.repartition(parts, "part").sortWithinPartitions("part", "doc_id", "n", "bits")
    ordered.mapInArrow(segments, SEGMENTS).write.option("compression", "none").parquet(f"{out}/segments")


def read(spark: SparkSession, out: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids): decoded ids as little-endian 32-bit integers."""
    lengths = {r["symbol"]: r["bits"] for r in spark.read.parquet(f"{out}/codes").collect()}
    table = np.zeros(max(lengths, default=0) + 1, np.uint8)
    for s, n in lengths.items():
        table[s] = n
    segments = spark.read.schema(SEGMENTS).parquet(f"{out}/segments")
    # One number for each range partition: bounded by their count, whatever the data.
    sizes = dict(segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base, total = {}, 0
    for p in sorted(sizes):
        base[p], total = total, total + sizes[p]
    return segments.mapInArrow(partial(_decoded, table=table, base=base),
                               "doc_id long, start long, n_tokens long, ids binary")


def _decoded(batches, table, base):
    dec = None
    for b in batches:
        for r in b.to_pylist():
            dec = dec or Decoder(table)
            counts = np.frombuffer(r["counts"], "<u8").astype(np.int64)
            blocks = (counts + BLOCK - 1) // BLOCK
            sizes = np.full(int(blocks.sum()), BLOCK, np.int64)
            some = np.flatnonzero(counts)
            sizes[np.cumsum(blocks)[some] - 1] = counts[some] - (blocks[some] - 1) * BLOCK
            ids = dec.decode(r["bits"], np.frombuffer(r["checkpoints"], "<u8").astype(np.int64), sizes).astype("<u4")
            ends = np.cumsum(counts)
            starts = ends - counts
            raw = ids.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["doc_ids"], pa.int64()), pa.array(starts + base[r["part"]] + r["ids_before"], pa.int64()),
                 pa.array(counts, pa.int64()),
                 pa.array([raw[4 * a : 4 * z] for a, z in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())],
                ["doc_id", "start", "n_tokens", "ids"])


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of decoded rows."""
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def output_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "huffman")


__all__ = ["Decoder", "canonical", "code_lengths", "count_ids", "digests", "output_folder", "pack", "read", "tokenise",
           "write"]
