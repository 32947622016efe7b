"""Token counts of whole texts by a piece vocabulary: byte-pair merging over a heap and a linked list, no ids.

The text is normalised by the vocabulary's own rules. Its characters are the first
symbols; of all neighbours whose joined text is a piece, the pair of the lowest
rank is popped from a heap, the leftmost of equals first, and merged in a linked
list, until no pair is left. The count is the number of first symbols, where a character
that the vocabulary lacks counts as its UTF-8 bytes, less the number of merges.

No piece crosses from a character to a blank mark after it, nor holds a line end that the vocabulary
lacks; both are checked when the vocabulary is read. So the parts between such
places merge alone, and a worker remembers counts of short parts up to a bounded number of bytes.

Defined results: a null text counts as empty, and an empty text has 0 bytes and 0
tokens; rows that repeat are counted each by itself; an empty table gives an empty
table; other columns, whatever their names, are left out. Vocabularies made by
another model than byte-pair merging, or with user-defined pieces, are not for this operator.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lectern.llm.common import grouped, held

BLANK = "▁"
#: Longer parts are counted anew each time.
LONGEST = 64
#: Bytes of remembered parts in a worker, an entry's own 150 included: after a blank, and after a line end.
REMEMBERED, REMEMBERED_BARE = 128 << 20, 16 << 20


def merges(symbols: list[str], ranks: dict[str, int]) -> int:
    """How many merges the symbols allow, always the pair of the lowest rank first and of equals the leftmost.

    Heap entries are rank times length plus place. An entry counts if the pair now at its place has its rank.
    The list is used up.
    """
    rank = ranks.get
    last = len(symbols)
    heap = [r * last + i for i, r in enumerate(map(rank, map(add, symbols, symbols[1:]))) if r is not None]
    if not heap:
        return 0
    heapify(heap)
    after = list(range(1, last + 1))
    before = list(range(-1, last - 1))
    done = 0
    while heap:
        key = heappop(heap)
        i = key % last
        left = symbols[i]
        j = after[i]
        if not left or j == last:
            continue
        left += symbols[j]
        if rank(left) != key // last:
            continue
        symbols[i] = left
        symbols[j] = ""
        done += 1
        j = after[i] = after[j]
        if j != last:
            before[j] = i
            r = rank(left + symbols[j])
            if r is not None:
                heappush(heap, r * last + i)
        h = before[i]
        if h >= 0:
            r = rank(symbols[h] + left)
            if r is not None:
                heappush(heap, r * last + h)
    return done


class Remembered(dict):
    """Counts of parts that follow a fixed prefix, forgotten all at once when they take too much memory.

    A last character that no piece has after the one before it, as most marks, is counted by itself.
    """

    def __init__(self, counter: PieceCounter, prefix: str, limit: int):
        self.counter, self.prefix, self.limit, self.bytes = counter, prefix, limit, 0

    def __missing__(self, part: str) -> int:
        if 1 < len(part) <= LONGEST and part[-2:] not in self.counter.neighbours:
            n = self[part[:-1]] + self.counter.first(part[-1])
        else:
            n = self.counter.merged(self.prefix + part)
        if len(part) <= LONGEST:
            self.bytes += 150 + 4 * len(part)
            if self.bytes > self.limit:
                self.clear()
                self.bytes = 0
            self[part] = n
        return n


class PieceCounter:
    """Counts tokens by the pieces and scores of one vocabulary file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        m = self.model
        plain = [i for i in range(m.vocab_size()) if not (m.is_unknown(i) or m.is_control(i) or m.is_unused(i) or m.is_byte(i))]
        pieces = [m.id_to_piece(i) for i in plain]
        scores = [m.get_score(i) for i in plain]
        order = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        self.ranks = {p: order[s] for p, s in zip(pieces, scores, strict=True)}
        self.known = {p for p in pieces if len(p) == 1}
        if not any(m.is_byte(i) for i in range(m.vocab_size())):
            raise ValueError("the vocabulary has no byte pieces")
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("a piece goes on past a blank")
        self.line = "\n" not in {c for p in pieces for c in p}
        self.neighbours = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.marked, self.bare = Remembered(self, BLANK, REMEMBERED), Remembered(self, "", REMEMBERED_BARE)
        self.part = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")

    def first(self, part: str) -> int:
        """The number of first symbols: characters, or the bytes of those that are no piece."""
        return len(part) if self.known.issuperset(part) else sum(1 if c in self.known else len(c.encode()) for c in part)

    def merged(self, part: str) -> int:
        """The count of one part."""
        return self.first(part) - merges(list(part), self.ranks)

    def _between(self, line: str) -> int:
        """The count of a text without line ends."""
        if not line:
            return 0
        if BLANK * 2 in line or line[-1] == BLANK:
            return sum(self.marked[p[1:]] if p[0] == BLANK else self.bare[p] for p in self.part.findall(line))
        words = line.split(BLANK)
        first = words.pop(0)
        return (self.bare[first] if first else 0) + sum(map(self.marked.__getitem__, words))

    def count(self, texts: list[str]) -> list[int]:
        out = []
        for text in self.model.normalize(texts) if texts else ():
            if self.line:
                lines = text.split("\n")
                out.append(sum(map(self._between, lines)) + len(lines) - 1)
            else:
                out.append(self._between(text))
        return out


def counter(path: str) -> PieceCounter:
    """One counter per worker process, for the file asked for last."""
    return held(f"pieces {path}", lambda: PieceCounter(path))


def token_counts(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, sizes), texts in grouped(batches, text=1):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), pa.array(sizes, pa.int64()), pa.array(counter(path).count(texts), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    counted = rows.mapInArrow(tasks, f"doc_id {kind.simpleString()}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
