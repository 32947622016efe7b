"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

Encoding. The BPE code of a text is the one cut into tokens in which any two
neighbours are also the code of their joined bytes; every prefix of a code is
the code of its bytes. So each prefix of a piece has one last token. The
transducer reads bytes; its state is the last token that is settled and the
bytes after it. After each byte, the places where a later token can still begin
are those from which the bytes so far begin some token; tokens on which the
codes of all these places agree are emitted. States and transitions are made
when they are first met, up to a bound; from where a piece leaves them, its rest is
read by following the live places themselves.

Decoding. Bytes of ids go through a UTF-8 state machine, whose transitions are
compiled per token; chunks of ids give whole characters, and an unfinished
character waits for the next chunk.

Defined cases: null text counts as empty and has no ids; ids that end within a
character, or are not UTF-8, decode to their bytes as they are; rows that repeat an id each
have a row; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import grouped, held
from lectern.llm.tokenizer import parts

STATES = 100_000
PAIRS = 1_000_000
CACHE = 700_000
#: States with more open bytes than this are not kept.
LONGEST_KEPT = 64
STREAM_IDS = 4096


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class State:
    """The last settled token, the open bytes after it, and for each place among these: the token that ends there, where
    it begins, and the places at which a later token can still begin."""

    __slots__ = ("last", "open", "ends", "begin", "live", "next", "_final")

    def __init__(self, last: int, open_: bytes, ends: list[int], begin: list[int], live: list[int]):
        self.last, self.open, self.ends, self.begin, self.live = last, open_, ends, begin, live
        self.next: dict[int, tuple[State, list[int]]] = {}
        self._final: list[int] | None = None

    def path(self, at: int) -> list[int]:
        """Tokens from the first open byte to a place."""
        out = []
        while at > 0:
            out.append(self.ends[at])
            at = self.begin[at]
        return out[::-1]

    @property
    def final(self) -> list[int]:
        """The code of the open bytes if nothing follows."""
        if self._final is None:
            self._final = self.path(len(self.open))
        return self._final


class Transducer:
    """Codes of pieces under a rank table that has all 256 single bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.begins = {t[:k] for t in ranks for k in range(1, len(t))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.states: dict[tuple[int, bytes], State] = {}
        self.start = State(-1, b"", [-1], [-1], [0])

    def merged(self, piece: bytes) -> list[int]:
        """The code by its definition: the lowest-ranked neighbours merge first, the leftmost of equals."""
        at = [piece[i : i + 1] for i in range(len(piece))]
        while len(at) > 1:
            rank, i = min(((self.ranks.get(at[i] + at[i + 1], 1 << 62), i) for i in range(len(at) - 1)))
            if rank == 1 << 62:
                break
            at[i : i + 2] = [at[i] + at[i + 1]]
        return [self.ranks[t] for t in at]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte, and for a token that no merges make."""
        if token not in self.halves:
            raw, found = self.tokens[token], None
            rest = [self.merged(raw[:k]) + self.merged(raw[k:]) for k in range(1, len(raw))]
            pairs = [p for p in rest if len(p) == 2]
            if len(raw) > 1 and self.merged(raw) == [token]:
                found = tuple(next(p for p in pairs if self._apart(*p, token)))
            self.halves[token] = found
        return self.halves[token]

    def _apart(self, a: int, b: int, limit: int) -> bool:
        """Do merges of rank below ``limit`` leave the border between two neighbouring tokens alone?

        Undo the merges of both, the latest first; at each moment the two pieces at the border must not merge earlier
        than the piece that is undone was made.
        """
        while True:
            made = self.ranks.get(self.tokens[a] + self.tokens[b])
            if made is not None and made < limit:
                return False
            left, right = self.split(a), self.split(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and a > b:
                # Equal ranks merge from the left: a pair at the border comes after the same pair further left.
                limit, a = a, left[1]
            else:
                limit, b = b + 1, right[0]

    def neighbours(self, a: int, b: int) -> bool:
        """Do the two tokens stay as they are when their bytes are joined? The second must be a code of its own too."""
        key = (a, b)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            single = len(self.tokens[b]) == 1
            found = (single or self.split(b) is not None) and (a < 0 or self._apart(a, b, 1 << 62))
            self.pairs[key] = found
        return found

    def step(self, at: State, byte: int) -> tuple[State, list[int]]:
        """The move from a state by a byte, worked out once."""
        text = at.open + bytes((byte,))
        n = len(text)
        ranks, begins, pairs, before = self.ranks, self.begins, self.pairs, at.ends
        live, rank = [], None
        for j in at.live:
            part = text[j:]
            if rank is None and (r := ranks.get(part)) is not None:
                fits = pairs.get((before[j], r))
                if self.neighbours(before[j], r) if fits is None else fits:
                    rank, first = r, j
            if part in begins:
                live.append(j)
        live.append(n)
        ends, begin = [*before, rank], [*at.begin, first]
        # The last place through which the codes of all live places lead.
        common = n
        for i in live:
            while i != common:
                if i > common:
                    i = begin[i]
                else:
                    common = begin[common]
        done: list[int] = []
        if common:
            i = common
            while i > 0:
                done.append(ends[i])
                i = begin[i]
            done.reverse()
            text, ends, begin = text[common:], ends[common:], [b - common for b in begin[common:]]
            live = [i - common for i in live]
        key = (ends[0], text)
        to = self.states.get(key)
        if to is None:
            to = State(ends[0], text, ends, begin, live)
            if n <= LONGEST_KEPT:
                self.states[key] = to
        move = (to, done)
        if n <= LONGEST_KEPT:
            at.next[byte] = move
        return move

    def follow(self, at: State, rest: bytes) -> list[int]:
        """The code of the open bytes of a state and all that follow, without making states."""
        ranks, begins, pairs = self.ranks, self.begins, self.pairs
        text, live = at.open + rest, at.live
        ends, begin = at.ends.copy(), at.begin.copy()
        for n in range(len(at.open) + 1, len(text) + 1):
            still, rank = [], None
            for j in live:
                part = text[j:n]
                if rank is None and (r := ranks.get(part)) is not None:
                    fits = pairs.get((ends[j], r))
                    if self.neighbours(ends[j], r) if fits is None else fits:
                        rank, first = r, j
                if part in begins:
                    still.append(j)
            still.append(n)
            live = still
            ends.append(rank)
            begin.append(first)
        out, i = [], len(text)
        while i > 0:
            out.append(ends[i])
            i = begin[i]
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        at, out = self.start, []
        for k, byte in enumerate(piece):
            move = at.next.get(byte)
            if move is None:
                if len(self.states) >= STATES:
                    return out + self.follow(at, piece[k:])
                move = self.step(at, byte)
            if move[1]:
                out += move[1]
            at = move[0]
        return out + at.final


def _utf8_moves() -> np.ndarray:
    """Moves of the UTF-8 state machine: 0 between characters, 1 to 3 that many bytes to come, 4 to 7 after the lead
    bytes E0, ED, F0 and F4, whose second byte is restricted, 8 not UTF-8."""
    moves = np.full((9, 256), 8, np.uint8)
    moves[0, :0x80], moves[0, 0xC2:0xE0], moves[0, 0xE1:0xF0], moves[0, 0xF1:0xF4] = 0, 1, 2, 3
    moves[0, 0xE0], moves[0, 0xED], moves[0, 0xF0], moves[0, 0xF4] = 4, 5, 6, 7
    for n in (1, 2, 3):
        moves[n, 0x80:0xC0] = n - 1
    moves[4, 0xA0:0xC0], moves[5, 0x80:0xA0], moves[6, 0x90:0xC0], moves[7, 0x80:0x90] = 1, 1, 2, 2
    return moves


class Decoder:
    """Characters of a stream of ids."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.moves = _utf8_moves().tolist()
        self.from_start = np.array([self.run(0, t) for t in tokens], np.uint8)

    def run(self, state: int, token: bytes) -> int:
        for byte in token:
            state = self.moves[state][byte]
        return state

    def stream(self, chunks: Iterable[np.ndarray]) -> Iterator[bytes]:
        """Whole characters of each chunk as bytes; at the end, or where bytes are not UTF-8, bytes as they are."""
        state, held = 0, b""
        for ids in chunks:
            plain = ids.tolist()
            at = -1
            odd = np.flatnonzero(self.from_start[ids]).tolist()
            if state:
                at = 0
                while at < len(plain) and state not in (0, 8):
                    state = self.run(state, self.tokens[plain[at]])
                    at += 1
            for i in odd:
                if i < at or state == 8:
                    continue
                at = i
                while at < len(plain) and (state or at == i) and state != 8:
                    state = self.run(state, self.tokens[plain[at]])
                    at += 1
            raw = held + b"".join(map(self.tokens.__getitem__, plain))
            keep = 0
            if state not in (0, 8):
                keep = 1
                while raw[-keep] & 0xC0 == 0x80:
                    keep += 1
            held = raw[len(raw) - keep :]
            yield raw[: len(raw) - keep]
        if held:
            yield held


class Codec:
    """Encoder and decoder of one vocabulary; texts are cut by ``pattern`` first."""

    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        self.machine = Transducer(ranks)
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        self.decoder = Decoder(tokens)
        self.decimal = [str(r) for r in range(len(tokens))]
        self.pieces = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def code(self, text: str) -> bytes:
        out: list[int] = []
        for piece in self.pieces(text):
            out += self.machine.encode(piece.encode())
        return struct.pack(f"<{len(out)}I", *out)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; its parts between single blanks are looked up first."""
        if not text:
            return np.zeros(0, "<u4")
        head, *rest = parts(text)
        if len(self.cache) > CACHE:
            self.before, self.cache = self.cache, {}
        cache, before = self.cache, self.before
        found = list(map(cache.get, rest))
        if None in found:
            for at in compress(range(len(found)), map(is_, found, repeat(None))):
                c = rest[at]
                known = cache.get(c) or before.get(c)
                found[at] = cache[c] = self.code(f" {c}") if known is None else known
        return np.frombuffer(self.code(head) + b"".join(found), "<u4")

    def decode(self, ids: np.ndarray) -> Iterator[bytes]:
        return self.decoder.stream(ids[a : a + STREAM_IDS] for a in range(0, len(ids), STREAM_IDS))


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process, for the vocabulary asked for last."""
    return held(f"codec {path} {pattern}", lambda: Codec(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (doc_id, ids)."""
    def run(batches):
        own = codec(path, pattern)
        for (keys,), texts in grouped(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([own.encode(t).astype(np.int32) for t in texts], pa.list_(pa.int32()))],
                ["doc_id", "ids"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, bytes) of rows (doc_id, ids)."""
    def run(batches):
        own = codec(path, pattern)
        for b in batches:
            out = [b"".join(own.decode(x.values.to_numpy())) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Digests of the ids of each whole text and of the bytes they decode to; ids do not leave their task."""
    def run(batches):
        own = codec(path, pattern)
        for (keys,), texts in grouped(batches):
            rows: list[list] = [[], [], []]
            for t in texts:
                ids = own.encode(t)
                said = hashlib.sha256(" ".join(map(own.decimal.__getitem__, ids.tolist())).encode())
                back = hashlib.sha256()
                for part in own.decode(ids):
                    back.update(part)
                for c, v in zip(rows, (len(ids), said.hexdigest(), back.hexdigest()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()),
                 pa.array(rows[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
