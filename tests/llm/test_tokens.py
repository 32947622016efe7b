"""Huffman files, packing and byte-level BPE against the public libraries and exact round trips."""

from __future__ import annotations

import hashlib
import zlib
from itertools import pairwise

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from lectern.llm import bpe, huffman, packing
from lectern.llm.tokenizer import ChunkEncoder

WORD, BYTE, RANKS = (P.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))


def plain(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_parts_join(path):
    own, want = ChunkEncoder(path, 50), plain(path)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text("ab'1!é\u0301 \n\t\x01\xa0Σ<|>s語\x1c., ", max_size=30), max_size=6))
    def check(texts):
        assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts)] == [want(t) for t in texts]

    check()


def test_words_are_learned_once():
    """Capitals and marks at its end make no new word."""
    own, want = ChunkEncoder(WORD), plain(WORD)
    texts = ["Éclair", "the éclair, THE", "The ÉCLAIR!? the... éclair."]
    assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts)] == [want(t) for t in texts]
    assert sorted(own.rest) == ["the", "éclair"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_capitals_join(path):
    """Also letters that an accent after them changes in one case only, and those with more than one lower case."""
    own, want = ChunkEncoder(path, 50), plain(path)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text("aAjJHIiÉéßẞİıΣσK×µĮ\u030c\u0307\u0331.,!' \n\x00", max_size=20), max_size=6))
    def check(texts):
        assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts)] == [want(t) for t in texts]
        arrays = pa.array(texts, pa.string())
        assert own.encode(arrays) == own.encode(texts)

    check()
    for text in ("The" + "." * 8, "The" + "." * 9, "É" + ".,!?;:#$%&*" * 3, "J\u030c", "j\u030c, J\u030c,", "I\u0307.",
                 "<|STARTOFTEXT|>", "<|startoftext|>"):
        assert np.frombuffer(own.encode([f"a {text} b"])[0], own.dtype).tolist() == want(f"a {text} b")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=60), st.integers(7, 12))
def test_code_lengths(counts, limit):
    counts = np.array(counts)
    lengths = huffman.code_lengths(counts, limit)
    used = counts > 0
    assert (lengths[~used] == 0).all() and lengths.max(initial=0) <= limit
    if used.sum() > 1:
        assert np.sum(0.5 ** lengths[used].astype(float)) == 1


def test_code_lengths_are_best():
    """Against all codes of at most 3 bits for 5 symbols."""
    from itertools import product

    counts = np.array([1, 1, 2, 9, 30])
    best = min(np.dot(counts, c) for c in product((1, 2, 3), repeat=5) if sum(0.5**n for n in c) <= 1)
    assert np.dot(counts, huffman.code_lengths(counts, 3)) == best


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=700), min_size=1, max_size=5))
def test_blocks_round_trip(docs):
    ids = np.concatenate([np.array(d) for d in docs])
    lengths = huffman.code_lengths(np.bincount(ids), 9)
    bits, marks = huffman.pack(ids, np.array([len(d) for d in docs]), lengths, huffman.canonical(lengths))
    dec = huffman.Decoder(lengths)
    for d, b, m in zip(docs, bits, marks, strict=True):
        sizes = np.array([min(huffman.BLOCK, len(d) - a) for a in range(0, len(d), huffman.BLOCK)])
        assert dec.decode(b, m, sizes).tolist() == d
        # A block alone, by its checkpoint.
        assert dec.decode(b, m[-1:], sizes[-1:]).tolist() == d[(len(sizes) - 1) * huffman.BLOCK :]


def test_files(spark, odd_docs):
    out = huffman.output_folder(spark)
    huffman.write(odd_docs, WORD, out, end=2)
    rows = huffman.digests(huffman.read(spark, out)).collect()
    want = plain(WORD)
    texts = sorted(((d["doc_id"] is not None, d["doc_id"] or 0), [*want(d["text"]), 2]) for d in odd_docs.collect())
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted(
        (*k, len(ids), crc(ids)) for k, ids in texts)
    by_start = sorted(rows, key=lambda r: r["start"])
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in pairwise(by_start)) and by_start[0]["start"] == 0
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in by_start]
    assert keys == sorted(keys)


def test_packed_in_short_runs(spark, odd_docs, monkeypatch):
    """Many runs of few ids give the bits of one run."""
    found = []
    for ids in (4, huffman.PACKED_IDS):
        monkeypatch.setattr(huffman, "PACKED_IDS", ids)
        out = huffman.output_folder(spark)
        huffman.write(odd_docs, WORD, out, end=2)
        found.append(sorted((r["doc_ids"][0] or 0, bytes(r["counts"]), bytes(r["checkpoints"]), bytes(r["bits"]))
                            for r in spark.read.parquet(f"{out}/segments").collect()))
    assert found[0] == found[1]


def test_no_files(spark, no_docs):
    out = huffman.output_folder(spark)
    huffman.write(no_docs, WORD, out, end=2)
    assert huffman.read(spark, out).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=8), st.integers(0, 60))
def test_fullest(left, room):
    sums = {0}
    for n, c in left.items():
        sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
    got = packing.fullest(left, room)
    assert sum(got) == max(sums) and all(got.count(n) <= left[n] for n in got)


@pytest.mark.parametrize("capacity", [2048, 16])
def test_packing(odd_docs, capacity):
    rows = packing.pack(odd_docs, BYTE, end=0, capacity=capacity).collect()
    want, pieces = plain(BYTE), []
    for d in odd_docs.collect():
        ids = [*want(d["text"]), 0]
        first = (len(ids) - 1) % capacity + 1
        for k, at in enumerate([0, *range(first, len(ids), capacity)]):
            part = ids[at : first if k == 0 else at + capacity]
            pieces.append((str(d["doc_id"]), k, at, len(part), crc(part)))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(pieces)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(places))
        assert sum(places[-1]) <= capacity
    total = sum(p[3] for p in pieces)
    assert len(by) <= 1 + 1.1 * total / capacity


def test_packing_nothing(no_docs):
    assert packing.pack(no_docs, BYTE).count() == 0


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_transducer(codec, tik):
    @settings(max_examples=300, deadline=None)
    @given(st.text(st.sampled_from("abehinorst 'ÉéΩ語\n1!😀"), max_size=60))
    def check(text):
        ids = codec.encode(text)
        assert ids.tolist() == tik.encode_ordinary(text)
        assert b"".join(codec.decode(ids)) == text.encode()

    check()
    for text in ("a" * 500, " " * 300, "ab" * 200, "the" * 100, "=" * 129):
        assert codec.encode(text).tolist() == tik.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(raw=st.binary(max_size=80), step=st.integers(1, 9))
def test_stream(codec, raw, step):
    ids = np.array([codec.machine.ranks[raw[i : i + 1]] for i in range(len(raw))], "<u4")
    assert b"".join(codec.decoder.stream(ids[a : a + step] for a in range(0, len(ids), step))) == raw


def test_stream_gives_whole_characters(codec):
    text = "日本é語a😀" * 9
    ids = np.array([codec.machine.ranks[bytes([b])] for b in text.encode()], "<u4")
    parts = list(codec.decoder.stream(ids[a : a + 5] for a in range(0, len(ids), 5)))
    assert "".join(p.decode() for p in parts) == text


def test_round_trip(odd_docs, tik):
    rows = bpe.round_trip(odd_docs, RANKS, P.PATTERN).collect()
    want = []
    for d in odd_docs.collect():
        text = d["text"] or ""
        ids = tik.encode_ordinary(text)
        want.append((str(d["doc_id"]), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in rows) == sorted(want)


def test_tables(odd_docs, no_docs, tik):
    back = bpe.decode(bpe.encode(odd_docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted(bytes(r["bytes"]) for r in back) == sorted((d["text"] or "").encode() for d in odd_docs.collect())
    assert bpe.round_trip(no_docs, RANKS, P.PATTERN).count() == 0
