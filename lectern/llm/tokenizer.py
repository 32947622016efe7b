"""Token ids of whole texts by a public tokenizer file, word groups cached per worker.

A text is cut only at single blanks between two other characters. The tokenizers
used here split at such a blank whatever stands around it, so the ids of the
parts, joined, are the ids of the whole text. The different parts of many texts are
found by Arrow's dictionary encoding, looked up once, and put back in place as
arrays. New parts are encoded many at a time; their ids are told apart by
token lengths in byte-level vocabularies, by word ends where the vocabulary marks
these, else by a mark between the parts. Marks at the end of a word of letters are a
token group of their own in both kinds of vocabulary, so such a part is its word's ids and the marks'.
A vocabulary that turns any white space into one blank, and drops that, is cut at line ends too;
where it also lower-cases, parts are lower-cased and cut off their marks as arrays before they are looked up.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lectern.llm.common import held

MARK = "\x01"
#: Characters of texts that are best encoded together.
ENCODED = 4 << 20
#: Parts encoded in one call.
TOGETHER = 128
#: Bytes of remembered parts after which they become the old ones, and the old ones go; about what a part takes; the
#: characters above which a part is not kept.
CACHE, ENTRY, LONGEST = 96 << 20, 220, 64
#: Marks that are split from a word of letters before them, whatever follows after a blank, as many as ``TAIL``.
TAILS, TAIL = ".,!?;:#$%&*", 8
#: Letters before this one are the same in all versions of Unicode, and lower-case to one letter.
SAFE = "İ"
LETTERS = "".join(c for c in map(chr, range(ord(SAFE))) if c.isalpha())
_OTHER = re.compile(r"[^\S \n]")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_UNSAFE = f"[^\\x{{0}}-\\x{{{ord(SAFE) - 1:X}}}]"


def parts(text: str) -> list[str]:
    """The text cut at its single blanks; these are left out."""
    spaced = ("  " in text or " \n" in text or "\n " in text or text[:1].isspace() or text[-1:].isspace()
              or _OTHER.search(text) is not None)
    return _CUT.split(text) if spaced else text.split(" ")


def word(part: str) -> bool:
    """Letters only, all of them safe."""
    return part.isalpha() and (part.isascii() or max(part) < SAFE)


class ChunkEncoder:
    """Ids as little-endian bytes, two or four bytes per id by the size of the vocabulary."""

    def __init__(self, path: str, cache_size: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.model.get_vocab_size(True) <= 1 << 16 else "<u4")
        self.cache_size, self.size = cache_size, 0
        self.heads: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.mark = self.model.encode(f" {MARK}", add_special_tokens=False).ids
        suffix = said["model"].get("end_of_word_suffix")
        self.ends = self.lengths = None
        vocab = said["model"]["vocab"]
        if suffix:
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        elif said["normalizer"] is None and said["pre_tokenizer"]["type"] == "ByteLevel":
            self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)
            for t, i in vocab.items():
                self.lengths[i] = len(t)
        self.splits = self.ends is not None or self.lengths is not None
        self.tails: dict[str, bytes] = {}
        rules = said["normalizer"] or {}
        blank = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
        steps = rules.get("normalizers", [rules])
        self.collapses = bool(suffix) and blank in steps
        lower = {"type": "Lowercase"}
        self.lowers = (lower in steps and all(x in ({"type": "NFC"}, blank, lower) for x in steps)
                       and all(x["special"] for x in said["added_tokens"]))

    def _plain(self, texts: list[str]) -> list[bytes]:
        done = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [array("H" if self.dtype.itemsize == 2 else "I", x.ids).tobytes() for x in done]

    def _together(self, group: list[str], text: str, bounds) -> zip[tuple[str, bytes]]:
        """Parts that are encoded as one text, with their ids; ``bounds`` finds where each begins and ends among its ids."""
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        raw, w = ids.tobytes(), self.dtype.itemsize
        begins, ends = bounds(ids)
        found = [raw[a:b] for a, b in zip((begins * w).tolist(), (ends * w).tolist(), strict=True)]
        return zip(group, found, strict=True)

    def _sure(self, new: list[str], out: dict[str, bytes]) -> None:
        """Adds words of letters; in a byte-level vocabulary any parts."""
        for at in range(0, len(new), TOGETHER):
            group = new[at : at + TOGETHER]
            if self.ends is not None:
                def bounds(ids):
                    ends = np.flatnonzero(self.ends[ids]) + 1
                    return np.concatenate([[0], ends[:-1]]), ends
            else:
                goal = np.cumsum([len(c.encode()) + 1 for c in group])

                def bounds(ids, goal=goal):
                    ends = np.searchsorted(np.cumsum(self.lengths[ids]), goal) + 1
                    return np.concatenate([[0], ends[:-1]]), ends
            out.update(self._together(group, " " + " ".join(group), bounds))

    def _marked(self, new: list[str], out: dict[str, bytes]) -> None:
        cut = len(self.mark)

        def bounds(ids):
            ends = np.flatnonzero(ids == self.mark[-1]) + 1
            return np.concatenate([[0], ends[:-1]]), ends - cut

        for at in range(0, len(new), TOGETHER):
            group = new[at : at + TOGETHER]
            out.update(self._together(group, "".join(f" {c} {MARK}" for c in group), bounds))

    def _learn(self, new: Iterable[str], out: dict[str, bytes]) -> None:
        """Adds the ids of different parts that are not odd, each with the blank before it."""
        words, tailed, others = [], {}, []
        for c in new:
            # The test of ``word``, without a call for each part.
            if c.isalpha() and (c.isascii() or max(c) < SAFE):
                words.append(c)
            elif self.splits and c[-1] in TAILS and word(base := c.rstrip(TAILS)) and len(c) - len(base) <= TAIL:
                tailed[c] = base
            else:
                others.append(c)
        if tailed:
            bases = set(tailed.values()).difference(words)
            known = {c: ids for c in bases if (ids := self.rest.get(c) or self.before.get(c)) is not None}
            words += bases.difference(known)
            out.update(known)
        if self.lengths is not None:
            self._sure([*words, *others], out)
        elif self.ends is not None:
            self._sure(words, out)
            self._marked([c for c in others if MARK not in c], out)
        else:
            others += words
            self._marked([c for c in others if MARK not in c], out)
        alone = [c for c in others if MARK in c and c not in out]
        out.update(zip(alone, self._plain([f" {c}" for c in alone]), strict=True))
        if len(self.tails) > 10_000:
            self.tails = {}
        for c, base in tailed.items():
            tail = c[len(base) :]
            if tail not in self.tails:
                self.tails[tail] = self._plain([tail])[0]
            out[c] = out[base] + self.tails[tail]

    def _keep(self, where: dict[str, bytes], new: dict[str, bytes]) -> None:
        if max(map(len, new), default=0) > LONGEST:
            new = {c: ids for c, ids in new.items() if len(c) <= LONGEST}
        where.update(new)
        self.size += ENTRY * len(new)

    def _found(self, wanted: list[str]) -> list[bytes | None]:
        """Ids of different parts with the blank before each; None for odd ones: empty, or with white space at an end that counts."""
        found = list(map(self.rest.get, wanted))
        gaps = [k for k, ids in enumerate(found) if ids is None]
        if self.collapses:
            missing = [c for k in gaps if (c := wanted[k])]
        else:  # stripping leaves what is not odd as it is
            missing = [c for k in gaps if (c := wanted[k]) and c.strip() == c]
        before = self.before
        new = {c: before[c] for c in missing if c in before} if before else {}
        self._learn([c for c in missing if c not in new] if new else missing, new)
        self._keep(self.rest, new)
        for k in gaps:
            found[k] = new.get(wanted[k])
        return found

    def _folded(self, dictionary: pa.Array) -> pa.Array:
        """Ids of different parts with the blank before each (empty parts: none), where no part is odd."""
        low = dictionary
        if self.lowers:  # safe characters have one lower case each, and no accent of their own to be joined with
            low = pc.if_else(pc.match_substring_regex(low, _UNSAFE), low, pc.utf8_lower(low))
        marks = pc.utf8_ltrim(low, characters=LETTERS)
        n = pc.binary_length(marks)
        tailed = pc.and_(pc.equal(pc.ascii_ltrim(marks, characters=TAILS), ""),
                         pc.and_(pc.less_equal(n, TAIL), pc.less(n, pc.binary_length(low))))
        base = pc.if_else(tailed, pc.ascii_rtrim(low, characters=TAILS), low).dictionary_encode()
        tail = pc.if_else(tailed, marks, "").dictionary_encode()
        found = self._found(base.dictionary.to_numpy(zero_copy_only=False).tolist())
        bases = pa.array(found, pa.large_binary()).fill_null(b"").take(base.indices)
        tails = pa.array(self._plain(tail.dictionary.to_pylist()), pa.large_binary()).take(tail.indices)
        return pc.binary_join_element_wise(bases, tails, pa.scalar(b"", pa.large_binary()))

    def _first(self, wanted: list[str]) -> list[bytes]:
        """Ids of the first parts of texts."""
        missing = [c for c in dict.fromkeys(wanted) if c not in self.heads]
        new = dict(zip(missing, self._plain(missing), strict=True))
        self._keep(self.heads, new)
        return [new[c] if c in new else self.heads[c] for c in wanted]

    def _spaced(self, text: str) -> bytes:
        """White space other than single blanks: cut only where it is safe, parts that hold or end in white space by themselves."""
        head, *cut = _CUT.split(text)
        wanted = list(dict.fromkeys(cut))
        found = dict(zip(wanted, self._found(wanted), strict=True))
        ends = [c for c in wanted if found[c] is None]
        found.update(zip(ends, self._plain([f" {c}" for c in ends]), strict=True))
        return self._first([head])[0] + b"".join(map(found.__getitem__, cut))

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of texts, without nulls."""
        if not len(texts):
            return []
        if self.size > self.cache_size:
            self.before, self.rest, self.heads, self.size = self.rest, {}, {}, 0
        own = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        lists = pc.split_pattern(pc.replace_substring(own, "\n", " ") if self.collapses else own, " ")
        coded = lists.flatten().dictionary_encode()
        codes, begins = coded.indices.to_numpy(), lists.offsets.to_numpy()
        heads = [b""] * len(own)
        if self.collapses:  # first parts are like the others, and none is odd
            last, known = begins[1:], self._folded(coded.dictionary)
        else:
            dictionary = coded.dictionary.to_numpy(zero_copy_only=False)
            first = np.zeros(len(codes), bool)
            first[begins[:-1]] = True
            heads = self._first(dictionary[codes[first]].tolist())
            codes, begins = codes[~first], begins - np.arange(len(begins))
            last = begins[1:]
            used = np.zeros(len(dictionary), bool)
            used[codes] = True
            wanted = np.flatnonzero(used)
            found = self._found(dictionary[wanted].tolist())
            slot = np.zeros(len(dictionary), np.int32)
            slot[wanted] = np.arange(len(wanted), dtype=np.int32)
            codes = slot[codes]
            known = pa.array(found, pa.large_binary()).fill_null(b"")
        # Taking binary values by code lays the ids of all texts out one after the other.
        taken = known.take(pa.array(codes))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[np.concatenate([[0], last])].tolist()
        raw = taken.buffers()[2]
        raw = memoryview(raw) if raw else b""
        out = [h + bytes(raw[a:b]) for h, a, b in zip(heads, ends, ends[1:])]
        if not self.collapses and None in found:
            strange = np.fromiter((ids is None for ids in found), bool, len(found))
            for i in np.unique(np.searchsorted(last, np.flatnonzero(strange[codes]), side="right")).tolist():
                out[i] = self._spaced(own[i].as_py())
        return out


def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process, for the file asked for last."""
    return held(f"tokenizer {path}", lambda: ChunkEncoder(path))
