"""Vector arithmetic in JVM expressions, and the hashed term embedding."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from lectern.functions.text import let

HASHED_DIM = 256
TOKENS_KEPT = 200_000
#: Longer tokens are hashed each time, so that the kept ones have a bounded size.
TOKEN_KEPT_CHARS = 64
#: Texts that are counted side by side.
TEXTS_AT_ONCE = 64
_TOKEN = re.compile(r"[^\W_]+")  # letters and numbers, as the tokens of the text functions


class _Places(dict):
    """Places of tokens in a vector; up to ``TOKENS_KEPT`` are remembered."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        place = _bucket(token, self.dim)
        if len(token) <= TOKEN_KEPT_CHARS:
            if len(self) >= TOKENS_KEPT:
                self.clear()
            self[token] = place
        return place


_PLACES: dict[int, _Places] = {}


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    def scaled(parts: Column) -> Column:
        length = F.when(parts["n"] == 0.0, F.lit(1.0)).otherwise(parts["n"])
        return F.transform(parts["v"], lambda x: (x.cast("double") / length).cast("float"))

    return F.when(v.isNotNull(), let(F.struct(norm(v).alias("n"), v.alias("v")), scaled))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def _bucket(token: str, dim: int) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim


def _unit_counts(texts: list[str], places: _Places) -> np.ndarray:
    """Term frequencies of texts by place, unit length: one row per text."""
    sizes, flat = [], []
    for text in texts:
        before = len(flat)
        flat.extend(map(places.__getitem__, _TOKEN.findall(text)))
        sizes.append(len(flat) - before)
    rows = np.repeat(np.arange(len(texts)) * places.dim, sizes)
    tf = np.bincount(rows + np.array(flat, np.int64), minlength=len(texts) * places.dim).reshape(-1, places.dim)
    length = np.sqrt(np.einsum("ij,ij->i", tf, tf))
    length[length == 0] = 1.0
    return (tf / length[:, None]).astype(np.float32)


def embed_hashed(text: Column, dim: int = HASHED_DIM) -> Column:
    """Default embedder: hashed term frequencies, unit length.

    Works on slices of Arrow batches, so that a worker never holds a batch of texts and vectors as Python objects, and
    remembers the places of up to ``TOKENS_KEPT`` tokens; hashing token by token in SQL took twice as long.
    """
    @F.arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        places = _PLACES.setdefault(dim, _Places(dim))
        out = np.empty((len(texts), dim), np.float32)
        for start in range(0, len(texts), TEXTS_AT_ONCE):
            part = texts.slice(start, TEXTS_AT_ONCE).to_pylist()
            out[start : start + len(part)] = _unit_counts(part, places)
        offsets = np.arange(0, out.size + 1, dim, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.reshape(-1)))

    return embed(F.lower(F.coalesce(text, F.lit(""))))
