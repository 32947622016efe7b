"""Toxicity of documents by multiple-instance learning over their sentences.

A sentence scores by logistic regression on its hashed different words and their beginnings; a
document is toxic unless every sentence is clean (noisy-or). Words only add to a score. The weights are
learned from document labels alone, on at most ``PER_CLASS`` labelled documents
of each class, and then name the offending sentences.

Defined cases: a text without sentences (null, empty, blank) scores 0; rows with
a null label or id are not learned from; a document labelled more than once
counts by its highest label; of rows that repeat an id the text that sorts first is learned from, and
each row is scored; without labels of both classes every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm.common import grouped, held, training_rows

DIMENSIONS = 1 << 18
#: Labelled documents of each class that are learned from, at most.
PER_CLASS = 2500
EPOCHS = 250
RATE = 0.08
#: Decay of every weight, and what the decay of a feature's weight has besides, divided by the documents that hold it.
DECAY, RARE = 1e-4, 3e-3
THRESHOLD = 0.7
CACHE = 200_000
_SENTENCE = re.compile(r"[^.!?\n]+")
_EDGES = re.compile(r"^\W+|\W+$")


def features(word: str) -> tuple[int, ...]:
    """Places of a word and its beginnings, three for each word; none for mere punctuation."""
    w = _EDGES.sub("", word.lower())
    if not w:
        return ()
    named = [f"w{w}", *(f"{n}{w[:n]}" for n in (4, 5))]
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % DIMENSIONS for x in named)


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences that hold a word."""
    return [m.span() for m in _SENTENCE.finditer(text) if m.group().strip()]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    _known: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "_known": {}}

    def word(self, word: str) -> float:
        known = self._known
        value = known.get(word)
        if value is None:
            if len(known) > CACHE:
                known.clear()
            value = known[word] = float(sum(self.weights[f] for f in features(word)))
        return value

    def logits(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        spans = sentences(text)
        word = self.word
        return spans, np.array([self.bias + sum(map(word, dict.fromkeys(text[a:z].split()))) for a, z in spans])

    def score(self, text: str) -> tuple[float, list[tuple[int, int]], np.ndarray]:
        """Noisy-or of the sentences, their spans and their own scores."""
        spans, z = self.logits(text)
        if not len(z):
            return 0.0, spans, z
        return float(-np.expm1(-np.logaddexp(0, z).sum())), spans, 1 / (1 + np.exp(-z.clip(-60, 60)))


def _bags(batches):
    """Rows (label, sizes, places): the label, the number of different words of each sentence, and three feature places for each
    word, ``DIMENSIONS`` where a word has fewer; numbers as little-endian 32-bit integers."""
    for (labels,), texts in grouped(batches):
        rows = []
        for label, text in zip(labels, texts, strict=True):
            words = [[f for w in dict.fromkeys(text[a:z].split()) if (f := features(w))] for a, z in sentences(text)]
            places = [(*f, *[DIMENSIONS] * (3 - len(f))) for s in words for f in s]
            rows.append({"label": label, "sizes": np.array([len(s) for s in words], "<i4").tobytes(),
                         "places": np.array(places, "<i4").tobytes()})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("label", pa.int32()), ("sizes", pa.binary()), ("places", pa.binary())]))


def fit(bags: list[tuple[int, bytes, bytes]], epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY,
        rare: float = RARE) -> Model:
    """Weights that make the noisy-or of the sentences agree with the labels (full-batch Adam).

    The fewer documents hold a feature, the more its weight decays: it may only tell these documents apart.
    """
    bags = [b for b in bags if b[1]]
    labels = np.array([b[0] for b in bags])
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(DIMENSIONS, np.float32), -60.0)
    sizes = [np.frombuffer(b[1], "<i4") for b in bags]
    per_sentence = np.concatenate(sizes).astype(np.int64)
    sentence = np.repeat(np.arange(len(per_sentence)), per_sentence)
    doc = np.repeat(np.arange(len(bags)), [len(s) for s in sizes])
    places = np.concatenate([np.frombuffer(b[2], "<i4").reshape(-1, 3) for b in bags]).astype(np.int64)
    key = (places[:, 0] * (DIMENSIONS + 1) + places[:, 1]) * (DIMENSIONS + 1) + places[:, 2]
    _, first, word = np.unique(key, return_index=True, return_inverse=True)
    owned = places[first]
    once = np.unique(word + len(owned) * doc[sentence])
    # In how many documents each feature is; a feature twice in a document, by two words, counts twice.
    spread = np.bincount(owned[once % len(owned)].ravel(), minlength=DIMENSIONS + 1)
    of_word, column = np.nonzero(owned < DIMENSIONS)
    used, place = np.unique(owned[of_word, column], return_inverse=True)
    weight = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean())
    w, bias = np.zeros(len(used)), -4.0
    decays = decay + rare / spread[used]
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for step in range(1, epochs + 1):
        by_word = np.bincount(of_word, w[place], len(owned))
        z = bias + np.bincount(sentence, by_word[word], len(per_sentence))
        p = 1 / (1 + np.exp(-z.clip(-60, 60)))
        total = np.bincount(doc, np.logaddexp(0, z), len(bags))
        pull = np.where(labels == 1, -1 / np.maximum(np.expm1(np.minimum(total, 60)), 1e-6), 1.0) * weight / len(bags)
        g = pull[doc] * p
        gw = np.bincount(place, np.bincount(word, g[sentence], len(owned))[of_word], len(used)) + decays * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9**step, 1 - 0.999**step
        # Weights stay above zero: a sentence is no cleaner for the harmless words around an offence.
        w = np.maximum(w - rate * (m / a) / (np.sqrt(v / b) + 1e-8), 0.0)
        bias -= rate * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[used] = w
    return Model(weights, float(bias))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic",
          per_class: int = PER_CLASS) -> Model:
    """Learn from the learning rows that ``labels`` marks, a bounded number of each class, chosen by a hash of the id."""
    marked = (labels.where(F.col(label).isin(0, 1) & training_rows(key))
              .groupBy(F.col(key).cast("long").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_label")))
    # Labels may mark documents that are not here: look for twice as many, then keep the first of each class.
    here = docs.select(F.col(key).cast("long").alias("_id")).where(F.col("_id").isNotNull()).distinct()
    order = F.xxhash64("_id")
    known = marked.join(here, "_id", "left_semi")
    chosen = known.where("_label = 1").orderBy(order, "_id").limit(per_class).unionByName(
        known.where("_label = 0").orderBy(order, "_id").limit(per_class))
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).cast("string").alias("text")).join(
        F.broadcast(chosen), "_id").groupBy("_id", "_label").agg(F.min("text").alias("text"))
    found = rows.select("_label", "text", "_id").select(F.col("_label").alias("label"), "text").mapInArrow(
        _bags, "label int, sizes binary, places binary").collect()
    return fit(sorted((r["label"], bytes(r["sizes"]), bytes(r["places"])) for r in found))


def predict(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, score, predicted, and the spans of offending sentences (characters, from 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        held("toxicity")
        for (keys,), texts in grouped(batches):
            rows = []
            for k, t in zip(keys, texts, strict=True):
                score, spans, own = shared.value.score(t)
                rows.append({"doc_id": k, "score": score, "predicted": int(score >= threshold), "offending": [
                    {"start": a, "end": z, "score": float(s)} for (a, z), s in zip(spans, own, strict=True) if s >= 0.5]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()),
                ("offending", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))]))

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double, predicted int, offending array<struct<start:int,end:int,score:double>>")


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> Column:
    """True for texts that score below the threshold; a condition on the rows as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def keep(texts: pd.Series) -> pd.Series:
        held("toxicity")
        return pd.Series([shared.value.score(x or "")[0] < threshold for x in texts], dtype=bool)

    return keep(F.col(text).cast("string"))
