"""Language of texts by one interpolated Kneser-Ney character model per language.

Texts become lower-case letters with one blank for every run of anything else.
n-grams of all learning rows are counted (per task first); the models are sorted
arrays of n-gram hashes with one probability per language. A text goes to the
language of lowest cross-entropy in bits per character. It is rejected where
that is higher than a bound calibrated on all learning rows of its language: mean, plus
``SPREADS`` deviations scaled by the root of the length, plus ``SLACK`` bits.

Defined cases: a null text and one without letters are ``und``, score 0,
rejected; without learning rows every text is; rows with a null language or id
are not learned from; a language with one learning row has the deviation of all
languages together; ties go to the language that sorts first; rows that repeat are learned from and
judged each by itself; an empty table gives no rows.
No n-gram is left out; the models of all of them are built on the driver and sent to every task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm.common import grouped, held, stored, training_rows

ORDER = 4
#: Different n-grams of a language a task adds up before it hands their counts on.
TASK_NGRAMS = 500_000
SPREADS = 8.0
SLACK = 1.0
#: Characters that count at most for the score, so that it keeps grades below one.
SCORE_CHARS = 24
UNKNOWN = "und"
#: An odd constant for polynomial hashes of n-grams.
BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTER: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Code points of the text in its model form; 0 stands for a blank."""
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    code = np.where(_LETTER[0][code], code, 0).astype(np.uint32)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    code = code[keep]
    return code[1:] if len(code) and not code[0] else code


def windows(codes: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, ``order - 1`` blanks before each and one after; and the places of their characters."""
    gap = np.zeros(order - 1, np.uint32)
    out, places, at = [], [], 0
    for c in codes:
        if len(c):
            closed = c if not c[-1] else np.append(c, np.uint32(0))
            out += [gap, closed]
            places.append(np.arange(at + len(gap), at + len(gap) + len(closed)))
            at += len(gap) + len(closed)
    return (np.concatenate(out), np.concatenate(places)) if out else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def hashes(code: np.ndarray, order: int) -> list[np.ndarray]:
    """For k up to ``order``, the hash of the k characters that end at each place."""
    own = code.astype(np.uint64) + np.uint64(1)
    out = [np.zeros(len(code), np.uint64)]
    for _ in range(order):
        before = np.concatenate([np.zeros(1, np.uint64), out[-1][:-1]]) if len(code) else out[-1]
        out.append(before * BASE + own)
    return out


def _count(batches, order: int):
    """Counts of n-grams as (lang, first two characters, last two, n), added up within the task."""
    kept: dict[str, list] = {}
    held("language")

    def merge(parts):
        key, n, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        found, first, back = np.unique(key, return_index=True, return_inverse=True)
        return found, np.bincount(back, n, len(found)).astype(np.int64), at[first]

    def rows(lang, parts):
        _, n, at = merge(parts)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(at[:, 0]), pa.array(at[:, 1]),
                                           pa.array(n)], ["lang", "high", "low", "n"])

    for (langs,), texts in grouped(batches):
        by: dict[str, list[np.ndarray]] = {}
        for lang, t in zip(langs, texts, strict=True):
            by.setdefault(lang, []).append(letters(t))
        for lang, codes in by.items():
            code, place = windows(codes, order)
            key, first, n = np.unique(hashes(code, order)[order][place], return_index=True, return_counts=True)
            c = code.astype(np.int64)
            i = place[first]
            at = np.stack([c[i - 3] << 21 | c[i - 2], c[i - 1] << 21 | c[i]], 1)
            kept.setdefault(lang, []).append((key, n, at))
            if len(kept[lang]) >= 16:
                kept[lang] = [merge(kept[lang])]
                if len(kept[lang][0][0]) > TASK_NGRAMS:
                    yield rows(lang, kept.pop(lang))
    for lang, parts in kept.items():
        yield rows(lang, parts)


def count_ngrams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows (lang, high, low, n): the characters of each 4-gram, two and two, and its count in all texts."""
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(lambda b: _count(b, ORDER), "lang string, high long, low long, n long")
    return found.groupBy("lang", "high", "low").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Sorted n-gram hashes and, per language, probabilities; contexts and what they leave to shorter ones."""

    langs: list[str]
    grams: list[np.ndarray]  # by order; sorted hashes
    probs: list[np.ndarray]  # by order; a row for each hash, a column for each language
    contexts: list[np.ndarray]  # by order of the n-gram; sorted hashes of its context
    lefts: list[np.ndarray]
    floor: float
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None

    def prob(self, k: int, gram: list[np.ndarray], context: list[np.ndarray]) -> np.ndarray:
        """Probabilities of n-grams of order k by hash; ``gram[j]`` and ``context[j]`` for all shorter ones too."""
        if k == 0:
            return np.full((len(gram[0]), len(self.langs)), self.floor)
        at = np.minimum(np.searchsorted(self.grams[k], gram[k]), len(self.grams[k]) - 1)
        hit = self.grams[k][at] == gram[k]
        out = self.probs[k][at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            out[miss] = self.left(k, context[k][miss]) * self.prob(k - 1, [g[miss] for g in gram[:k]], [c[miss] for c in context[:k]])
        return out

    def left(self, k: int, context: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
        return np.where((self.contexts[k][at] == context)[:, None], self.lefts[k][at], 1.0)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of each text under each language, and its number of characters."""
        codes = [letters(t) for t in texts]
        n = np.array([len(c) + bool(len(c) and c[-1]) for c in codes], np.int64)
        out = np.full((len(texts), len(self.langs)), np.inf)
        code, place = windows(codes, ORDER)
        some = np.flatnonzero(n)
        if not len(some) or not self.langs:
            return out, n
        logs = np.empty((len(place), len(self.langs)))
        grams = hashes(code, ORDER)
        for a in range(0, len(place), 1 << 17):
            p = place[a : a + (1 << 17)]
            gram = [g[p] for g in grams]
            context = [gram[0], *(grams[k - 1][p - 1] for k in range(1, ORDER + 1))]
            logs[a : a + len(p)] = np.log2(self.prob(ORDER, gram, context))
        first = np.cumsum(n[some]) - n[some]
        out[some] = -np.add.reduceat(logs, first, axis=0) / n[some, None]
        return out, n

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score from 0 to 1, bits per character, and whether the text is rejected."""
        bits, n = self.entropies(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
        known = n > 0
        best = bits.argmin(1)
        low = bits[np.arange(len(texts)), best]
        gaps = np.where(known[:, None], np.minimum(n, SCORE_CHARS)[:, None] * np.nan_to_num(bits - low[:, None]), 0)
        score = np.where(known, 1 / np.exp2(-gaps).sum(1), 0.0)
        bound = self.mean[best] + SPREADS * self.spread[best] / np.sqrt(np.maximum(n, 1)) + SLACK
        langs = [self.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
        return langs, score, np.where(known, low, np.nan), ~known | (low > bound)


def build(langs: list[str], which: np.ndarray, high: np.ndarray, low: np.ndarray, n: np.ndarray) -> Model:
    """Models from counts of 4-grams; ``which`` is the language of each row as a place in ``langs``."""
    mask = np.int64((1 << 21) - 1)
    chars = np.stack([high >> 21, high & mask, low >> 21, low & mask], 1).astype(np.uint64) + np.uint64(1)
    size = max(1, len(np.unique(chars[:, -1])))
    grams, contexts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    counts: list[np.ndarray] = [np.zeros(0)]
    gram_context: list[np.ndarray] = [np.zeros(0, np.uint64)]
    shorter: list[np.ndarray] = [np.zeros(0, np.uint64)]
    rows, weight, owner = chars, n.astype(np.float64), which
    tables = []
    for k in range(ORDER, 0, -1):
        key, context = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint64)
        for j in range(k):
            key = key * BASE + rows[:, j]
            if j < k - 1:
                context = context * BASE + rows[:, j]
        found, first, back = np.unique(key, return_index=True, return_inverse=True)
        table = np.zeros((len(found), len(langs)))
        np.add.at(table, (back, owner), weight)
        tail = np.zeros(len(found), np.uint64)
        for j in range(1, k):
            tail = tail * BASE + rows[first][:, j]
        tables.append((found, table, context[first], tail))
        # Lower orders count in how many different contexts an n-gram stands.
        again, at = np.nonzero(table)
        rows, owner, weight = rows[first][again][:, 1:], at, np.ones(len(again))
    for found, table, context, tail in reversed(tables):
        grams.append(found)
        counts.append(table)
        gram_context.append(context)
        shorter.append(tail)
    model = Model(langs, grams, [np.zeros((0, len(langs)))], contexts, [np.zeros((0, len(langs)))], 1.0 / (size + 1))
    for k in range(1, ORDER + 1):
        table, context = counts[k], gram_context[k]
        once, twice = (table == 1).sum(0), (table == 2).sum(0)
        cut = np.where(once + 2 * twice > 0, once / np.maximum(once + 2 * twice, 1), 0.5).clip(0.1, 0.9)
        heads, back = np.unique(context, return_inverse=True)
        total, kinds = np.zeros((len(heads), len(langs))), np.zeros((len(heads), len(langs)))
        np.add.at(total, back, table)
        np.add.at(kinds, back, (table > 0).astype(float))
        left = np.where(total > 0, cut * kinds / np.maximum(total, 1), 1.0)
        contexts.append(heads)
        model.lefts.append(left)
        lower = (np.full(table.shape, model.floor) if k == 1 else
                 model.probs[k - 1][np.searchsorted(grams[k - 1], shorter[k])])
        model.probs.append(np.maximum(table - cut, 0) / np.maximum(total, 1)[back] + left[back] * lower)
    return model


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Learn from ``text`` and ``lang`` of the learning rows; the model holds every n-gram of theirs."""
    rows = docs.where(training_rows(key))
    counts = stored(count_ngrams(rows, text, lang), "ngrams")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    place = {x: i for i, x in enumerate(langs)}
    at = F.array_position(F.array(*map(F.lit, langs)).cast("array<string>"), F.col("lang")) - 1
    found = counts.select(at.cast("int").alias("at"), "high", "low", "n").toArrow()
    which, high, low, n = (found[c].to_numpy() for c in ("at", "high", "low", "n"))
    order = np.lexsort((low, high, which))
    model = build(langs, which[order], high[order], low[order], n[order])
    if not langs:
        return model
    known = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        held("language")
        for (own,), texts in grouped(batches):
            bits, n = shared.value.entropies(texts)
            at = np.array([place.get(x, -1) for x in own])
            ok = (n > 0) & (at >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(at[ok]), pa.array(n[ok]), pa.array(bits[ok, at[ok]])], ["at", "n", "bits"])

    measured = known.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).mapInArrow(
        measure, "at long, n long, bits double")
    # Sums for each language alone reach the driver; long texts weigh by their length.
    sums = measured.groupBy("at").agg((F.sum(F.col("bits") * F.col("n")) / F.sum("n")).alias("mean"),
                                      F.avg(F.col("bits") * F.col("bits") * F.col("n")).alias("b2"),
                                      F.avg(F.col("bits") * F.col("n")).alias("b1"), F.avg("n").alias("b0"),
                                      F.count("*").alias("rows")).collect()
    model.mean, model.spread = np.zeros(len(langs)), np.zeros(len(langs))
    rows_of = np.zeros(len(langs), np.int64)
    for r in sums:
        m = r["mean"]
        rows_of[r["at"]], model.mean[r["at"]] = r["rows"], m
        model.spread[r["at"]] = np.sqrt(max(r["b2"] - 2 * m * r["b1"] + m * m * r["b0"], 0.0))
    several = rows_of > 1
    # One row has no deviation of its own.
    model.spread[~several] = np.sqrt(np.average(model.spread[several] ** 2, weights=rows_of[several])) if several.any() else 1.0
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, bits per character, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        held("language")
        for (keys,), texts in grouped(batches):
            langs, score, bits, rejected = shared.value.judge(texts)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(langs, pa.string()), pa.array(score),
                                              pa.array(bits, from_pandas=True), pa.array(rejected)],
                                             ["doc_id", "lang_pred", "score", "bits_per_char", "rejected"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, bits_per_char double, rejected boolean")


def accepted(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """True for texts whose language the model knows; a condition on the rows as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def keep(texts: pd.Series) -> pd.Series:
        held("language")
        plain = [x or "" for x in texts]
        out, first = [], 0
        while first < len(plain):
            last, size = first, 0
            while last < len(plain) and (last == first or size + len(plain[last]) <= 1 << 20):
                size += len(plain[last])
                last += 1
            out.append(~shared.value.judge(plain[first:last])[3])
            first = last
        return pd.Series(np.concatenate(out) if out else np.zeros(0, bool))

    return keep(F.col(text).cast("string"))
