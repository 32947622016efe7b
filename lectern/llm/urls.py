"""URL verdicts: rules on host and path first, then logistic regression on hashed character n-grams.

All work on the pages is DataFrame expressions without a shuffle. The model is
fitted on the driver, from at most ``PER_CLASS`` labelled URLs of each class.

Defined cases: a null URL or one without ``://`` has an empty host and path and
fits no rule; of rules that fit, the longest wins, then the one with the longer
host, then the first by text; without labelled URLs of both classes the method
says what the labels say, ``allow`` without any; rows that repeat an id each have a row;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

DIMENSIONS = 1 << 13
GRAM = 4
#: URLs of each class that are learned from, at most.
PER_CLASS = 2000
EPOCHS = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A host with its subdomains and the beginning of a path, as in ``example.net/en/``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The text of the longest rule that fits, or null. Rules are a short list that is set up by hand."""
    order = sorted(set(rules), key=lambda r: (-len(r.text), -len(r.host), r.text))
    fits = [F.when(((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path), F.lit(r.text)) for r in order]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def grams(host: Column, path: Column) -> Column:
    """Places of the different character n-grams of host and path."""
    def of(text: Column, name: str) -> Column:
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - (GRAM - 1), F.lit(1))), lambda i: F.pmod(
            F.xxhash64(F.substring(marked, i, F.lit(GRAM)), F.lit(name)), F.lit(DIMENSIONS)).cast("int"))

    return F.array_distinct(F.concat(of(host, "host"), of(path, "path")))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def logit(self, host: Column, path: Column) -> Column:
        # One constant array; element by element it would be thousands of expressions.
        table = F.split(F.lit(",".join(f"{w:.9g}" for w in self.weights)), ",").cast("array<double>")
        return F.aggregate(grams(host, path), F.lit(float(self.bias)), lambda a, g: a + F.get(table, g))


def fit(places: list[list[int]], labels: list[int], epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-3) -> Model:
    """Logistic regression by gradient descent with momentum; label 1 means block."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(DIMENSIONS), 10.0 if len(y) and y[0] else -10.0)
    row = np.repeat(np.arange(len(y)), [len(p) for p in places])
    at = np.concatenate([np.array(p, np.int64) for p in places])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w, b, mw, mb = np.zeros(DIMENSIONS), 0.0, np.zeros(DIMENSIONS), 0.0
    for _ in range(epochs):
        z = b + np.bincount(row, w[at], len(y))
        g = (1 / (1 + np.exp(-z.clip(-60, 60))) - y) * weight
        mw = 0.9 * mw + np.bincount(at, g[row], DIMENSIONS) + decay * w
        mb = 0.9 * mb + g.sum()
        w, b = w - rate * mw, b - rate * mb
    return Model(w, b)


def train(labelled: DataFrame, url: str = "url", label: str = "blocked", per_class: int = PER_CLASS) -> Model:
    """Learn from a small table of URLs and labels (1: block); the URLs of each class with the lowest hashes are used."""
    rows = labelled.where(F.col(url).isNotNull() & F.col(label).isin(0, 1)).select(
        F.col(url).alias("url"), F.col(label).cast("int").alias("label")).distinct()
    order = F.xxhash64("url")
    some = rows.where("label = 0").orderBy(order, "url").limit(per_class).unionByName(
        rows.where("label = 1").orderBy(order, "url").limit(per_class))
    host, path = host_path(F.col("url"))
    found = sorted((r["label"], r["grams"]) for r in some.select("label", grams(host, path).alias("grams")).collect())
    return fit([g for _, g in found], [n for n, _ in found])


def labelled_by_rules(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """URLs that a rule decides, with its verdict as the label."""
    host, path = host_path(F.col(url))
    blocks = [r.text for r in rules if r.verdict == "block"]
    rows = pages.select(F.col(url).alias("url"), rule_of(host, path, rules).alias("rule")).where("rule is not null")
    return rows.select("url", F.col("rule").isin(blocks).cast("int").alias("blocked"))


def judge(pages: DataFrame, rules: Sequence[Rule], model: Model, url: str = "url", key: str = "page_id") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    blocks = [r.text for r in rules if r.verdict == "block"]
    learned = F.when(model.logit(F.col("host"), F.col("path")) >= 0, "block").otherwise("allow")
    ruled = F.when(F.col("rule").isin(blocks), "block").otherwise("allow")
    return rows.withColumn("verdict", F.when(F.col("rule").isNotNull(), ruled).otherwise(learned))
