"""Slots for user models: vectorised functions set up once per task.

Each slot takes a factory that builds the model inside the task, so that
nothing heavy is shipped with the plan. The calls are marked as not
deterministic, so that the optimizer never copies them. The defaults elsewhere in the package
are deterministic SQL expressions and need no slot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
PairScorer = Callable[[Sequence[str], Sequence[str]], Sequence[float]]
Generator = Callable[..., Sequence[str]]  # (questions, contexts), and system= and temperature= where these are set


def _tried(call: Callable, tries: int):
    """Result of ``call``, or None when every try failed."""
    for _ in range(tries):
        try:
            return call()
        except Exception:
            continue
    return None


def _embed_batch(model: Embedder, texts: list[str], dim: int, tries: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and success flags. A failing batch is taken apart to find the failing texts."""
    whole = _tried(lambda: np.asarray(model(texts), dtype=np.float32).reshape(len(texts), dim), tries)
    if whole is None:
        rows = [_tried(lambda t=t: np.asarray(model([t])[0], dtype=np.float32).reshape(dim), tries) for t in texts]
        ok = np.array([r is not None for r in rows], dtype=bool)
        whole = np.stack([np.zeros(dim, np.float32) if r is None else r for r in rows])
    else:
        ok = np.ones(len(texts), dtype=bool)
    length = np.sqrt((whole.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return (whole / np.where(length == 0, 1.0, length)).astype(np.float32), ok


def embed_with(factory: Callable[[], Embedder], text: Column, dim: int, batch_size: int = 16, tries: int = 3) -> Column:
    """``struct<embedding, embed_ok>``; a text that fails ``tries`` times gets a zero vector."""
    @F.pandas_udf("embedding array<float>, embed_ok boolean")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()
        for texts in batches:
            values = texts.fillna("").tolist()
            parts = [_embed_batch(model, values[i:i + batch_size], dim, tries)
                     for i in range(0, len(values), batch_size)]
            yield pd.DataFrame({
                "embedding": [v for p in parts for v in p[0]],
                "embed_ok": [bool(o) for p in parts for o in p[1]],
            })

    return embed.asNondeterministic()(text)


def score_with(factory: Callable[[], PairScorer], question: Column, text: Column) -> Column:
    """Score per (question, text); NULL where the model fails."""
    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for questions, texts in batches:
            q, t = questions.tolist(), texts.tolist()
            out = _tried(lambda: [float(s) for s in model(q, t)], 1)
            if out is None:
                single = [_tried(lambda a=a, b=b: float(model([a], [b])[0]), 1) for a, b in zip(q, t)]
                out = [np.nan if s is None else s for s in single]
            yield pd.Series(pd.array(out, "Float64")).where(~pd.isna(pd.Series(out, dtype="float64")), pd.NA)

    return score.asNondeterministic()(question, text)


def generate_with(factory: Callable[[], Generator], question: Column, context: Column, *, system: str | None = None,
                  temperature: float | None = None) -> Column:
    """Text per (question, context); NULL where the model fails.

    A ``system`` text and a ``temperature`` are handed to the model as keyword
    arguments if they are given.
    """
    given = {k: v for k, v in (("system", system), ("temperature", temperature)) if v is not None}

    @F.pandas_udf("string")
    def generate(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for questions, contexts in batches:
            q, c = questions.tolist(), contexts.tolist()
            out = _tried(lambda: list(model(q, c, **given)), 1)
            if out is None:
                out = [_tried(lambda a=a, b=b: model([a], [b], **given)[0], 1) for a, b in zip(q, c)]
            yield pd.Series(out, dtype="object")

    return generate.asNondeterministic()(question, context)
