"""Language and toxicity scores against plain versions."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pytest

from lectern.llm import toxicity


def plain_noisy_or(weights, bias, text):
    """One minus the product, over sentences with words, of one minus the logistic of the bias and the words' weights."""
    clean = 1.0
    for sentence in re.split(r"[.!?\n]", text):
        if not sentence.strip():
            continue
        z = bias
        for word in set(sentence.split()):
            bare = re.sub(r"^\W+|\W+$", "", word.lower())
            if bare:
                z += sum(weights[zlib.crc32(name.encode()) % len(weights)] for name in (f"w{bare}", f"4{bare[:4]}", f"5{bare[:5]}"))
        clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def test_noisy_or_of_plain_code():
    rng = np.random.default_rng(5)
    weights = np.where(rng.random(toxicity.DIMENSIONS) < 0.3, rng.random(toxicity.DIMENSIONS) * 2, 0).astype(np.float32)
    model = toxicity.Model(weights, -3.0)
    texts = ["", " ", "...", "Bad bad word. Another one!\nÜber, (nice) words... a a a", "one", "x" * 300 + " tail? yes", "'quoted' -- dash"]
    for text in texts:
        assert model.score(text)[0] == pytest.approx(plain_noisy_or(weights, -3.0, text), abs=1e-6)


@pytest.mark.parametrize("toxic", [5, 8, 30])
def test_rare_words_are_learned(toxic):
    """No feature is thrown away for being rare: a word of a few toxic documents tells more of them, and no clean one."""
    import pyarrow as pa

    rng = np.random.default_rng(toxic)
    vocabulary = [f"word{i}" for i in range(400)]

    def doc(bad):
        return " ".join(rng.choice(vocabulary, 30)) + (" zorkbad" if bad else "") + ". " + " ".join(rng.choice(vocabulary, 20))

    rows = [(1, doc(True)) for _ in range(toxic)] + [(0, doc(False)) for _ in range(200)]
    batch = pa.RecordBatch.from_pydict({"label": [a for a, _ in rows], "text": [t for _, t in rows]})
    bags = [(int(r["label"]), r["sizes"], r["places"]) for out in toxicity._bags([batch]) for r in out.to_pylist()]
    model = toxicity.fit(bags)
    assert sum(model.score(doc(False))[0] >= 0.7 for _ in range(100)) == 0
    assert sum(model.score(doc(True))[0] >= 0.7 for _ in range(100)) >= {5: 10, 8: 80, 30: 95}[toxic]
