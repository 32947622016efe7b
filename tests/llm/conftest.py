from __future__ import annotations

import pytest

#: Columns whose names the operators use themselves.
CLASH = "score double, fp string, component_id string, _rows long, n long, ids string, length string, label string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()
ODD = [None, "", " ", "\n\n", "a", "a  b", " lead", "trail ", "tab\tand\nline", "a \n b", "\x01 mark \x01", "é ́ ñ Ω ΑΣ", "日本 語",
       "<|endoftext|> <|im_start|> x", "don't 'S it's", "1 2 34 5!! ...", "😀 a😀b", "a\u2003b \x1c c", "!!!", "ÀB İ ẞ"]


def sentence(k: int, n: int = 12) -> str:
    return " ".join(WORDS[(k * 7 + i * i) % len(WORDS)] for i in range(n)) + f" {k}."


def texts() -> list[str | None]:
    long = " ".join(sentence(i, 40) for i in range(400)) + "\n" + "\n".join(sentence(i) for i in range(60))
    same = "\n".join(sentence(i) for i in range(5))
    return [*ODD, long, same, same, same + " more", *(sentence(i) + "\n" + sentence(i + 1) for i in range(12))]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd and long texts, equal rows, a repeated id, a null id, and extra columns with clashing names."""
    rows = [(i, t) for i, t in enumerate(texts())] + [(5, "a  b"), (7, "another text of id 7"), (None, "no id"), (None, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    clash = ", ".join(f"cast('9' as {c.split()[1]}) as {c.split()[0]}" for c in CLASH.split(", "))
    return plain.selectExpr("*", clash) if "," not in clash else plain.selectExpr("*", *clash.split(", "))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
