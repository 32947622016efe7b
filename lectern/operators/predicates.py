"""Metadata conditions (nested dicts) as one boolean ``Column``."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, functions as F

RANGE_OPS = {
    "$gt": Column.__gt__,
    "$gte": Column.__ge__,
    "$lt": Column.__lt__,
    "$lte": Column.__le__,
}
# Provenance keys are columns of every collection, so conditions on them reach
# the scan and prune partitions.
PROVENANCE = ("source_db", "source_table")


def _word(value: Any) -> str:
    return str(value)


def _condition(value: Column, condition: Any) -> Column:
    """A missing key compares as the text ``None``; ranges need a number."""
    text = F.coalesce(value, F.lit("None"))
    if not isinstance(condition, Mapping):
        return text == _word(condition)
    if len(condition) != 1:
        raise ValueError(f"one operator per condition, got {dict(condition)!r}")
    op, operand = next(iter(condition.items()))
    if op == "$eq":
        return text == _word(operand)
    if op == "$ne":
        return text != _word(operand)
    if op == "$in":
        return text.isin([_word(o) for o in operand])
    if op == "$nin":
        return ~text.isin([_word(o) for o in operand])
    if op in RANGE_OPS:
        bound = F.lit(float(operand))
        return F.coalesce(RANGE_OPS[op](value.try_cast("double"), bound), F.lit(False))
    raise ValueError(f"unknown operator {op!r}")


def compile_where(where: Mapping[str, Any], columns: Mapping[str, Column] | None = None,
                  metadata: str = "metadata") -> Column:
    """``where`` as a Column. Keys in ``columns`` read that column, others the metadata map."""
    named = columns or {}

    def value(key: str) -> Column:
        if key in named:
            return named[key].cast("string")
        return F.col(key) if key in PROVENANCE else F.col(metadata).getItem(key)

    clauses: list[Column] = []
    for key, condition in where.items():
        if key in ("$and", "$or"):
            if len(where) != 1:
                raise ValueError(f"{key} takes no sibling keys")
            inner = [compile_where(w, columns, metadata) for w in condition]
            empty = F.lit(key == "$and")
            join = Column.__and__ if key == "$and" else Column.__or__
            return reduce(join, inner) if inner else empty
        if key.startswith("$"):
            raise ValueError(f"unknown operator {key!r}")
        clauses.append(_condition(value(key), condition))
    return reduce(Column.__and__, clauses) if clauses else F.lit(True)


def scope(db: str | None = None, table: str | None = None) -> Column:
    """Restriction to a database and/or a table."""
    parts = []
    if db:
        parts.append(F.col("source_db") == db)
    if table:
        parts.append(F.col("source_table") == table)
    return reduce(Column.__and__, parts) if parts else F.lit(True)
