"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.functions.text import WHITESPACE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# SQL spellings of the text rules, used inside the twins.

def sql_clean(expr: str) -> str:
    return f"coalesce(trim(({expr})::VARCHAR, '{WHITESPACE}'), '')"


def sql_value(expr: str) -> str:
    """Cleaned text, NULL when it says nothing."""
    c = sql_clean(expr)
    return f"(CASE WHEN lower({c}) IN ('','none','null','nan','0') THEN NULL ELSE {c} END)"


def sql_join(sep: str, *exprs: str) -> str:
    return f"concat_ws('{sep}', {', '.join(sql_value(e) for e in exprs)})"


def sql_generic(label: str, columns: list[tuple[str, str]]) -> str:
    lines = ", ".join(f"'{title}: ' || {sql_value(col)}" for col, title in columns)
    return f"'{label}' || chr(10) || concat_ws(chr(10), {lines})"


def sql_hash_key(text: str) -> str:
    return f"substr(sha256({text}), 1, 16)"


def sql_html(expr: str) -> str:
    return (
        f"trim(array_to_string(list_filter(list_transform(string_split({expr}, '<'), lambda p, i: "
        "CASE WHEN i = 1 THEN replace(p, '>', '') WHEN instr(p, '>') = 0 THEN '' "
        "ELSE replace(substr(p, instr(p, '>') + 1), '>', '') END), lambda p: p <> ''), ' '), "
        f"'{WHITESPACE}')"
    )


def sql_tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '[\\p{{L}}\\p{{N}}]+')"


def sql_vectors(source: str, key: str, text: str, dim: int = 256) -> str:
    """Rows ``(id, bucket, w)`` of hashed unit term vectors, float weights as in the engine."""
    return (
        f"SELECT id, bucket, (tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS w FROM ("
        f"SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} AS bucket, count(*)::DOUBLE AS tf FROM ("
        f"SELECT {key} AS id, unnest({sql_tokens(text)}) AS t FROM {source}) GROUP BY 1, 2)"
    )


def sql_hits(docs: str, questions: str, k: int) -> str:
    """Rows ``(query_id, rank, doc_id, score)`` from two vector tables."""
    return (
        "SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id "
        "ORDER BY score DESC, doc_id)::INT AS rank FROM (SELECT q.id AS query_id, d.id AS doc_id, "
        f"round(sum(d.w * q.w), 12) AS score FROM {docs} d JOIN {questions} q USING (bucket) "
        f"GROUP BY 1, 2)) WHERE rank <= {k}"
    )
