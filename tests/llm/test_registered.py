"""The registered queries of this package on the smallest tables: every row, the agreed columns."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry
from lectern.llm import queries as Q

COLUMNS = {
    "op1_huffman_ids": ("documents", "doc_id start n_tokens ids_crc32"),
    "op2_simhash_groups": ("documents", "doc_id fingerprint component_id"),
    "op3_byte_bpe": ("documents", "doc_id n_tokens ids_sha256 decoded_sha256"),
    "op4_vector_graph": ("embeddings", "vec_id n_links component_id kept"),
    "op5_iblt_fingerprints": ("documents", "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next"),
    "op6_language": ("documents", "doc_id held_out lang_pred score"),
    "op7_bin_packing": (None, "doc_id piece start length ids_crc32 sequence_id offset"),
    "op8_url_verdicts": ("pages", "page_id host path rule verdict"),
    "op9_chat_format": (None, "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars"),
    "op10_toxicity": ("documents", "doc_id held_out score predicted"),
    "op11_filter_audit": (None, "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley"),
    "op12_source_divergence": (None, "lang source part item value rank"),
    "op13_piece_counts": ("documents", "doc_id n_bytes n_tokens over_limit"),
}


def test_registered():
    assert set(Q.QUERIES) == set(COLUMNS) and {*COLUMNS, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_whole_table(spark, sf, name):
    table, columns = COLUMNS[name]
    got = Q.QUERIES[name](spark, sf)
    assert set(columns.split()) <= set(got.columns)
    n = got.count()
    assert n > 0 and (table is None or n == spark.read.parquet(f"{sf}/{table}.parquet").count())


def test_native_operators_run_no_python(spark, sf):
    for name in ("op5_iblt_fingerprints", "op8_url_verdicts"):
        plan = Q.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_held_out_languages(spark, sf):
    rows = Q.QUERIES["op6_language"](spark, sf).where("held_out").join(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = rows.where("lang = lang_pred").count()
    assert right >= 0.9 * rows.where("lang is not null").count()


def test_twins(spark, sf):
    from oracle import compare, connect

    con = connect(sf)
    for name, sql in Q.ORACLES.items():
        assert not compare(spark, con, sf, Q.QUERIES[name], sql)[1]
