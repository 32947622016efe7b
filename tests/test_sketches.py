"""Profiles merged from slices against exact statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lectern.operators.sketches import DISTINCT_ERROR, RANK_ERROR, ProfileStore


def test_merged_profiles(spark, tmp_path):
    store = ProfileStore(spark, str(tmp_path))
    assert store.statistics().count() == 0
    df = spark.range(60_000).selectExpr("id", "id % 700 few", "if(id % 5 = 0, null, 'v' || id % 9000) `odd name`", "cast(null as string) none",
                                        "cast(id as double) / 7 real", "array(id % 3) nested", "id % 2 = 0 flag", "timestamp_ntz'2024-01-01' at")
    for i in (0, 1, 2, 1):
        store.add("t", f"day/{i}", df.where(F.col("id") % 3 == i))
    store.add("u", "x", df.where("false"))
    rows = {(r["table_name"], r["column_name"]): r for r in store.statistics((0.1, 0.5)).collect()}
    assert len(rows) == 16 and all(r["n_rows"] == (60_000 if t == "t" else 0) for (t, _), r in rows.items())
    for name, exact in {"id": 60_000, "few": 700, "odd name": 9000 - 1800, "none": 0, "real": 60_000, "nested": 3, "flag": 2, "at": 1}.items():
        assert abs(rows["t", name]["n_distinct"] - exact) <= 1 + DISTINCT_ERROR * exact, name
    assert rows["t", "odd name"]["n_nulls"] == 12_000 and rows["t", "none"]["n_nulls"] == 60_000
    lengths = [len(f"v{i % 9000}") for i in range(60_000) if i % 5]
    assert rows["t", "odd name"]["max_length"] == 5 and abs(rows["t", "odd name"]["avg_length"] - np.mean(lengths)) < 1e-9
    for q, value in zip((0.1, 0.5), rows["t", "id"]["quantiles"]):
        assert abs(value / 60_000 - q) <= RANK_ERROR
    assert rows["t", "none"]["quantiles"] is None and rows["u", "id"]["n_distinct"] == 0
