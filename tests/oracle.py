"""Runs registered queries against their SQL twins: python tests/oracle.py [name ...]"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return repr(v) if v is None or isinstance(v, (str, bytes)) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    got = df.toArrow()
    cur = con.execute(sql)
    want_cols = [c[0] for c in cur.description]
    want_types = [str(c[1]) for c in cur.description]
    want = cur.fetchall()
    problems = []
    if sorted(got.column_names) != sorted(want_cols):
        problems.append(f"columns {sorted(got.column_names)} != {sorted(want_cols)}")
        return got.num_rows, problems
    types = dict(zip(want_cols, want_types))
    kinds = {"LONG": "BIGINT", "INT": "INTEGER", "STRING": "VARCHAR", "TIMESTAMP_NTZ": "TIMESTAMP"}
    for f in df.schema.fields:
        have = kinds.get(f.dataType.simpleString().upper(), f.dataType.simpleString().upper())
        if have != types[f.name].upper():
            problems.append(f"type of {f.name}: {have} != {types[f.name]}")
    have = rows_of(got.column_names, list(zip(*[c.to_pylist() for c in got.columns])) if got.num_columns else [])
    need = rows_of(want_cols, want)
    if have != need:
        a, b = set(have), set(need)
        problems.append(f"rows {len(have)} vs {len(need)}; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}")
    return got.num_rows, problems


def main(argv):
    from lectern.session import local_session

    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(app="oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in argv or queries:
        start = time.time()
        try:
            if name in oracles:
                n, problems = compare(spark, con, sf_dir, queries[name], oracles[name])
            else:
                n, problems = queries[name](spark, sf_dir).count(), []
        except Exception as exc:
            n, problems = -1, [f"{type(exc).__name__}: {str(exc)[:600]}"]
        bad += bool(problems)
        kind = "sql" if name in oracles else "rows"
        print(f"{'FAIL' if problems else 'ok  '} {name:26s} {kind:4s} {n:8d} {time.time() - start:6.2f}s", flush=True)
        for p in problems:
            print("     ", p[:900])
    print(f"{bad} failing of {len(argv or queries)}")


if __name__ == "__main__":
    main(sys.argv[1:])
