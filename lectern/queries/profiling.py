"""Schema profiling on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import profile as P
from lectern.operators.sketches import DISTINCT_ERROR, ProfileStore
from lectern.queries.merging import TABLE_NAMES
from lectern.queries.registry import query, table
from lectern.session import scratch_path

# Columns of the stand-in tables with their catalog types, for the SQL twins.
COLUMNS = {
    "region": "r_regionkey int, r_name varchar",
    "nation": "n_nationkey int, n_name varchar, n_regionkey int",
    "customer": "c_custkey bigint, c_name varchar, c_nationkey int, c_acctbal double, c_mktsegment varchar",
    "supplier": "s_suppkey bigint, s_name varchar, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name varchar, p_brand varchar, p_type varchar, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus varchar, o_totalprice double, o_orderdate datetime, "
              "o_orderpriority varchar",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag varchar, l_linestatus varchar, "
                "l_shipdate datetime",
    "events": "event_id bigint, ts datetime, user_id bigint, event_type varchar, value double, props varchar",
    "documents": "doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint",
    "embeddings": "vec_id bigint, embedding vector, label int",
    "pages": "page_id bigint, url varchar, html varchar",
    "benchmark": "item_id bigint, text varchar",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role varchar, text varchar",
    "uploads": "upload_no bigint, file_path varchar, file_type varchar, attachment varchar, note varchar, "
               "seen datetime, created_at datetime",
}
# Declared keys; every other table has its key measured.
KEYS = {("orders", "o_orderkey"): "PRI", ("orders", "o_custkey"): "MUL", ("part", "p_brand"): "MUL",
        ("documents", "lang"): "MUL", ("pages", "html"): "MUL"}
UPLOADS_SQL = ("(SELECT page_id AS upload_no, url AS file_path, 'html' AS file_type, url || '.pdf' AS attachment, "
               "html AS note, TIMESTAMP '2024-01-01' + to_days(page_id::INT) AS seen, TIMESTAMP '2024-02-01' + to_days(page_id::INT) AS created_at FROM pages)")


def _frames(spark, sf):
    frames = {t: table(spark, sf, t) for t in TABLE_NAMES}
    day = F.make_dt_interval(F.col("page_id").cast("int"))
    frames["uploads"] = frames["pages"].select(
        F.col("page_id").alias("upload_no"), F.col("url").alias("file_path"), F.lit("html").alias("file_type"),
        F.concat("url", F.lit(".pdf")).alias("attachment"), F.col("html").alias("note"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + day).alias("seen"),
        (F.lit("2024-02-01").cast("timestamp_ntz") + day).alias("created_at"), F.md5("html").alias("API_KEY"))
    frames["click_log"] = frames["events"]
    return frames


def _columns(spark, sf):
    return P.catalog(spark, _frames(spark, sf), KEYS)


def _sql_statistics():
    parts = []
    for t, spec in COLUMNS.items():
        source = UPLOADS_SQL if t == "uploads" else t
        for i, item in enumerate(spec.split(", ")):
            c, kind = item.split()
            length = f"length({c})" if kind == "varchar" else "NULL"
            parts.append(
                f"SELECT '{t}' AS table_name, {i} AS ordinal, '{c}' AS column_name, '{kind}' AS base_type, "
                f"'{KEYS.get((t, c), '')}' AS declared_key, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, "
                f"count(DISTINCT {c}) AS n_distinct, avg({length})::DOUBLE AS avg_length, max({length})::INT AS max_length FROM {source}")
    return " UNION ALL ".join(parts)


SQL_CATALOG = f"""s AS ({_sql_statistics()}),
k AS (SELECT table_name, min(ordinal) AS key_ordinal FROM s WHERE n_rows > 0 AND n_nulls = 0 AND n_distinct = n_rows
  AND base_type IN ('int', 'bigint', 'varchar') AND coalesce(max_length, 0) <= {P.VARCHAR_CHARS} GROUP BY 1),
d AS (SELECT table_name, max((declared_key = 'PRI')::INT) AS has_pk FROM s GROUP BY 1),
c AS (SELECT s.*, CASE WHEN base_type = 'varchar' AND max_length > {P.VARCHAR_CHARS} THEN 'text' ELSE base_type END AS data_type,
  CASE WHEN has_pk = 0 AND ordinal = key_ordinal THEN 'PRI' ELSE declared_key END AS column_key
  FROM s JOIN d USING (table_name) LEFT JOIN k USING (table_name)),
pk AS (SELECT table_name, arg_min(column_name, ordinal) AS pk_column FROM c WHERE column_key = 'PRI' GROUP BY 1),
e AS (SELECT c.*, pk_column, coalesce(column_name = pk_column, false) AS is_pk FROM c LEFT JOIN pk USING (table_name)),
tc AS (SELECT * FROM e WHERE data_type IN ('varchar', 'text') AND NOT is_pk AND NOT (column_key IN ('MUL', 'UNI') AND data_type <> 'text')
  AND NOT regexp_matches(column_name, '({"|".join(P.FILE_PATTERNS)})$')
  AND NOT regexp_matches(column_name, '^({"|".join(p.lstrip("_") for p in P.FILE_PATTERNS)})')),
mc AS (SELECT table_name, CASE WHEN is_pk THEN -1 ELSE ordinal END AS ordinal, column_name FROM e
  WHERE is_pk OR data_type IN ('int', 'bigint', 'double', 'datetime') OR column_key IN ('MUL', 'UNI')),
dc AS (SELECT table_name, column_name AS date_column FROM (SELECT *, row_number() OVER (PARTITION BY table_name
  ORDER BY NOT regexp_matches(column_name, '{"|".join(P.DATE_PATTERNS)}'), ordinal) AS rn FROM c WHERE data_type = 'datetime') WHERE rn = 1),
fc AS (SELECT table_name, ordinal, column_name FROM c WHERE data_type IN ('varchar', 'text') AND regexp_matches(column_name, '{"|".join(P.FILE_PATTERNS)}')),
ft AS (SELECT table_name, f.ordinal, f.column_name AS path_col, coalesce((SELECT arg_min(c.column_name, x.prio) FROM c,
  (VALUES {", ".join(f"({i}, '{s}')" for i, s in enumerate(P.TYPE_SUFFIXES))}, (9, NULL)) x(prio, suffix)
  WHERE c.table_name = f.table_name AND c.column_name <> f.column_name AND
  c.column_name = coalesce(replace(replace(f.column_name, '_file', suffix), '_path', suffix), 'file_type')), '') AS type_col FROM fc f)"""


@query("catalog_columns", f"WITH {SQL_CATALOG} SELECT table_name, ordinal, column_name, data_type, column_key, n_rows, n_nulls FROM c")
def catalog_columns(spark, sf):
    return _columns(spark, sf).select("table_name", "ordinal", "column_name", "data_type", "column_key", "n_rows", "n_nulls")


@query("profile_stats", f"WITH s AS ({_sql_statistics()}) SELECT table_name, ordinal, n_rows, n_nulls, n_distinct, "
       "round(avg_length, 4) AS avg_length, max_length FROM s WHERE table_name <> 'uploads'")
def profile_stats(spark, sf):
    frames = {t: table(spark, sf, t) for t in TABLE_NAMES}
    return P.profile_statistics(frames, exact=True).withColumn("avg_length", F.round("avg_length", 4)).select(
        "table_name", "ordinal", "n_rows", "n_nulls", "n_distinct", "avg_length", "max_length")


@query("profile_pk", f"WITH {SQL_CATALOG} SELECT table_name, pk_column FROM pk")
def profile_pk(spark, sf):
    return P.primary_keys(_columns(spark, sf))


@query("profile_text_cols", f"WITH {SQL_CATALOG} SELECT table_name, ordinal, column_name FROM tc")
def profile_text_cols(spark, sf):
    return P.text_columns(_columns(spark, sf))


@query("profile_metadata_cols", f"WITH {SQL_CATALOG} SELECT table_name, ordinal, column_name FROM mc")
def profile_metadata_cols(spark, sf):
    return P.metadata_columns(_columns(spark, sf))


@query("profile_date_col", f"WITH {SQL_CATALOG} SELECT table_name, date_column FROM dc")
def profile_date_col(spark, sf):
    return P.date_columns(_columns(spark, sf))


@query("profile_file_cols", f"WITH {SQL_CATALOG} SELECT table_name, ordinal, column_name FROM fc")
def profile_file_cols(spark, sf):
    return P.file_columns(_columns(spark, sf))


@query("profile_type_col", f"WITH {SQL_CATALOG} SELECT table_name, ordinal, path_col, type_col FROM ft")
def profile_type_col(spark, sf):
    return P.type_columns(_columns(spark, sf))


@query("profile_configs", f"""WITH {SQL_CATALOG},
t AS (SELECT table_name, count(*) AS n FROM c GROUP BY 1),
a AS (SELECT table_name, string_agg(column_name, ',' ORDER BY ordinal) AS text_columns FROM tc GROUP BY 1),
m AS (SELECT table_name, string_agg(column_name, ',' ORDER BY ordinal) AS metadata_columns FROM mc GROUP BY 1),
f AS (SELECT table_name, string_agg(path_col || ':' || type_col, ',' ORDER BY ordinal) AS file_columns FROM ft GROUP BY 1)
SELECT 'stand_in' AS db, table_name, upper(substr(table_name, 1, 1)) || substr(table_name, 2) AS label,
  'Table ' || table_name || ' (' || n || ' columns)' AS description, pk_column, coalesce(text_columns, '') AS text_columns,
  coalesce(metadata_columns, '') AS metadata_columns, date_column, coalesce(file_columns, '') AS file_columns
FROM t LEFT JOIN pk USING (table_name) LEFT JOIN dc USING (table_name) LEFT JOIN a USING (table_name)
LEFT JOIN m USING (table_name) LEFT JOIN f USING (table_name) WHERE text_columns IS NOT NULL OR file_columns IS NOT NULL""")
def profile_configs(spark, sf):
    found = P.configs(_columns(spark, sf), "stand_in")
    pairs = F.transform("file_columns", lambda e: F.concat(e["path_col"], F.lit(":"), e["type_col"]))
    return (found.withColumn("file_columns", F.array_join(pairs, ","))
            .withColumn("text_columns", F.array_join("text_columns", ","))
            .withColumn("metadata_columns", F.array_join("metadata_columns", ",")))


@query("profile_merged", f"""SELECT table_name, column_name, n_rows, n_nulls, avg_length, max_length, n_rows > 0 AS distinct_in_bounds
FROM ({_sql_statistics()}) WHERE base_type <> 'vector' AND table_name <> 'uploads'""")
def profile_merged(spark, sf):
    """Sketches of two slices of each table, one of them profiled twice, merged; distinct counts against exact ones."""
    store = ProfileStore(spark, scratch_path(spark, "profiles"))
    frames = {t: table(spark, sf, t) for t in TABLE_NAMES}
    for name, df in frames.items():
        half = F.pmod(F.xxhash64(df.columns[0]), F.lit(2))
        for i in (0, 1, 0):
            store.add(name, f"part {i}", df.where(half == i))
    exact = P.profile_statistics({n: df.select(*(f.name for f in df.schema.fields if P.base_type(f.dataType) != "vector"))
                                  for n, df in frames.items()}, exact=True)
    true = exact.select("table_name", F.col("n_distinct").alias("exact"), "ordinal")
    places = spark.createDataFrame([(n, i, c) for n, df in frames.items() for i, c in enumerate(
        f.name for f in df.schema.fields if P.base_type(f.dataType) != "vector")], "table_name string, ordinal int, column_name string")
    merged = store.statistics().where("base_type <> 'vector'").drop("ordinal").join(
        places.join(true, ["table_name", "ordinal"]), ["table_name", "column_name"])
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= 1 + DISTINCT_ERROR * F.col("exact")
    return merged.select("table_name", "column_name", "n_rows", "n_nulls", "avg_length", "max_length", near.alias("distinct_in_bounds"))
