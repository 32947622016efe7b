"""Joins, merges, set operations, rollups and chunks on the stand-in tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lectern.functions import text as X
from lectern.operators import chunks as C, documents as D, joins as J, merge as M, profile as P, rollups as R
from lectern.queries import testbed as B
from lectern.queries.registry import query, sql_html, table
from lectern.queries.rendering import SQL_FAN_IN
from lectern.sources.tables import Parquet, fan_in, widen

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
               "embeddings", "pages", "benchmark", "labels", "conversations")

# ---- joins -------------------------------------------------------------------


@query("active_children", "SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey "
       "WHERE c_acctbal > 0 AND o_orderstatus = 'O'")
def active_children(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    children = o.withColumn("c_custkey", F.col("o_custkey"))
    return J.active_children(children, c, ["c_custkey"], F.col("o_orderstatus") == "O",
                             F.col("c_acctbal") > 0).select("o_orderkey", "c_custkey", "c_name")


@query("deselect_anti", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN "
       "(SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def deselect_anti(spark, sf):
    out = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return J.deselect(table(spark, sf, "orders"), out, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("stale_docs_anti", "SELECT 'corpus.documents.' || doc_id AS doc_id FROM documents "
       "WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def stale_docs_anti(spark, sf):
    docs = D.build_documents(table(spark, sf, "documents"), B.DOCUMENTS)
    still = table(spark, sf, "labels").select(F.concat(F.lit("corpus.documents."), "doc_id").alias("doc_id"))
    return J.stale_documents(docs, still).select("doc_id")


@query("overlay_merge", """
WITH base AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal, c_name || ',base' AS tags FROM customer),
patch AS (SELECT c_custkey, '' AS c_name, 'VIP' AS c_mktsegment, NULL::DOUBLE AS c_acctbal, NULL AS tags FROM customer WHERE c_acctbal > 5000
  UNION ALL SELECT c_custkey + 100000000, c_name, '', c_acctbal, c_mktsegment || ',new' FROM customer WHERE c_acctbal < 0)
SELECT coalesce(b.c_custkey, p.c_custkey) AS c_custkey, coalesce(nullif(p.c_name, ''), b.c_name, p.c_name) AS c_name,
  coalesce(nullif(p.c_mktsegment, ''), b.c_mktsegment, p.c_mktsegment) AS c_mktsegment, coalesce(p.c_acctbal, b.c_acctbal) AS c_acctbal,
  coalesce(p.tags, b.tags) AS tags FROM base b FULL JOIN patch p ON b.c_custkey = p.c_custkey""")
def overlay_merge(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    base = c.withColumn("tags", F.array("c_name", F.lit("base")))
    vip = c.where("c_acctbal > 5000").select(
        "c_custkey", F.lit("").alias("c_name"), F.lit("VIP").alias("c_mktsegment"),
        F.lit(None).cast("double").alias("c_acctbal"), F.array().cast("array<string>").alias("tags"))
    new = c.where("c_acctbal < 0").select(
        (F.col("c_custkey") + 100000000).alias("c_custkey"), "c_name", F.lit("").alias("c_mktsegment"), "c_acctbal",
        F.array("c_mktsegment", F.lit("new")).alias("tags"))
    merged = J.overlay(base, vip.unionByName(new), ["c_custkey"])
    return merged.withColumn("tags", F.array_join("tags", ","))


@query("resolve_paths", f"""
WITH files AS (SELECT page_id, CASE WHEN page_id % 4 = 3 THEN '{X.UPLOAD_PREFIXES[2]}' || regexp_extract(url, '([^/]+)/*$', 1) ELSE url END AS f FROM pages WHERE page_id % 10 <> 9),
distinct_files AS (SELECT DISTINCT f FROM files),
refs AS (SELECT page_id, url, CASE page_id % 4 WHEN 1 THEN to_base64(encode(url)) WHEN 2 THEN url_encode(url) ELSE url END AS path FROM pages)
SELECT page_id, path, CASE WHEN a.f IS NOT NULL THEN a.f ELSE b.f END AS resolved_path
FROM refs LEFT JOIN distinct_files a ON a.f = refs.url
LEFT JOIN distinct_files b ON b.f = '{X.UPLOAD_PREFIXES[2]}' || regexp_extract(refs.path, '([^/]+)/*$', 1)""")
def resolve_paths(spark, sf):
    p = widen(table(spark, sf, "pages"), "page_id")
    fourth = F.col("page_id") % 4
    moved = F.concat(F.lit(X.UPLOAD_PREFIXES[2]), X.basename(F.col("url")))
    listing = p.where(F.col("page_id") % 10 != 9).select(F.when(fourth == 3, moved).otherwise(F.col("url")).alias("path"))
    refs = p.select("page_id", F.when(fourth == 1, B.base64_of(F.col("url")))
                    .when(fourth == 2, F.url_encode("url")).otherwise(F.col("url")).alias("path"))
    return J.resolve_paths(refs, listing).select("page_id", "path", "resolved_path")


@query("file_path_for_doc", f"""
WITH n AS (SELECT page_id, 'corpus.pages.' || page_id AS doc_id, url, length({sql_html('html')}) AS len FROM pages),
c AS (SELECT doc_id, CASE WHEN page_id % 3 = 0 THEN url END AS fp FROM n
  UNION ALL SELECT doc_id || '.chunk_' || i, CASE WHEN page_id % 3 = 1 AND i = 0 THEN url END
  FROM (SELECT *, unnest(range(0, CASE WHEN len = 0 THEN 0 ELSE greatest(ceil((len - 1000) / 800.0), 0)::BIGINT + 1 END)) AS i FROM n))
SELECT c.doc_id, coalesce(c.fp, k.fp, b.fp) AS file_path FROM c
LEFT JOIN c k ON k.doc_id = c.doc_id || '.chunk_0'
LEFT JOIN c b ON contains(c.doc_id, '.chunk_') AND b.doc_id = split_part(c.doc_id, '.chunk_', 1)""")
def file_path_for_doc(spark, sf):
    p = widen(table(spark, sf, "pages"), "page_id")
    pages = p.select("page_id", "url", F.concat(F.lit("corpus.pages."), "page_id").alias("doc_id"),
                     X.html_to_text(F.col("html")).alias("text"))
    third = F.col("page_id") % 3
    own = pages.select("doc_id", F.when(third == 0, F.col("url")).alias("file_path"))
    chunk_path = F.when((third == 1) & (F.col("chunk_index") == 0), F.col("url"))
    parts = C.chunk_documents(pages).select(F.col("chunk_id").alias("doc_id"), chunk_path.alias("file_path"))
    collection = own.unionByName(parts)
    return J.file_path_for_doc(collection.select("doc_id"), collection, F.col("file_path"))


# ---- merge -------------------------------------------------------------------


@query("upsert_latest", """
WITH cur AS (SELECT 'shop.orders.' || o_orderkey AS doc_id, o_orderdate AS version, o_orderstatus AS text FROM orders),
delta AS (SELECT doc_id, version + INTERVAL 1 DAY AS version, text || '-new' AS text, 1 AS b, 0 AS pos FROM cur WHERE text = 'O'
  UNION ALL SELECT doc_id, version + INTERVAL 1 DAY, text || '-newer', 1, 1 FROM cur WHERE text = 'O' AND version >= '2000-01-01'
  UNION ALL SELECT doc_id, version - INTERVAL 1 DAY, text || '-old', 1, 0 FROM cur WHERE text = 'F'
  UNION ALL SELECT doc_id, NULL, text || '-undated', 1, 0 FROM cur WHERE text = 'P')
SELECT doc_id, version, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY b DESC, version DESC NULLS LAST, pos DESC) AS rn
  FROM (SELECT *, 0 AS b, 0 AS pos FROM cur UNION ALL SELECT * FROM delta)) WHERE rn = 1""")
def upsert_latest(spark, sf):
    cur = table(spark, sf, "orders").select(
        F.concat(F.lit("shop.orders."), "o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("version"),
        F.col("o_orderstatus").alias("text"), F.lit(0).alias("pos"))
    day = F.expr("INTERVAL 1 DAY")
    later = cur.where("text = 'O'").withColumn("version", F.col("version") + day)
    delta = reduce(DataFrame.unionByName, [
        later.withColumn("text", F.concat("text", F.lit("-new"))),
        later.where(F.col("version") - day >= F.lit("2000-01-01").cast("timestamp_ntz"))
        .withColumn("text", F.concat("text", F.lit("-newer"))).withColumn("pos", F.lit(1)),
        cur.where("text = 'F'").withColumn("version", F.col("version") - day)
        .withColumn("text", F.concat("text", F.lit("-old"))),
        cur.where("text = 'P'").withColumn("version", F.lit(None).cast("timestamp_ntz"))
        .withColumn("text", F.concat("text", F.lit("-undated"))),
    ])
    return M.upsert_latest(cur, delta, position="pos").select("doc_id", "version", "text")


_SQL_LIVE = """(SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error')"""


def _live_users(spark, sf):
    return M.live(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@query("live_rows", f"SELECT user_id, event_id, event_type FROM {_SQL_LIVE}")
def live_rows(spark, sf):
    return _live_users(spark, sf).select("user_id", "event_id", "event_type")


@query("count_live", f"SELECT count(*) AS live FROM {_SQL_LIVE}")
def count_live(spark, sf):
    return _live_users(spark, sf).agg(F.count("*").alias("live"))


@query("precedence_merge", """
WITH known AS (SELECT doc_id, source, lang, 'hand' AS origin, 0 AS tier FROM documents WHERE lang IN ('de', 'en')
  UNION ALL SELECT doc_id, source, lang, 'registry', 1 FROM documents WHERE n_chars > 500 AND lang <> 'es'),
fresh AS (SELECT doc_id, source, lang, 'file', 2 FROM documents WHERE (source, lang) NOT IN (SELECT source, lang FROM known))
SELECT doc_id, origin FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tier) AS rn
  FROM (SELECT * FROM known UNION ALL SELECT * FROM fresh)) WHERE rn = 1""")
def precedence_merge(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    hand = d.where(F.col("lang").isin("de", "en")).withColumn("origin", F.lit("hand"))
    registry = d.where("n_chars > 500 AND lang <> 'es'").withColumn("origin", F.lit("registry"))
    files = d.withColumn("origin", F.lit("file"))
    return M.precedence_merge([hand, registry, files], ["doc_id"], ["source", "lang"]).select("doc_id", "origin")


@query("physical_dedup", """
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY source, doc_id) AS rn
  FROM documents WHERE lang <> 'es') WHERE rn = 1 UNION ALL SELECT doc_id FROM documents WHERE lang = 'es'""")
def physical_dedup(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", "source", F.when(F.col("lang") != "es", F.sha2("text", 256)).alias("place"))
    return M.physical_dedup(d, ["place"], ["source", "doc_id"]).select("doc_id")


@query("first_by", """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY event_type <> 'purchase', ts, event_id) AS rn FROM events) WHERE rn = 1""")
def first_by(spark, sf):
    return M.first_by(table(spark, sf, "events"), ["user_id"], F.col("event_type") == "purchase", ["ts", "event_id"],
                      ["event_id", "event_type"])


@query("sample_rows", """
SELECT source, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS place
  FROM documents) WHERE place <= 3""")
def sample_rows(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id")
    return M.top_per_group(d, ["source"], ["doc_id"], 3, rank="place")


# ---- sets --------------------------------------------------------------------


@query("union_sources", """
SELECT doc_id AS id, md5(text) AS text_md5, lang, NULL AS role FROM documents
UNION ALL SELECT conv_id, md5(text), NULL, role FROM conversations
UNION ALL SELECT item_id, md5(text), NULL, NULL FROM benchmark""")
def union_sources(spark, sf):
    md5 = F.md5("text").alias("text_md5")
    return M.union_sources(
        table(spark, sf, "documents").select(F.col("doc_id").alias("id"), md5, "lang"),
        table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), md5, "role"),
        table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), md5))


@query("set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, sf):
    return M.difference(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])


@query("set_overlap", """
SELECT user_id, bool_or(user_id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)) AS overlaps FROM events GROUP BY 1""")
def set_overlap(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("user_id").alias("item"))
    rich = table(spark, sf, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("item"))
    return M.overlaps(e, ["user_id"], "item", rich)


@query("content_dedup", "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_dedup(spark, sf):
    return M.content_dedup(table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id")


# ---- rollups -----------------------------------------------------------------


@query("docs_per_table", f"SELECT source_db, source_table, count(*) AS docs FROM ({SQL_FAN_IN}) GROUP BY ROLLUP (source_db, source_table)")
def docs_per_table(spark, sf):
    docs, _ = fan_in(spark, Parquet(sf), B.FAN_IN)
    return R.docs_per_table(docs)


@query("tables_per_db", """
SELECT lang, string_agg(source, ',' ORDER BY source) AS items, count(*) AS n_items, sum(n)::BIGINT AS n_rows
FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1""")
def tables_per_db(spark, sf):
    return R.group_listing(table(spark, sf, "documents"), ["lang"], "source")


@query("selected_counts", "SELECT toxic, count_if(quality = 1)::BIGINT AS selected, count(*) AS total FROM labels GROUP BY 1")
def selected_counts(spark, sf):
    return R.flag_counts(table(spark, sf, "labels"), ["toxic"], F.col("quality") == 1)


def _run_log(spark, sf):
    """Events as a run log: the user is the table, an error event a failed run."""
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("table_key"), F.col("ts").alias("run_ts"), "event_id",
        F.when(kind == "purchase", "full").otherwise("incremental").alias("mode"),
        F.when(kind == "error", "error").otherwise("success").alias("status"),
        (F.col("event_id") % 100).alias("records"))


_SQL_STATE = """(SELECT * FROM (SELECT user_id AS table_key, ts AS run_ts,
  CASE WHEN event_type = 'purchase' THEN 'full' ELSE 'incremental' END AS mode,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, event_id % 100 AS records,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)"""


@query("latest_state", f"SELECT table_key, run_ts, mode, status, records FROM {_SQL_STATE}")
def latest_state(spark, sf):
    return R.latest_state(_run_log(spark, sf), "table_key", ["run_ts", "event_id"], ["run_ts", "mode", "status", "records"])


@query("sync_status_rollup", f"""
SELECT m.mode, max(run_ts) AS last_run, CASE WHEN count(s.mode) = 0 THEN 'never_run' ELSE 'success' END AS status,
  coalesce(sum(CASE WHEN s.status = 'success' THEN records END), 0)::BIGINT AS records
FROM (VALUES ('incremental'), ('full'), ('repair')) m(mode) LEFT JOIN {_SQL_STATE} s ON s.mode = m.mode GROUP BY 1""")
def sync_status_rollup(spark, sf):
    modes = spark.createDataFrame([("incremental",), ("full",), ("repair",)], "mode string")
    return R.status_rollup(modes, latest_state(spark, sf))


@query("collection_audit", f"""
WITH ids AS (SELECT doc_id FROM ({SQL_FAN_IN}) UNION ALL SELECT 'corpus.documents.' || doc_id || '.chunk_' || i FROM
  (SELECT doc_id, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(ceil((length(text) - 1000) / 800.0), 0)::BIGINT + 1 END)) AS i FROM documents))
SELECT split_part(doc_id, '.', 1) AS db, count(*) AS docs, count_if(contains(doc_id, '.chunk_'))::BIGINT AS chunk_docs,
  count(DISTINCT split_part(doc_id, '.', 2)) AS tables, array_to_string(list_slice(list_sort(list(doc_id)), 1, 10), ',') AS sample_ids
FROM ids GROUP BY 1""")
def collection_audit(spark, sf):
    docs, _ = fan_in(spark, Parquet(sf), B.FAN_IN)
    parents = table(spark, sf, "documents").withColumn("doc_id", F.concat(F.lit("corpus.documents."), "doc_id"))
    parts = C.chunk_documents(parents).select(F.col("chunk_id").alias("doc_id"))
    return R.collection_audit(docs.select("doc_id").unionByName(parts))


@query("table_row_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows, count(*) = 0 AS is_empty FROM {t}" for t in TABLE_NAMES)
    + " UNION ALL SELECT 'negative_sizes', count(*), count(*) = 0 FROM part WHERE p_size < 0")
def table_row_counts(spark, sf):
    frames = {t: table(spark, sf, t) for t in TABLE_NAMES}
    frames["negative_sizes"] = table(spark, sf, "part").where("p_size < 0")
    return R.table_row_counts(frames)


# ---- chunks ------------------------------------------------------------------

_SQL_CHUNKS = """SELECT doc_id, i::INT AS chunk_index, md5(substr(text, i * 800 + 1, 1000)) AS chunk_md5 FROM
  (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(ceil((length(text) - 1000) / 800.0), 0)::BIGINT + 1 END)) AS i FROM documents)"""


@query("chunk_sliding", _SQL_CHUNKS)
def chunk_sliding(spark, sf):
    d = widen(table(spark, sf, "documents"), "doc_id").select("doc_id", "text")
    return C.chunk_documents(d).select("doc_id", "chunk_index", F.md5("chunk_text").alias("chunk_md5"))


@query("chunk_positions", f"""
WITH c AS ({_SQL_CHUNKS}) SELECT doc_id || '.chunk_' || chunk_index AS chunk_id, chunk_index,
  (count(*) OVER (PARTITION BY doc_id))::INT AS total_chunks FROM c""")
def chunk_positions(spark, sf):
    d = widen(table(spark, sf, "documents"), "doc_id").select("doc_id", "text")
    return C.chunk_documents(d).select("chunk_id", "chunk_index", "total_chunks")


# The second version of recursive chunks. Level by level, long pieces are split at the next separator; ``n`` holds the
# text and every long piece with its place. Runs of short pieces between long ones are packed by jumps: a window
# from piece s ends before the first piece that overflows it, and the next one starts at the first piece that
# keeps to the overlap and leaves room for that piece. ``cum`` has the characters before each piece of a run.
_SQL_LEVEL = ("CASE WHEN lvl <= 1 AND contains(text, chr(10) || chr(10)) THEN 1 WHEN lvl <= 2 AND contains(text, chr(10)) THEN 2 "
              "WHEN lvl <= 3 AND contains(text, '. ') THEN 3 WHEN lvl <= 4 AND contains(text, ' ') THEN 4 ELSE 5 END")
_SQL_PIECES = """CASE WHEN l = 5 THEN regexp_extract_all(text, '(?s).') ELSE list_filter(list_transform(string_split(text, sep),
  lambda x, i: CASE WHEN i = 1 THEN x ELSE sep || x END), lambda x: x <> '') END"""
_SQL_CUT = f"""SELECT doc_id, path, l, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pos FROM (SELECT *, {_SQL_PIECES} AS pieces FROM (
  SELECT *, [chr(10) || chr(10), chr(10), '. ', ' ', ''][l] AS sep FROM (SELECT *, {_SQL_LEVEL} AS l FROM n)))"""
_SQL_RECURSIVE = f"""WITH RECURSIVE n AS (SELECT doc_id, []::BIGINT[] AS path, text, 1 AS lvl FROM documents WHERE text <> ''
  UNION ALL SELECT doc_id, list_append(path, pos), piece, l + 1 FROM ({_SQL_CUT}) WHERE length(piece) >= 1000),
p AS (SELECT *, count_if(length(piece) >= 1000) OVER (PARTITION BY doc_id, path ORDER BY pos) AS run FROM ({_SQL_CUT})),
r AS (SELECT doc_id, list_append(path, min(pos)) AS place, string_agg(piece, '' ORDER BY pos) AS text, list(length(piece) ORDER BY pos) AS sizes
  FROM p WHERE length(piece) < 1000 GROUP BY doc_id, path, run),
c AS (SELECT doc_id, place, text, list_transform(range(1, len(sizes) + 2), lambda j: coalesce(list_sum(sizes[1:j - 1]), 0)::BIGINT) AS cum FROM r),
w AS (SELECT doc_id, place, text, cum, 1::BIGINT AS s, len(list_filter(cum, lambda x: x <= 1000))::BIGINT AS e FROM c
  UNION ALL SELECT doc_id, place, text, cum, s2, len(list_filter(cum, lambda x: x <= cum[s2] + 1000))::BIGINT FROM (
    SELECT *, greatest(s, 1 + len(list_filter(cum, lambda x: x < greatest(cum[e] - 200, cum[e + 1] - 1000))))::BIGINT AS s2 FROM w WHERE e < len(cum))),
k AS (SELECT doc_id, place, s, trim(substr(text, cum[s] + 1, cum[e] - cum[s]), '{X.WHITESPACE}') AS chunk FROM w),
o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place, s) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n, chunk FROM k WHERE chunk <> '')
SELECT doc_id || '.chunk_' || i AS chunk_id, i::INT AS chunk_index, n::INT AS total_chunks, md5(chunk) AS chunk_md5 FROM o"""


@query("chunk_recursive", _SQL_RECURSIVE)
def chunk_recursive(spark, sf):
    d = widen(table(spark, sf, "documents"), "doc_id").select("doc_id", "text")
    return C.chunk_documents(d, recursive=True).select("chunk_id", "chunk_index", "total_chunks",
                                                       F.md5("chunk_text").alias("chunk_md5"))


@query("parse_json_array", """
SELECT p_partkey, 0 AS position, 'stand_in' AS db, 'part_' || p_partkey AS table_name, 'part_' || p_partkey AS label, '' AS description,
  'id' AS pk_column, 'a,b' AS text_columns, 'f:t,g:' AS file_columns FROM part WHERE p_name NOT LIKE '%ring%'
UNION ALL SELECT p_partkey, 2, 'stand_in', p_brand, p_name, p_type, NULL, '', '' FROM part WHERE p_name NOT LIKE '%ring%'""")
def parse_json_array(spark, sf):
    first = F.format_string(
        '{"table": "part_%d", "pk_column": "id", "text_columns": ["a", "b"], "file_columns": [["f", "t"], [], ["g"]]}', "p_partkey")
    second = F.lit('{"label": "no table"}')
    third = F.format_string('{"table": "%s", "label": "%s", "description": "%s"}', "p_brand", "p_name", "p_type")
    body = F.concat(F.lit("Here:\n```json\n["), F.concat_ws(",\n", first, second, third), F.lit("]\n```\nDone."))
    answers = table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_name").like("%ring%"), "I cannot help.").otherwise(body).alias("answer"))
    found = P.proposed_configs(answers, "answer", "stand_in")
    pairs = F.transform("file_columns", lambda f: F.concat(f["path_col"], F.lit(":"), f["type_col"]))
    return found.select("p_partkey", "position", "db", "table_name", "label", "description", "pk_column",
                        F.array_join("text_columns", ",").alias("text_columns"), F.array_join(pairs, ",").alias("file_columns"))
