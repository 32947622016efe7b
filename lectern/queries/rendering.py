"""Scans, projections and predicates on the stand-in tables."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from lectern.functions import text as X
from lectern.operators import documents as D
from lectern.operators.joins import lookup
from lectern.operators.predicates import compile_where, scope
from lectern.queries import testbed as B
from lectern.queries.registry import (query, sql_clean, sql_generic, sql_hash_key, sql_html, sql_join,
                                      sql_value, table)
from lectern.sources.tables import Parquet, fan_in, scan_changed, scan_first, widen

# ---- scans -----------------------------------------------------------------


@query("scan_full", "SELECT * FROM lineitem")
def scan_full(spark, sf):
    return Parquet(sf).read(spark, "lineitem")


@query("scan_limit", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
def scan_limit(spark, sf):
    return scan_first(Parquet(sf).read(spark, "orders"), "o_orderkey", 100)


@query("scan_changed_since", "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'")
def scan_changed_since(spark, sf):
    return scan_changed(Parquet(sf).read(spark, "orders"), "o_orderdate", "2000-01-01 00:00:00")


def _sql_documents(db, tab, label, columns, pk, source=None):
    text = sql_generic(label, columns)
    key = f"{pk}::VARCHAR" if pk else sql_hash_key(text)
    return (f"SELECT '{db}.{tab}.' || {key} AS doc_id, '{db}' AS source_db, '{tab}' AS source_table, "
            f"md5({text}) AS text_md5 FROM {source or tab}")


SQL_FAN_IN = " UNION ALL ".join([
    _sql_documents("shop", "customer", "Customer", [("c_name", "C Name"), ("c_mktsegment", "C Mktsegment")], "c_custkey"),
    _sql_documents("shop", "supplier", "Supplier", [("s_name", "S Name")], "s_suppkey"),
    _sql_documents("shop", "part", "Part", [("p_name", "P Name"), ("p_brand", "P Brand"), ("p_type", "P Type")],
                   "p_partkey"),
    _sql_documents("shop", "orders", "Order",
                   [("o_orderstatus", "O Orderstatus"), ("o_orderpriority", "O Orderpriority")], "o_orderkey"),
    _sql_documents("corpus", "documents", "Document", [("text", "Text")], "doc_id"),
    _sql_documents("corpus", "conversations", "Conversation", [("role", "Role"), ("text", "Text")], None),
])


@query("scan_fanin_documents", SQL_FAN_IN)
def scan_fanin_documents(spark, sf):
    documents, _ = fan_in(spark, Parquet(sf), (*B.FAN_IN, B.MISSING))
    return documents.select("doc_id", "source_db", "source_table", F.md5("text").alias("text_md5"))


# ---- cells, joins, documents -----------------------------------------------


@query("text_clean", f"SELECT doc_id, md5({sql_clean('text')}) AS cleaned, "
       f"md5({sql_clean('replace(text, lang, chr(9))')}) AS cleaned_tabs, {sql_clean('n_chars / 1e8')} AS small, "
       f"{sql_clean('n_chars * 1e15')} AS large FROM documents")
def text_clean(spark, sf):
    d = table(spark, sf, "documents")
    double = T.DoubleType()
    return d.select("doc_id", F.md5(X.clean(F.col("text"))).alias("cleaned"),
                    F.md5(X.clean(F.replace("text", "lang", F.lit("\t")))).alias("cleaned_tabs"),
                    X.clean(F.col("n_chars") / F.lit(1e8), double).alias("small"),
                    X.clean(F.col("n_chars") * F.lit(1e15), double).alias("large"))


@query("text_join_nonblank",
       f"SELECT c_custkey, {sql_join(' · ', 'c_name', 'c_nationkey', 'c_mktsegment', 'c_acctbal')} AS joined "
       "FROM customer")
def text_join_nonblank(spark, sf):
    c = table(spark, sf, "customer")
    cells = [X.clean(F.col(n), c.schema[n].dataType) for n in ("c_name", "c_nationkey", "c_mktsegment", "c_acctbal")]
    return c.select("c_custkey", X.join_nonblank(cells).alias("joined"))


@query("doc_generic",
       "SELECT p_partkey, " + sql_generic("Part", [("p_name", "P Name"), ("p_brand", "P Brand"),
                                                   ("p_type", "P Type")]) + " AS text FROM part")
def doc_generic(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", D.render_generic(p.schema, "Part", B.PART.text_columns).alias("text"))


def _c(x):
    return sql_clean(x)


@query("doc_template", " UNION ALL ".join([
    f"SELECT 'supplier' AS tab, s_suppkey::VARCHAR AS k, 'Supplier Record' || chr(10) || 'Issued By: ' || {_c('s_name')} "
    f"|| ' (' || {_c('s_nationkey')} || ')' || chr(10) || 'Balance: ' || {_c('s_acctbal')} AS text FROM supplier",
    f"SELECT 'part', p_partkey::VARCHAR, 'Part Master' || chr(10) || 'Part: ' || {_c('p_name')} || chr(10) || 'Traits: ' || "
    f"{sql_join(' | ', 'p_brand', 'p_type', 'p_size', 'p_retailprice')} FROM part",
    f"SELECT 'lineitem', l_orderkey::VARCHAR, 'Order Line' || chr(10) || 'Line: ' || {_c('l_linenumber')} || ' (' || "
    f"{_c('l_quantity')} || ' - ' || {_c('l_extendedprice')} || ')' || chr(10) || 'Discount: ' || {_c('l_discount')} "
    f"|| '% | Flags: ' || {sql_join(', ', 'l_returnflag', 'l_linestatus')} FROM lineitem",
    f"SELECT 'nation', n_nationkey::VARCHAR, 'Nation' || chr(10) || {sql_join(', ', 'n_name', 'n_regionkey')} FROM nation",
]))
def doc_template(spark, sf):
    parts = []
    for name, key in (("supplier", "s_suppkey"), ("part", "p_partkey"), ("lineitem", "l_orderkey"),
                      ("nation", "n_nationkey")):
        t = table(spark, sf, name)
        parts.append(t.select(F.lit(name).alias("tab"), F.col(key).cast("string").alias("k"),
                              D.render_template(t.schema, B.TEMPLATES[name]).alias("text")))
    return reduce(DataFrame.unionByName, parts)


@query("doc_template_flags", f"""
SELECT 'customer' AS tab, c_custkey AS k, 'Customer Record' || chr(10) || 'Name: ' || {_c('c_name')} || ' | Segment: ' ||
  {_c('c_mktsegment')} || chr(10) || 'Abroad: ' || CASE WHEN c_nationkey <> 0 THEN 'Yes' ELSE 'No' END ||
  ' | Balance: ' || {_c('c_acctbal')} AS text FROM customer
UNION ALL
SELECT 'orders', o_orderkey, 'Order' || chr(10) || 'Status: ' ||
  CASE o_orderstatus WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' ELSE 'Pending' END || ' | Priority: ' ||
  {_c('o_orderpriority')} || chr(10) || 'Placed: ' || {_c('o_orderdate')} || ' | Total: ' || {_c('o_totalprice')}
FROM orders""")
def doc_template_flags(spark, sf):
    parts = []
    for name, key in (("customer", "c_custkey"), ("orders", "o_orderkey")):
        t = table(spark, sf, name)
        parts.append(t.select(F.lit(name).alias("tab"), F.col(key).alias("k"),
                              D.render_template(t.schema, B.TEMPLATES[name]).alias("text")))
    return reduce(DataFrame.unionByName, parts)


@query("doc_template_name", f"""
SELECT c_custkey, 'Person' || chr(10) || 'Name: ' || concat_ws(' ', nullif({_c('c_name')}, ''),
  nullif({_c("CASE WHEN c_nationkey % 3 = 0 THEN NULL WHEN c_nationkey % 3 = 1 THEN '  ' ELSE 'van' END")}, ''),
  nullif({_c('c_mktsegment')}, '')) || ' | No: ' || {_c('c_custkey')} AS text FROM customer""")
def doc_template_name(spark, sf):
    third = F.col("c_nationkey") % 3
    c = table(spark, sf, "customer").withColumn(
        "middle_name", F.when(third == 1, "  ").when(third == 2, "van"))
    return c.select("c_custkey", D.render_template(c.schema, B.TEMPLATES["person"]).alias("text"))


@query("doc_with_attachment", f"""
SELECT page_id, md5('Uploaded Document' || chr(10) || 'File: ' || {_c('url')} ||
  CASE WHEN {sql_html('html')} <> '' THEN chr(10) || chr(10) || 'File Content:' || chr(10) ||
  substr({sql_html('html')}, 1, 5000) ELSE '' END) AS text_md5 FROM pages""")
def doc_with_attachment(spark, sf):
    p = widen(table(spark, sf, "pages"), "page_id").withColumn("content", X.html_to_text(F.col("html")))
    cfg = B.Template("Uploaded Document\nFile: {url}", attachment="content")
    return p.select("page_id", F.md5(D.render_template(p.schema, cfg)).alias("text_md5"))


SQL_CONVERSATION = sql_generic("Conversation", [("role", "Role"), ("text", "Text")])


@query("doc_id", f"""
SELECT 'corpus.conversations.' || {sql_hash_key(SQL_CONVERSATION)} AS doc_id, conv_id AS k FROM conversations
UNION ALL SELECT 'shop.orders.' || o_orderkey, o_orderkey FROM orders""")
def doc_id(spark, sf):
    parts = []
    for cfg, key in ((B.CONVERSATIONS, "conv_id"), (B.ORDERS, "o_orderkey")):
        t = table(spark, sf, cfg.table)
        pk = D.key_value(t.schema, cfg.pk_column, D.render(t.schema, cfg))
        parts.append(t.select(D.doc_id(cfg.db, cfg.table, pk).alias("doc_id"), F.col(key).alias("k")))
    return reduce(DataFrame.unionByName, parts)


@query("doc_metadata", """
SELECT 'shop.customer.' || c_custkey AS doc_id, concat_ws(';', 'c_acctbal=' || CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal / 1e8 END,
  'c_mktsegment=' || c_mktsegment, 'c_nationkey=' || c_nationkey, 'doc_label=Customer', 'pk_value=' || c_custkey,
  'source_db=shop', 'source_table=customer') AS meta FROM customer""")
def doc_metadata(spark, sf):
    c = table(spark, sf, "customer").withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / F.lit(1e8)))
    docs = D.build_documents(c, B.CUSTOMER)
    entries = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return docs.select("doc_id", F.array_join(entries, ";").alias("meta"))


@query("row_preview", """
SELECT doc_id, replace(substr(text, 1, 280), chr(10), ' | ') AS line, substr(text, 1, 60) AS text_cell,
  CASE WHEN doc_id = 0 THEN 'NULL' ELSE doc_id::VARCHAR END AS id_cell, coalesce(substr(nullif(lang, 'de'), 1, 60), 'NULL') AS lang_cell
FROM documents""")
def row_preview(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", D.one_line(F.col("text")).alias("line"),
                    D.preview_cell(F.col("text"), T.StringType()).alias("text_cell"),
                    D.preview_cell(F.col("doc_id"), T.LongType()).alias("id_cell"),
                    D.preview_cell(F.nullif(F.col("lang"), F.lit("de")), T.StringType()).alias("lang_cell"))


@query("drop_sensitive", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def drop_sensitive(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_name", "Password").withColumn("API_KEY", F.md5("Password"))
    return D.drop_sensitive(c)


# ---- text, date and path scalars ---------------------------------------------


@query("html_to_text", f"SELECT page_id, md5({sql_html('html')}) AS text_md5, length({sql_html('html')}) AS n FROM pages")
def html_to_text(spark, sf):
    p = widen(table(spark, sf, "pages"), "page_id")
    text = p.select("page_id", X.html_to_text(F.col("html")).alias("text"))
    return text.select("page_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n"))


@query("decode_text", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def decode_text(spark, sf):
    d = table(spark, sf, "documents")
    narrow = F.col("text").rlike(r"^[\x00-\xff]*$") & (F.col("doc_id") % 2 == 1)
    latin = F.encode(F.when(narrow, F.col("text")), "ISO-8859-1")
    raw = F.when(narrow, latin).otherwise(F.encode("text", "UTF-8"))
    return d.select("doc_id", F.md5(X.decode_bytes(raw)).alias("text_md5"))


@query("file_extension", r"""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'html' ELSE lower(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '[^/.][^/]*\.([^./]*)$', 1)) END AS ext,
  lower(regexp_extract(url || '/Report.' || page_id || '.PDF', '[^/.][^/]*\.([^./]*)$', 1)) AS ext2 FROM pages""")
def file_extension(spark, sf):
    p = table(spark, sf, "pages")
    bare = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    kind = F.when(F.col("page_id") % 3 == 0, " .HTML ").when(F.col("page_id") % 3 == 1, "  ")
    return p.select("page_id", X.file_extension(bare, kind).alias("ext"),
                    X.file_extension(F.concat("url", F.lit("/Report."), "page_id", F.lit(".PDF"))).alias("ext2"))


@query("path_candidates", f"""
WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN ' ' || url || ' ' WHEN 1 THEN to_base64(encode(url)) ELSE url_encode(url) END AS raw FROM pages),
q AS (SELECT page_id, trim(raw) AS bare FROM p)
SELECT page_id, 0 AS prio, bare AS candidate FROM q
UNION ALL SELECT page_id, 1, decode(from_base64(bare)) FROM q WHERE page_id % 3 = 1
UNION ALL SELECT page_id, 2, url_decode(bare) FROM q WHERE url_decode(bare) <> bare
{"".join(f" UNION ALL SELECT page_id, {i}, '{p}' || regexp_extract(bare, '([^/]+)/*$', 1) FROM q" for i, p in enumerate(X.UPLOAD_PREFIXES, 3))}""")
def path_candidates(spark, sf):
    third = F.col("page_id") % 3
    p = table(spark, sf, "pages").withColumn("raw", F.when(third == 0, F.concat(F.lit(" "), "url", F.lit(" ")))
        .when(third == 1, B.base64_of(F.col("url"))).otherwise(F.url_encode("url")))
    return p.select("page_id", F.explode(X.path_candidates(F.col("raw"))).alias("c")).select("page_id", "c.*")


@query("title_label", r"""
SELECT DISTINCT p_type || '_' || replace(p_name, ' ', '_') AS name,
  array_to_string(list_transform(string_split(replace(p_type || '_' || replace(p_name, ' ', '_'), '_', ' '), ' '),
    lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS label FROM part""")
def title_label(spark, sf):
    p = table(spark, sf, "part").select(
        F.concat_ws("_", "p_type", F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name")).distinct()
    return p.select("name", X.title_label(F.col("name")).alias("label"))


@query("parse_score", """
SELECT doc_id, coalesce(TRY_CAST(regexp_extract(text, '([0-9][0-9.]*)', 1) AS DOUBLE), 5.0) AS score FROM documents""")
def parse_score(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.parse_score(F.col("text")).alias("score"))


@query("parse_yesno", "SELECT doc_id, contains(lower(text), 'yes') AS yes, "
       "contains(lower(CASE WHEN doc_id % 2 = 0 THEN 'Yes. ' || text ELSE 'No' END), 'yes') AS even FROM documents")
def parse_yesno(spark, sf):
    verdict = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Yes. "), "text")).otherwise("No")
    return table(spark, sf, "documents").select("doc_id", X.parse_yesno(F.col("text")).alias("yes"),
                                                X.parse_yesno(verdict).alias("even"))


@query("parse_ts", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE date_trunc('second', ts) END AS ts FROM events")
def parse_ts(spark, sf):
    third = F.col("event_id") % 3
    raw = (F.when(third == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
           .when(third == 1, F.date_format("ts", "' 'yyyy-MM-dd'T'HH:mm:ss' '"))
           .otherwise(F.date_format("ts", "dd.MM.yyyy")))
    return table(spark, sf, "events").select("event_id", X.parse_timestamp(raw).alias("ts"))


# ---- predicates --------------------------------------------------------------


def _customers(spark, sf):
    """Customers as documents; negative balances have no balance entry."""
    c = table(spark, sf, "customer").withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    return D.build_documents(c, B.CUSTOMER)


_SQL_BALANCE = "(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END)"


def _where_sql(condition):
    return f"SELECT 'shop.customer.' || c_custkey AS doc_id FROM customer WHERE {condition}"


@query("where_eq_ne", " UNION ALL ".join([
    "SELECT 'eq' AS op, doc_id FROM (" + _where_sql("c_mktsegment = 'BUILDING'") + ")",
    "SELECT 'bare', doc_id FROM (" + _where_sql("c_nationkey = 7") + ")",
    "SELECT 'none', doc_id FROM (" + _where_sql(f"{_SQL_BALANCE} IS NULL") + ")",
    "SELECT 'ne', doc_id FROM (" + _where_sql("c_mktsegment <> 'BUILDING'") + ")",
    "SELECT 'missing', doc_id FROM (" + _where_sql("true") + ")"]))
def where_eq_ne(spark, sf):
    docs = _customers(spark, sf)
    tests = {"eq": {"c_mktsegment": {"$eq": "BUILDING"}}, "bare": {"c_nationkey": 7},
             "none": {"c_acctbal": {"$eq": None}}, "ne": {"c_mktsegment": {"$ne": "BUILDING"}},
             "missing": {"no_such_key": {"$ne": "x"}}}
    return reduce(DataFrame.unionByName, [
        docs.where(compile_where(w)).select(F.lit(op).alias("op"), "doc_id") for op, w in tests.items()])


@query("where_in_nin", " UNION ALL ".join([
    "SELECT 'in' AS op, doc_id FROM (" + _where_sql("c_nationkey IN (1, 2, 3)") + ")",
    "SELECT 'nin', doc_id FROM (" + _where_sql("c_mktsegment NOT IN ('BUILDING', 'MACHINERY')") + ")"]))
def where_in_nin(spark, sf):
    docs = _customers(spark, sf)
    tests = {"in": {"c_nationkey": {"$in": [1, 2, 3]}}, "nin": {"c_mktsegment": {"$nin": ["BUILDING", "MACHINERY"]}}}
    return reduce(DataFrame.unionByName, [
        docs.where(compile_where(w)).select(F.lit(op).alias("op"), "doc_id") for op, w in tests.items()])


@query("where_range", " UNION ALL ".join([
    "SELECT 'gt' AS op, doc_id FROM (" + _where_sql(f"{_SQL_BALANCE} > 9000") + ")",
    "SELECT 'lte', doc_id FROM (" + _where_sql(f"{_SQL_BALANCE} <= 100.5") + ")",
    "SELECT 'gte', doc_id FROM (" + _where_sql("c_nationkey >= 20") + ")",
    "SELECT 'lt', doc_id FROM (" + _where_sql("c_nationkey < 3") + ")"]))
def where_range(spark, sf):
    docs = _customers(spark, sf)
    tests = {"gt": {"c_acctbal": {"$gt": 9000}}, "lte": {"c_acctbal": {"$lte": 100.5}},
             "gte": {"c_nationkey": {"$gte": "20"}}, "lt": {"c_nationkey": {"$lt": 3}},
             "words": {"c_mktsegment": {"$gt": 0}}}
    return reduce(DataFrame.unionByName, [
        docs.where(compile_where(w)).select(F.lit(op).alias("op"), "doc_id") for op, w in tests.items()])


@query("where_bool_tree", """
SELECT event_id FROM events WHERE (event_type = 'purchase' AND value > 20) OR
  (event_type IN ('click', 'view') AND (user_id = 3 OR user_id >= 100) AND value <= 5)""")
def where_bool_tree(spark, sf):
    tree = {"$or": [
        {"event_type": "purchase", "value": {"$gt": 20}},
        {"$and": [{"event_type": {"$in": ["click", "view"]}},
                  {"$or": [{"user_id": 3}, {"user_id": {"$gte": 100}}]},
                  {"value": {"$lte": 5}}]},
    ]}
    columns = {k: F.col(k) for k in ("event_type", "user_id", "value")}
    return table(spark, sf, "events").where(compile_where(tree, columns)).select("event_id")


@query("scope_filter", f"SELECT doc_id, source_table FROM ({SQL_FAN_IN}) WHERE source_db = 'shop' AND source_table = 'orders' "
       f"UNION ALL SELECT doc_id, source_table FROM ({SQL_FAN_IN}) WHERE source_db = 'corpus'")
def scope_filter(spark, sf):
    docs, _ = fan_in(spark, Parquet(sf), B.FAN_IN)
    picked = docs.where(scope("shop", "orders")).unionByName(docs.where(scope("corpus")))
    return picked.select("doc_id", "source_table")


@query("lookup_by_ids", f"""
WITH d AS ({SQL_FAN_IN}) SELECT doc_id, source_table, text_md5 FROM d WHERE doc_id IN (
  SELECT 'corpus.documents.' || doc_id FROM labels UNION SELECT 'shop.customer.' || o_custkey FROM orders WHERE o_totalprice > 400000)""")
def lookup_by_ids(spark, sf):
    docs, _ = fan_in(spark, Parquet(sf), B.FAN_IN)
    rich = table(spark, sf, "orders").where("o_totalprice > 400000")
    ids = (table(spark, sf, "labels").select(F.concat(F.lit("corpus.documents."), "doc_id").alias("doc_id"))
           .unionByName(rich.select(F.concat(F.lit("shop.customer."), "o_custkey").alias("doc_id"))))
    return lookup(docs, ids).select("doc_id", "source_table", F.md5("text").alias("text_md5"))


@query("file_refs_nonblank", """
SELECT 'corpus.pages' AS table_key, page_id::VARCHAR AS row_id, 'url' AS path_col, trim(CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 5 = 1 THEN '   ' ELSE url END) AS path, '' AS file_type
FROM pages WHERE page_id % 5 > 1
UNION ALL SELECT 'corpus.pages', page_id::VARCHAR, 'copy', url || '.html', 'html' FROM pages""")
def file_refs_nonblank(spark, sf):
    from lectern.sources.files import file_refs

    fifth = F.col("page_id") % 5
    p = (table(spark, sf, "pages").withColumn("copy", F.concat("url", F.lit(".html")))
         .withColumn("url", F.when(fifth == 1, "   ").when(fifth > 1, F.col("url"))).withColumn("kind", F.lit("html")))
    cfg = replace(B.PAGES, file_columns=(("url", ""), ("copy", "kind")))
    return file_refs(p, cfg).select("table_key", "row_id", "path_col", "path", "file_type")
