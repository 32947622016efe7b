"""Collections, ledgers, syncs and files on the stand-in tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import chunks as C, documents as D, rollups as R
from lectern.operators.merge import one_per_key
from lectern.plans.sync import Files, Sync, embed_documents, file_chunk_documents
from lectern.queries import testbed as B
from lectern.queries.registry import query, sql_generic, sql_html, table
from lectern.queries.rendering import SQL_FAN_IN, _sql_documents
from lectern.session import scratch_path
from lectern.sources import files as S
from lectern.sources.collection import Collection
from lectern.sources.ledger import LEDGER_SCHEMA, Ledger
from lectern.sources.tables import Parquet, fan_in, widen
from lectern.streaming.sync import stream_changes, stream_parquet


def _shown(docs):
    return docs.select("doc_id", "source_db", "source_table", F.md5("text").alias("text_md5"))


# ---- collections -------------------------------------------------------------


@query("collection_write", f"SELECT source_db, source_table, count(DISTINCT doc_id) AS docs FROM ({SQL_FAN_IN}) GROUP BY 1, 2")
def collection_write(spark, sf):
    docs, _ = fan_in(spark, Parquet(sf), B.FAN_IN)
    path = Collection(spark, scratch_path(spark, "collection")).write_snapshot(embed_documents(one_per_key(docs)))
    return spark.read.parquet(path).groupBy("source_db", "source_table").agg(F.count("*").alias("docs"))


@query("collection_roundtrip", f"SELECT DISTINCT doc_id, source_db, source_table, text_md5 FROM ({SQL_FAN_IN})")
def collection_roundtrip(spark, sf):
    docs, _ = fan_in(spark, Parquet(sf), B.FAN_IN)
    store = Collection(spark, scratch_path(spark, "collection"))
    store.write_snapshot(embed_documents(one_per_key(docs)))
    return _shown(store.read())


@query("ledger_roundtrip", """
SELECT 'run-' || event_id AS run_id, ts AS run_ts, 'user.' || user_id AS table_key, event_id % 100 AS records,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status FROM events""")
def ledger_roundtrip(spark, sf):
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    failed = F.col("event_type") == "error"
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("run-"), "event_id").alias("run_id"), F.col("ts").alias("run_ts"),
        F.concat(F.lit("user."), "user_id").alias("table_key"), F.lit("incremental").alias("mode"),
        F.col("ts").alias("watermark"), (F.col("event_id") % 100).alias("records"),
        F.when(failed, "error").otherwise("success").alias("status"), F.when(failed, "x").alias("error"),
        F.col("value").alias("duration_ms"))
    ledger.append(rows.where(failed))
    ledger.append(rows.where(~failed))
    return ledger.read().select("run_id", "run_ts", "table_key", "records", "status")


# ---- syncs -------------------------------------------------------------------


def _sync(spark, sf, configs):
    return Sync(Parquet(sf), configs, Collection(spark, scratch_path(spark, "sync")))


@query("index_build", f"SELECT DISTINCT doc_id, source_db, source_table, text_md5 FROM ({SQL_FAN_IN})")
def index_build(spark, sf):
    docs = _sync(spark, sf, (*B.FAN_IN, B.MISSING)).build()
    return _shown(docs.where(F.size("embedding") > 0))


SQL_ORDERS = _sql_documents("shop", "orders", "Order", [("o_orderstatus", "O Orderstatus"), ("o_orderpriority", "O Orderpriority")],
                            "o_orderkey")
SQL_EVENTS = _sql_documents("corpus", "events", "Event", [("event_type", "Event Type"), ("props", "Props")], "event_id")
DATED = (B.ORDERS, B.EVENTS, B.CUSTOMER)


def _before(df, cfg):
    """The state of the tables before the second run."""
    cut = {"orders": "1999-01-01 00:00:00", "events": "2024-01-15 00:00:00"}.get(cfg.table)
    return df.where(F.col(cfg.date_column) < F.lit(cut).cast("timestamp_ntz")) if cut else df


@query("incremental_sync", f"{SQL_ORDERS} UNION ALL {SQL_EVENTS} UNION ALL " + _sql_documents(
    "shop", "customer", "Customer", [("c_name", "C Name"), ("c_mktsegment", "C Mktsegment")], "c_custkey"))
def incremental_sync(spark, sf):
    sync = _sync(spark, sf, DATED)
    sync.build(_before)
    return _shown(sync.incremental())


@query("sync_ledger", """
SELECT 'full' AS mode, 'shop.orders' AS table_key, 'success' AS status, count(*) AS records, max(o_orderdate) AS watermark FROM orders WHERE o_orderdate < '1999-01-01'
UNION ALL SELECT 'full', 'corpus.events', 'success', count(*), max(ts) FROM events WHERE ts < '2024-01-15'
UNION ALL SELECT 'full', 'shop.invoices', 'error', 0, NULL
UNION ALL SELECT 'incremental', 'shop.invoices', 'error', 0, NULL
UNION ALL SELECT 'incremental', 'shop.orders', 'success', count(*), max(o_orderdate) FROM orders
  WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders WHERE o_orderdate < '1999-01-01')
UNION ALL SELECT 'incremental', 'corpus.events', 'success', count(*), max(ts) FROM events
  WHERE ts >= (SELECT max(ts) FROM events WHERE ts < '2024-01-15')""")
def sync_ledger(spark, sf):
    sync = _sync(spark, sf, (B.ORDERS, replace(B.MISSING, date_column="i_date"), B.EVENTS))
    sync.build(_before)
    sync.incremental()
    return sync.ledger.read().select("mode", "table_key", "status", "records", "watermark")


@query("full_rescan", f"""
SELECT doc_id, source_db, source_table, text_md5, true AS live FROM ({SQL_ORDERS} WHERE o_orderstatus <> 'F')
UNION ALL SELECT doc_id, source_db, source_table, text_md5, false FROM ({SQL_ORDERS} WHERE o_orderstatus = 'F')""")
def full_rescan(spark, sf):
    sync = _sync(spark, sf, (B.ORDERS,))
    before = _shown(sync.build())
    after = sync.rescan(lambda df, cfg: df.where("o_orderstatus <> 'F'"))
    alive = after.select("doc_id", F.lit(True).alias("live"))
    return before.join(alive, "doc_id", "left").withColumn("live", F.coalesce("live", F.lit(False)))


@query("reindex_table", f"""
{_sql_documents("shop", "customer", "Customer", [("c_name", "C Name"), ("c_mktsegment", "C Mktsegment")], "c_custkey")}
UNION ALL {_sql_documents("shop", "supplier", "Supplier", [("upper(s_name)", "S Name")], "s_suppkey")} WHERE s_acctbal >= 0""")
def reindex_table(spark, sf):
    sync = _sync(spark, sf, (B.CUSTOMER, B.SUPPLIER))
    sync.build()
    return _shown(sync.reindex(B.SUPPLIER, lambda df, cfg: df.where("s_acctbal >= 0").withColumn("s_name", F.upper("s_name"))))


@query("stream_sync", f"""
SELECT 'corpus.events.' || user_id AS doc_id, ts AS version, md5({sql_generic("Event", [("event_type", "Event Type"), ("props", "Props")])}) AS text_md5
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1""")
def stream_sync(spark, sf):
    root = scratch_path(spark, "stream")
    events = table(spark, sf, "events")
    # Slices of several days each stand for files, which arrive in any order.
    events.repartitionByRange(6, "ts").write.parquet(f"{root}/in")
    store = Collection(spark, f"{root}/collection")
    rows = stream_parquet(spark, f"{root}/in", events.schema, files_per_batch=2)
    run = stream_changes(rows, replace(B.EVENTS, pk_column="user_id"), store, f"{root}/checkpoint", event_order=("ts",))
    run.awaitTermination()
    return store.read().select("doc_id", "version", F.md5("text").alias("text_md5"))


_SQL_NEWEST = f"""SELECT 'corpus.events.' || event_id AS doc_id, md5({sql_generic("Event", [("event_type", "Event Type"), ("props", "Props")])}) AS text_md5
FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'streamed' WHEN event_id % 5 = 1 THEN 'synced' ELSE event_type END AS event_type, props FROM events)"""


@query("stream_after_sync", _SQL_NEWEST)
def stream_after_sync(spark, sf):
    """A build, an incremental sync, a compaction and two streams, none of which may undo another's changes."""
    sync = _sync(spark, sf, (B.EVENTS,))
    kind = F.col("event_id") % 5
    sync.build(lambda df, cfg: df.where(F.col("event_id") % 10 != 0))
    # Every date is at or after the watermark here, so that the sync sees the rows it changes.
    last = F.lit("2030-01-01").cast("timestamp_ntz")
    sync.incremental(lambda df, cfg: df.where(kind == 1).withColumn("event_type", F.lit("synced")).withColumn("ts", last))
    events = table(spark, sf, "events")
    for half in (0, 5):
        root = scratch_path(spark, "stream")
        rows = events.where(F.col("event_id") % 10 == half).withColumn("event_type", F.lit("streamed"))
        rows.write.parquet(f"{root}/in")
        stream_changes(stream_parquet(spark, f"{root}/in", events.schema), B.EVENTS, sync.collection, f"{root}/checkpoint").awaitTermination()
        sync.collection.compact()
    return sync.collection.read().select("doc_id", F.md5("text").alias("text_md5"))


@query("build_subset", f"""{_sql_documents("shop", "customer", "Customer", [("upper(c_name)", "C Name"), ("c_mktsegment", "C Mktsegment")], "c_custkey")}
UNION ALL {_sql_documents("shop", "supplier", "Supplier", [("s_name", "S Name")], "s_suppkey")}""")
def build_subset(spark, sf):
    """A build of one table keeps the others, and nothing of a build that broke off."""
    store = Collection(spark, scratch_path(spark, "sync"))
    both = Sync(Parquet(sf), (B.CUSTOMER, B.SUPPLIER), store)
    both.build()
    broken = store.new_snapshot()
    broken.add(store.read().where("source_table = 'supplier'"), 7)
    Sync(Parquet(sf), (B.CUSTOMER,), store).build(lambda df, cfg: df.withColumn("c_name", F.upper("c_name")))
    store.compact()
    return _shown(store.read())


# ---- files -------------------------------------------------------------------


def _page_files(spark, sf):
    """Pages as files below the shared folder, with references that name them in several ways."""
    root = S.plain_path(scratch_path(spark, "files"))
    pages = widen(table(spark, sf, "pages"), "page_id").select(
        "page_id", F.concat("page_id", F.when(F.col("page_id") % 2 == 0, ".html").otherwise(".dat")).alias("name"),
        F.encode("html", "UTF-8").alias("content"))
    S.write_files(pages, root, "name", "content").agg(F.sum("length")).collect()
    full = F.concat(F.lit(f"{root}/"), "name")
    kind = F.col("page_id") % 5
    raw = (F.when(kind == 0, B.base64_of(full)).when(kind == 1, F.concat(F.lit("/old/place/"), "name"))
           .when(kind == 2, F.concat(F.lit("  "), full)).when(kind == 3, F.url_encode(full)).otherwise(full))
    refs = pages.select(
        F.lit("corpus.pages").alias("table_key"), F.col("page_id").cast("string").alias("row_id"),
        F.concat(F.lit("corpus.pages."), "page_id").alias("parent_id"), F.lit(0).alias("path_no"),
        F.lit("url").alias("path_col"), raw.alias("path"),
        F.when(F.col("page_id") % 2 == 1, "HTML").otherwise("").alias("file_type"))
    return refs, S.scan_files(spark, root), (f"{root}/",)


_SQL_PAGE_TEXT = f"SELECT page_id::VARCHAR AS row_id, nullif({sql_html('html')}, '') AS text FROM pages"


@query("file_scan_text", f"SELECT row_id, md5(text) AS text_md5, 'html' AS extension FROM ({_SQL_PAGE_TEXT})")
def file_scan_text(spark, sf):
    refs, files, prefixes = _page_files(spark, sf)
    return S.extract_refs(refs, files, prefixes=prefixes).select("row_id", F.md5("text").alias("text_md5"), "extension")


@query("file_batch_rollup", f"""
WITH r AS (SELECT row_id, CASE WHEN row_id::BIGINT % 7 IN (1, 2) THEN NULL ELSE text END AS text, row_id::BIGINT % 7 = 2 AS failed FROM ({_SQL_PAGE_TEXT}))
SELECT count(*) AS total_files, count_if(text IS NOT NULL)::BIGINT AS extracted, count_if(failed)::BIGINT AS failed,
  count_if(text IS NULL AND NOT failed)::BIGINT AS skipped, coalesce(sum(length(text)), 0)::BIGINT AS text_length FROM r""")
def file_batch_rollup(spark, sf):
    def broken(data: bytes) -> str:
        raise ValueError("cannot read this file")

    extractors = S.Extractors()
    extractors.register_python(("bad",), broken)
    refs, files, prefixes = _page_files(spark, sf)
    seventh = F.col("row_id").cast("bigint") % 7
    kinds = refs.withColumn("file_type", F.when(seventh == 1, "pdf").when(seventh == 2, "bad").otherwise("html"))
    return R.file_batch_rollup(S.file_results(S.extract_refs(kinds, files, extractors, prefixes)))


@query("extractor_dispatch", f"""
SELECT 'page' AS kind, page_id AS id, md5(nullif({sql_html('html')}, '')) AS text_md5 FROM pages
UNION ALL SELECT 'txt', doc_id, md5(nullif(trim(text, '{X.WHITESPACE}'), '')) FROM documents
UNION ALL SELECT 'bang', doc_id, md5(nullif(trim(replace(text, '.', '!'), '{X.WHITESPACE}'), '')) FROM documents
UNION ALL SELECT 'pdf', doc_id, NULL FROM documents""")
def extractor_dispatch(spark, sf):
    pages = widen(table(spark, sf, "pages"), "page_id").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("body"), F.lit("htm").alias("extension"))
    docs = widen(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    kinds = docs.select(F.explode(F.array(*map(F.lit, ("txt", "bang", "pdf")))).alias("kind"), F.col("doc_id").alias("id"),
                        F.col("text").alias("body"), F.col("kind").alias("extension"))
    files = pages.unionByName(kinds).withColumn("content", F.encode("body", "UTF-8")).drop("body")
    extractors = S.Extractors()
    extractors.register_python(("bang",), lambda data: data.decode().replace(".", "!"))
    return extractors.extract(files).select("kind", "id", F.md5("text").alias("text_md5"))


@query("csv_to_text", f"""
SELECT doc_id, md5(trim('doc_id | lang | source | text' || chr(10) || doc_id || ' | ' || lang || ' | ' || source || ' | ' || text, '{X.WHITESPACE}')) AS text_md5 FROM documents""")
def csv_to_text(spark, sf):
    d = widen(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"), "doc_id")
    row = F.to_csv(F.struct("doc_id", "lang", "source", "text"),
                   {"escape": '"', "quoteAll": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    files = d.select("doc_id", F.lit("csv").alias("extension"),
                     F.encode(F.concat(F.lit("doc_id,lang,source,text\n"), row), "UTF-8").alias("content"))
    return S.Extractors().extract(files).select("doc_id", F.md5("text").alias("text_md5"))


@query("csv_rows_as_docs", """
SELECT 'o_orderkey: ' || o_orderkey || chr(10) || 'o_custkey: ' || o_custkey || chr(10) || 'o_orderstatus: ' || o_orderstatus || chr(10) ||
  'o_orderpriority: ' || o_orderpriority AS text FROM orders""")
def csv_rows_as_docs(spark, sf):
    path = scratch_path(spark, "csv")
    columns = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    table(spark, sf, "orders").select(*columns).write.option("header", True).csv(path)
    rows = spark.read.option("header", True).schema(", ".join(f"{c} string" for c in columns)).csv(path)
    return S.csv_rows_as_documents(rows).select("text")


@query("file_chunks", f"""
WITH t AS ({_SQL_PAGE_TEXT}), c AS (SELECT row_id, text, unnest(range(0, greatest(ceil((length(text) - 1000) / 800.0), 0)::BIGINT + 1)) AS i
  FROM t WHERE text IS NOT NULL)
SELECT 'corpus.pages.' || row_id || '.chunk_' || i AS doc_id, i::INT AS chunk_index, (count(*) OVER (PARTITION BY row_id))::INT AS total_chunks,
  md5(substr(text, i * 800 + 1, 1000)) AS text_md5 FROM c""")
def file_chunks(spark, sf):
    refs, files, prefixes = _page_files(spark, sf)
    docs = file_chunk_documents(refs, files, B.PAGES, recursive=False, prefixes=prefixes)
    store = Collection(spark, scratch_path(spark, "chunks"))
    store.append_changes(docs, unique=True)
    meta = F.col("metadata")
    return store.read().select("doc_id", meta["chunk_index"].cast("int").alias("chunk_index"),
                               meta["total_chunks"].cast("int").alias("total_chunks"), F.md5("text").alias("text_md5"))


_CUSTOMER_LINES = ("'c_custkey: ' || c_custkey || chr(10) || 'c_name: ' || c_name || chr(10) || 'c_mktsegment: ' || c_mktsegment || chr(10) || "
                   "'note: 5\" \"' || chr(10) || 'x, y'")


@query("file_chunks_records", f"""
WITH r AS (SELECT c_nationkey, {_CUSTOMER_LINES} AS text, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer)
SELECT 'corpus.nation.' || c_nationkey || '.chunk_' || i AS doc_id, i::INT AS chunk_index,
  (count(*) OVER (PARTITION BY c_nationkey))::INT AS total_chunks, md5(text) AS text_md5 FROM r""")
def file_chunks_records(spark, sf):
    """Files of records, one text each, counted through by blocks; the blocks are set small here."""
    row = F.to_csv(F.struct("c_custkey", "c_name", "c_mktsegment", F.lit('5" "\nx, y').alias("note")),
                   {"escape": '"', "quoteAll": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    lines = table(spark, sf, "customer").select("c_nationkey", F.struct("c_custkey", row.alias("row")).alias("line"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["row"]), "\n")
    files = lines.groupBy("c_nationkey").agg(F.encode(F.concat(F.lit("c_custkey,c_name,c_mktsegment,note\n"), rows, F.lit("\n\n")), "UTF-8").alias("content"))
    parts = S.text_parts(S.Extractors().documents(files.withColumn("extension", F.lit("csv"))), "c_nationkey")
    cut = C.chunks_through(parts, ["c_nationkey"], block=7)
    return cut.select(F.concat(F.lit("corpus.nation."), "c_nationkey", F.lit(".chunk_"), "chunk_index").alias("doc_id"),
                      "chunk_index", "total_chunks", F.md5("text").alias("text_md5"))


_SQL_KEPT = f"""WITH t AS ({_SQL_PAGE_TEXT}), p AS (SELECT page_id, url FROM pages WHERE page_id % 7 <> 3),
f AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN page_id ELSE page_id - page_id % 5 END AS file FROM p),
c AS (SELECT page_id, text, unnest(range(0, greatest(ceil((length(text) - 1000) / 800.0), 0)::BIGINT + 1)) AS i
  FROM f JOIN t ON t.row_id = f.file::VARCHAR WHERE text IS NOT NULL)
SELECT 'corpus.pages.' || page_id || '.chunk_' || i AS doc_id, md5(substr(text, i * 800 + 1, 1000)) AS text_md5 FROM c
UNION ALL SELECT 'corpus.pages.' || page_id, md5({sql_generic("Page", [("url", "Url")])}) FROM p"""


@query("sync_files", _SQL_KEPT)
def sync_files(spark, sf):
    """Chunks through a build, an incremental sync that moves files to other records, a re-index without some records,
    and a rescan."""
    root = S.plain_path(scratch_path(spark, "files"))
    pages = widen(table(spark, sf, "pages"), "page_id")
    named = pages.select("page_id", F.concat("page_id", F.lit(".html")).alias("name"), F.encode("html", "UTF-8").alias("content"))
    S.write_files(named, root, "name", "content").agg(F.sum("length")).collect()
    cfg = replace(B.PAGES, metadata_columns=(), date_column="seen", file_columns=(("place", ""),))

    def rows(first: bool, some: bool):
        id_ = F.col("page_id")
        file = id_ if first else id_ - id_ % 5
        seen = F.lit("2024-01-01" if first else "2024-01-02").cast("timestamp_ntz")
        full = pages.select("page_id", "url", F.concat(F.lit(f"{root}/"), file.cast("string"), F.lit(".html")).alias("place"),
                            F.when(id_ % 5 == 0, F.lit("2024-01-01").cast("timestamp_ntz")).otherwise(seen).alias("seen"))
        return lambda df, _: full.where(id_ % 7 != 3) if some else full

    store = Collection(spark, scratch_path(spark, "sync"))
    sync = Sync(Parquet(sf), (cfg,), store, files=Files(lambda: S.scan_files(spark, root), recursive=False, prefixes=(f"{root}/",)))
    sync.build(rows(True, False))
    sync.incremental(rows(False, False))
    sync.reindex(cfg, rows(False, True))
    # Without its files, a sync keeps the chunks of the records that are left.
    done = Sync(Parquet(sf), (cfg,), store).rescan(rows(False, True))
    return done.select("doc_id", F.md5("text").alias("text_md5"))
