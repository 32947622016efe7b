"""Vector search and question answering on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import models as U, text as X, vectors as V
from lectern.operators import answers as A, chunks as C, documents as D, joins as J, rollups as R, search as S
from lectern.operators.skew import fits_broadcast
from lectern.plans import answering as P
from lectern.queries import testbed as B
from lectern.queries.registry import query, sql_generic, sql_hits, sql_tokens, sql_vectors, table
from lectern.session import materialise, scratch_path
from lectern.sources.collection import Collection
from lectern.sources.tables import widen
from lectern.sources.terms import TermIndex

# ---- vectors -----------------------------------------------------------------


@query("vec_normalise", """
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE * label AS x, generate_subscripts(embedding, 1)::INT - 1 AS pos FROM embeddings),
n AS (SELECT vec_id, sqrt(sum(x::FLOAT::DOUBLE * x::FLOAT::DOUBLE)) AS len FROM e GROUP BY 1)
SELECT vec_id, pos, round((x::FLOAT::DOUBLE / CASE WHEN len = 0 THEN 1 ELSE len END)::FLOAT::DOUBLE, 5) + 0.0::DOUBLE AS v FROM e JOIN n USING (vec_id)""")
def vec_normalise(spark, sf):
    e = table(spark, sf, "embeddings")
    scaled = F.transform("embedding", lambda x: (x.cast("double") * F.col("label")).cast("float"))
    unit = e.select("vec_id", F.posexplode(V.normalise(scaled)).alias("pos", "v"))
    return unit.withColumn("v", F.round(F.col("v").cast("double"), 5) + 0.0)


def _centroids(spark, sf):
    """One query per label: the mean vector of its members."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    mean = e.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).cast("float").alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])
    return mean.groupBy("label").agg(ordered.alias("embedding")).withColumnRenamed("label", "query_id")


_SQL_QUERIES = """q AS (SELECT label AS query_id, list(x ORDER BY pos)::DOUBLE[] AS qvec FROM (
  SELECT label, pos, round(avg(x), 6)::FLOAT AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x,
  generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"""


def _sql_knn(k, where="true"):
    return (f"SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY "
            f"score DESC, doc_id)::INT AS rank FROM (SELECT query_id, vec_id AS doc_id, "
            f"round(list_inner_product(embedding::DOUBLE[], qvec), 12) AS score FROM embeddings, q WHERE {where})) "
            f"WHERE rank <= {k}")


def _knn(spark, sf, k, where=None):
    e = widen(table(spark, sf, "embeddings"), "vec_id")
    return S.topk(e, _centroids(spark, sf), k, where=where, doc_id="vec_id")


@query("knn_topk", f"WITH {_SQL_QUERIES} {_sql_knn(10)}")
def knn_topk(spark, sf):
    return _knn(spark, sf, 10)


@query("knn_blocks", f"WITH {_SQL_QUERIES} {_sql_knn(10)}")
def knn_blocks(spark, sf):
    """The same for more queries than go to a task at once: the bound is set low here."""
    e = widen(table(spark, sf, "embeddings"), "vec_id")
    return S.topk(e, _centroids(spark, sf), 10, doc_id="vec_id", max_queries=3)


@query("knn_filtered", f"WITH {_SQL_QUERIES} {_sql_knn(10, 'label IN (1, 3)')}")
def knn_filtered(spark, sf):
    return _knn(spark, sf, 10, F.col("label").isin(1, 3))


@query("knn_overfetch_postfilter", f"""
WITH {_SQL_QUERIES}, h AS ({_sql_knn(50)}) SELECT query_id, rank, doc_id, score FROM (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY h.rank)::INT AS rank
  FROM h JOIN embeddings ON doc_id = vec_id WHERE label <= 2) WHERE rank <= 5""")
def knn_overfetch_postfilter(spark, sf):
    e = widen(table(spark, sf, "embeddings"), "vec_id")
    return S.topk_postfilter(e, _centroids(spark, sf), 5, F.col("label") <= 2, doc_id="vec_id")


@query("knn_hits_per_query", f"""
WITH {_SQL_QUERIES}, h AS ({_sql_knn(5)})
SELECT query_id, string_agg(doc_id || ':' || score::DECIMAL(10,4), ',' ORDER BY rank) AS hits, count(*) AS n FROM h GROUP BY 1""")
def knn_hits_per_query(spark, sf):
    lists = S.hits_per_query(_knn(spark, sf, 5))
    shown = F.transform("hits", lambda h: F.concat(h["doc_id"], F.lit(":"), h["score"].cast("decimal(10,4)")))
    return lists.select("query_id", F.array_join(shown, ",").alias("hits"), F.size("hits").cast("bigint").alias("n"))


@query("hit_rate_at_k", f"""
WITH {_SQL_QUERIES}, h AS ({_sql_knn(5)}), j AS (SELECT query_id, bool_or(label = query_id) AS hit FROM h JOIN embeddings ON doc_id = vec_id GROUP BY 1)
SELECT count(*) AS queries, round(avg(hit::INT), 6) AS hit_rate, avg(hit::INT) >= 0.7 AS passed FROM j""")
def hit_rate_at_k(spark, sf):
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    hits = _knn(spark, sf, 5).join(labels, "doc_id")
    expected = labels.select(F.col("label").alias("query_id"), "label").distinct()
    return R.hit_rate(hits, expected)


# ---- embedding and text search -----------------------------------------------

_SQL_DOCS = ("d AS (SELECT 'corpus.documents.' || doc_id AS doc_id, " + sql_generic("Document", [("text", "Text")])
             + " AS text, lang FROM documents), q AS (SELECT item_id AS query_id, text AS question FROM benchmark), "
             + f"dv AS ({sql_vectors('d', 'doc_id', 'text')}), qv AS ({sql_vectors('q', 'query_id', 'question')})")


def _sql_search(k):
    return f"WITH {_SQL_DOCS}, hits AS ({sql_hits('dv', 'qv', k)}), h AS (SELECT * FROM hits JOIN d USING (doc_id) JOIN q USING (query_id))"


def collection(spark, sf):
    """Documents with their embeddings."""
    d = widen(table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars"), "doc_id")
    docs = D.build_documents(d, B.DOCUMENTS)
    return docs.withColumn("embedding", V.embed_hashed(F.col("text")))


def _indexed(spark, docs):
    """The documents as a stored collection, and the index of its terms."""
    store = Collection(spark, scratch_path(spark, "collection"))
    index = TermIndex(store)
    more = {c: F.lit(None).cast(t) for c, t in (("pk_value", "string"), ("metadata", "map<string,string>"), ("version", "timestamp_ntz"))}
    store.write_snapshot(docs.withColumns({c: v for c, v in more.items() if c not in docs.columns}))
    index.refresh()
    return store.read(), index


def questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _hits(spark, sf, k):
    return P.ask(collection(spark, sf), questions(spark, sf), k)


_SQL_EMBEDDED = f"SELECT id AS doc_id, bucket::INT AS bucket, round(w, 5) AS w FROM ({sql_vectors('documents', 'doc_id', 'text')})"


def _buckets(df):
    long = df.select("doc_id", F.posexplode_outer("embedding").alias("bucket", "w")).where(F.col("w") > 0)
    return long.withColumn("w", F.round(F.col("w").cast("double"), 5))


@query("embed_hashed", _SQL_EMBEDDED)
def embed_hashed(spark, sf):
    d = widen(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return _buckets(d.select("doc_id", V.embed_hashed(F.col("text")).alias("embedding")))


def hashed_model():
    """A user model for the embedder slot: the default embedding in numpy, words cached per task."""
    import hashlib
    import re

    import numpy as np

    words = re.compile(r"[^\W_]+")
    seen: dict[str, int] = {}

    def bucket(word):
        if word not in seen:
            seen[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % V.HASHED_DIM
        return seen[word]

    def embed(texts):
        return [np.bincount([bucket(w) for w in words.findall(t.lower())], minlength=V.HASHED_DIM) for t in texts]

    return embed


@query("embed_udf", _SQL_EMBEDDED)
def embed_udf(spark, sf):
    d = widen(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    made = d.select("doc_id", U.embed_with(hashed_model, F.col("text"), V.HASHED_DIM).alias("m"))
    return _buckets(made.where("m.embed_ok").select("doc_id", "m.embedding"))


@query("text_search_topk", f"{_sql_search(5)} SELECT query_id, rank, doc_id, score FROM h")
def text_search_topk(spark, sf):
    asked = questions(spark, sf).withColumn("embedding", V.embed_hashed(F.col("question")))
    return S.topk(collection(spark, sf), asked, 5)


_SQL_HITS = f"""{_sql_search(5)}
SELECT query_id, rank, doc_id, round(score, 4) AS score, 'Document' AS label, 'corpus' AS source_db, 'documents' AS source_table,
  substr(text, 1, 400) AS snippet FROM h"""


@query("hit_projection", _SQL_HITS)
def hit_projection(spark, sf):
    return D.project_hits(_hits(spark, sf, 5))


@query("hits_large", _SQL_HITS)
def hits_large(spark, sf):
    """The same for hits that are too many to be sent to every task: the bound is set low here."""
    return D.project_hits(P.ask(collection(spark, sf), questions(spark, sf), 5, small_hits=0))


_SQL_COVER = (f"(len(list_intersect(list_distinct({sql_tokens('question')}), {sql_tokens('text')}))::DOUBLE "
              f"/ len(list_distinct({sql_tokens('question')})))")


@query("rank_hits", f"""{_sql_search(10)}, s AS (SELECT query_id, doc_id, round({_SQL_COVER}, 4) AS share FROM h)
SELECT query_id, doc_id, share, row_number() OVER (PARTITION BY query_id ORDER BY share DESC, doc_id)::INT AS rank FROM s""")
def rank_hits(spark, sf):
    share = A.coverage(F.col("question"), F.col("text"))
    scored = _hits(spark, sf, 10).withColumn("share", F.round(share, 4)).drop("rank")
    return A.rank_hits(scored, "share").select("query_id", "doc_id", "share", "rank")


@query("grade_documents", f"{_sql_search(10)} SELECT query_id, doc_id, {_SQL_COVER} >= 0.8 AS relevant FROM h")
def grade_documents(spark, sf):
    return A.grade(_hits(spark, sf, 10), 0.8).select("query_id", "doc_id", "relevant")


@query("pair_score", f"{_sql_search(10)} SELECT query_id, doc_id, round({_SQL_COVER}, 4) AS rerank_score FROM h")
def pair_score(spark, sf):
    return A.pair_score(_hits(spark, sf, 10)).select("query_id", "doc_id", "rerank_score")


_SQL_RERANKED = f"""r AS (SELECT query_id, doc_id, question, text, lang, score, rank AS old_rank, round({_SQL_COVER}, 4) AS rerank_score FROM h),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, old_rank)::INT AS rank FROM r)"""


@query("rerank_topn", f"{_sql_search(10)}, {_SQL_RERANKED} SELECT query_id, rank, old_rank, doc_id, rerank_score FROM rr WHERE rank <= 4")
def rerank_topn(spark, sf):
    return A.rerank(_hits(spark, sf, 10), 4).select("query_id", "rank", "old_rank", "doc_id", "rerank_score")


@query("context_block", f"""{_sql_search(5)} SELECT query_id, md5(string_agg('[' || rank || '] Document (corpus.documents)' || chr(10) ||
  text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_md5, count(*) AS n_docs FROM h GROUP BY 1""")
def context_block(spark, sf):
    return A.context_block(_hits(spark, sf, 5)).select("query_id", F.md5("context").alias("context_md5"), "n_docs")


_SQL_SENTENCES = f"""s AS (SELECT query_id, rank, question, unnest(regexp_extract_all(text, '{A.SENTENCE}')) AS text,
  generate_subscripts(regexp_extract_all(text, '{A.SENTENCE}'), 1) AS i FROM h),
b AS (SELECT query_id, rank, trim(text, '{X.WHITESPACE}') AS text, row_number() OVER (PARTITION BY query_id, rank
  ORDER BY len(list_intersect(list_distinct({sql_tokens('question')}), {sql_tokens('text')})) DESC, i) AS rn FROM s WHERE trim(text, '{X.WHITESPACE}') <> '')"""


@query("answer_extractive", f"""{_sql_search(5)}, {_SQL_SENTENCES}
SELECT query_id, string_agg(text || ' [' || rank || ']', ' ' ORDER BY rank) AS answer FROM b WHERE rn = 1 GROUP BY 1""")
def answer_extractive(spark, sf):
    return A.extractive_answer(_hits(spark, sf, 5))


@query("groundedness", f"""{_sql_search(10)}, s AS (SELECT query_id, question, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS text
  FROM h GROUP BY 1, 2), g AS (SELECT query_id, round({_SQL_COVER}, 4) AS groundedness FROM s)
SELECT query_id, groundedness, groundedness >= 0.8 AS grounded FROM g""")
def groundedness(spark, sf):
    hits = _hits(spark, sf, 10)
    said = questions(spark, sf).select("query_id", F.col("question").alias("answer"))
    return A.groundedness(said, hits, 0.8).select("query_id", "groundedness", "grounded")


_SQL_PARTS = """p AS (SELECT 'corpus.documents.' || doc_id || '.chunk_' || i AS doc_id, substr(text, i * 800 + 1, 1000) AS text FROM
  (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(ceil((length(text) - 1000) / 800.0), 0)::BIGINT + 1 END)) AS i FROM documents))"""


def collection_with_chunks(spark, sf):
    docs = collection(spark, sf)
    raw = widen(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    parts = C.chunk_documents(raw.withColumn("doc_id", F.concat(F.lit("corpus.documents."), "doc_id")))
    chunks = parts.select(F.col("chunk_id").alias("doc_id"), F.lit("Document").alias("doc_label"),
                          F.lit("corpus").alias("source_db"), F.lit("documents").alias("source_table"),
                          F.col("chunk_text").alias("text"), V.embed_hashed(F.col("chunk_text")).alias("embedding"))
    return docs.select(*chunks.columns).unionByName(chunks)


_SQL_ENRICHED = f"""WITH {_SQL_DOCS}, {_SQL_PARTS}, a AS (SELECT * FROM dv UNION ALL {sql_vectors('p', 'doc_id', 'text')}),
h AS ({sql_hits('a', 'qv', 5)}),
n AS (SELECT query_id, rank, doc_id || '.chunk_0' AS doc_id, score, true AS added FROM h WHERE NOT contains(doc_id, '.chunk_')
  AND (query_id, doc_id || '.chunk_0') NOT IN (SELECT query_id, doc_id FROM h) AND doc_id || '.chunk_0' IN (SELECT doc_id FROM p))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, added)::INT AS position, doc_id, score, added
FROM (SELECT query_id, rank, doc_id, score, false AS added FROM h UNION ALL SELECT * FROM n)"""


@query("enrich_first_chunk", _SQL_ENRICHED)
def enrich_first_chunk(spark, sf):
    parts = collection_with_chunks(spark, sf)
    asked = questions(spark, sf).withColumn("embedding", V.embed_hashed(F.col("question")))
    hits = materialise(S.topk(parts, asked, 5), "hits")
    more = J.enrich_first_chunk(hits, parts, (), small=fits_broadcast(hits, P.SMALL_HITS))
    return more.select("query_id", "position", "doc_id", "score", "added")


@query("enrich_large", _SQL_ENRICHED)
def enrich_large(spark, sf):
    """The same for hits that are too many to be sent to every task."""
    parts = materialise(collection_with_chunks(spark, sf), "parts")
    asked = questions(spark, sf).withColumn("embedding", V.embed_hashed(F.col("question")))
    more = J.enrich_first_chunk(materialise(S.topk(parts, asked, 5), "hits"), parts, ())
    return more.select("query_id", "position", "doc_id", "score", "added")


_SQL_SOURCES = f"""{_sql_search(5)}, {_SQL_RERANKED} SELECT query_id, rank, doc_id, round(score, 4) AS score, rerank_score,
  md5(substr(text, 1, 400)) AS snippet_md5, CASE WHEN lang = 'en' THEN '/files/' || doc_id END AS file_link FROM rr"""


@query("sources_large", _SQL_SOURCES)
def sources_large(spark, sf):
    """The same for sources that are too many to be sent to every task."""
    return rag_sources(spark, sf, large=True)


@query("rag_sources", _SQL_SOURCES)
def rag_sources(spark, sf, large=False):
    docs = collection(spark, sf)
    hits = A.rerank(_hits(spark, sf, 5))
    path = F.when(F.col("metadata")["lang"] == "en", F.concat(F.lit("/data/"), F.col("pk_value"), F.lit(".txt")))
    hits = materialise(hits, "hits")
    ids = hits.select("doc_id").distinct()
    paths = J.file_path_for_doc(ids, docs, path, small=not large and fits_broadcast(ids, P.SMALL_HITS))
    one = A.source_list(hits, paths).select("query_id", F.explode("sources").alias("s"))
    return one.select("query_id", "s.rank", "s.doc_id", F.round("s.score", 4).alias("score"), "s.rerank_score",
                      F.md5("s.snippet").alias("snippet_md5"), "s.file_link")


@query("rag_fallback", f"""{_sql_search(5)}, good AS (SELECT DISTINCT query_id FROM h WHERE score >= 0.5)
SELECT query_id, CASE WHEN query_id NOT IN (SELECT query_id FROM good) THEN '{A.NO_HITS}'
  WHEN length(question) % 2 = 0 THEN '{A.NO_MODEL}' ELSE question END AS answer, query_id IN (SELECT query_id FROM good) AS has_hits FROM q""")
def rag_fallback(spark, sf):
    asked = questions(spark, sf)
    hits = _hits(spark, sf, 5).where("score >= 0.5")
    answered = asked.where(F.length("question") % 2 == 1).select("query_id", F.col("question").alias("answer"))
    return A.with_fixed_answers(asked, answered, hits).select("query_id", "answer", "has_hits")


RETRY_AT = 0.9

_SQL_RETRY = f"""{_sql_search(5)}, g AS (SELECT query_id, rank, doc_id, {_SQL_COVER} >= {RETRY_AT} AS relevant FROM h),
failing AS (SELECT * FROM q WHERE query_id NOT IN (SELECT query_id FROM g WHERE relevant)),
t AS (SELECT query_id, unnest(list_distinct({sql_tokens('question')})) AS term FROM failing),
f AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({sql_tokens('text')})) AS term FROM d) WHERE term IN (SELECT term FROM t) GROUP BY 1),
w AS (SELECT query_id, string_agg(term, ' ' ORDER BY place) AS new_question FROM (SELECT query_id, term, row_number() OVER
  (PARTITION BY query_id ORDER BY df, term) AS place FROM t JOIN f USING (term)) WHERE place <= 8 GROUP BY 1),
q2 AS (SELECT query_id, coalesce(new_question, question) AS question, new_question IS NOT NULL AS rewritten FROM failing LEFT JOIN w USING (query_id)),
qv2 AS ({sql_vectors('q2', 'query_id', 'question')}), hits2 AS ({sql_hits('dv', 'qv2', 5)}),
g2 AS (SELECT query_id, rank, doc_id, rewritten, {_SQL_COVER} >= {RETRY_AT} AS relevant FROM hits2 JOIN d USING (doc_id) JOIN q2 USING (query_id))
SELECT query_id, rank, doc_id, relevant, false AS rewritten FROM g WHERE relevant
UNION ALL SELECT query_id, rank, doc_id, relevant, rewritten FROM g2 WHERE relevant OR query_id NOT IN (SELECT query_id FROM g2 WHERE relevant)"""


@query("rag_retry", _SQL_RETRY)
def rag_retry(spark, sf):
    docs, index = _indexed(spark, collection(spark, sf))
    kept = P.retrieve_graded(docs, questions(spark, sf), 5, RETRY_AT, frequencies=index.frequencies())
    return kept.select("query_id", "rank", "doc_id", "relevant", "rewritten")


@query("rag_retry_large", _SQL_RETRY)
def rag_retry_large(spark, sf):
    """The same without an index of terms, and with more hits than are sent to every task."""
    stored = materialise(collection(spark, sf), "collection")
    kept = P.retrieve_graded(stored, questions(spark, sf), 5, RETRY_AT, small_hits=0)
    return kept.select("query_id", "rank", "doc_id", "relevant", "rewritten")


_SQL_TERMS = f"""WITH d AS (SELECT 'Document' || chr(10) || 'Text: ' || CASE WHEN doc_id % 5 = 0 THEN lang || ' ' || source ELSE text END AS text, doc_id
  FROM documents WHERE doc_id % 7 <> 0 AND trim(text, '{X.WHITESPACE}') <> '')
SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({sql_tokens('text')})) AS term FROM d) GROUP BY 1"""


@query("term_frequencies", _SQL_TERMS)
def term_frequencies(spark, sf):
    """Documents per term after a snapshot, a batch of changed texts, one of removals and a compaction between them."""
    d = widen(table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars"), "doc_id").where(F.trim("text") != "")
    short = d.where(F.col("doc_id") % 5 == 0).withColumn("text", F.concat_ws(" ", "lang", "source"))
    store = Collection(spark, scratch_path(spark, "collection"))
    index = TermIndex(store)
    none = F.lit(None).cast("array<float>")
    store.write_snapshot(D.build_documents(d.where(F.col("doc_id") % 3 != 1), B.DOCUMENTS).withColumn("embedding", none))
    index.refresh()
    store.append_changes(D.build_documents(d.where(F.col("doc_id") % 3 == 1), B.DOCUMENTS).withColumn("embedding", none))
    index.refresh()
    store.compact()
    store.append_changes(D.build_documents(short, B.DOCUMENTS).withColumn("embedding", none))
    gone = D.build_documents(d.where(F.col("doc_id") % 7 == 0), B.DOCUMENTS).withColumn("embedding", none)
    store.append_changes(gone.withColumn("deleted", F.lit(True)))
    index.refresh()
    return index.frequencies()


def _sql_with_chunks(hits):
    """Hits and the first chunks of records among them, in one order."""
    return f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, added)::INT AS rank, doc_id, text, question FROM (
  SELECT *, false AS added FROM {hits} UNION ALL SELECT k.query_id, k.rank, p.doc_id, p.text, k.question, true FROM {hits} k
  JOIN p ON p.doc_id = k.doc_id || '.chunk_0' WHERE NOT contains(k.doc_id, '.chunk_') AND (k.query_id, p.doc_id) NOT IN (SELECT query_id, doc_id FROM {hits}))"""


_SQL_BATCH = f"""WITH {_SQL_DOCS}, {_SQL_PARTS}, texts AS (SELECT doc_id, text FROM d UNION ALL SELECT doc_id, text FROM p),
av AS (SELECT * FROM dv UNION ALL {sql_vectors('p', 'doc_id', 'text')}),
h AS (SELECT query_id, rank, doc_id, text, question FROM ({sql_hits('av', 'qv', 5)}) JOIN texts USING (doc_id) JOIN q USING (query_id)),
e AS ({_sql_with_chunks('h')}), g AS (SELECT *, {_SQL_COVER} >= 0.8 AS relevant FROM e),
failing AS (SELECT * FROM q WHERE query_id NOT IN (SELECT query_id FROM g WHERE relevant)),
t AS (SELECT query_id, unnest(list_distinct({sql_tokens('question')})) AS term FROM failing),
f AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({sql_tokens('text')})) AS term FROM texts) WHERE term IN (SELECT term FROM t) GROUP BY 1),
w AS (SELECT query_id, string_agg(term, ' ' ORDER BY place) AS new_question FROM (SELECT query_id, term, row_number() OVER
  (PARTITION BY query_id ORDER BY df, term) AS place FROM t JOIN f USING (term)) WHERE place <= 8 GROUP BY 1),
q2 AS (SELECT query_id, coalesce(new_question, question) AS question, new_question IS NOT NULL AS rewritten FROM failing LEFT JOIN w USING (query_id)),
qv2 AS ({sql_vectors('q2', 'query_id', 'question')}),
h2 AS (SELECT query_id, rank, doc_id, text, question FROM ({sql_hits('av', 'qv2', 5)}) JOIN texts USING (doc_id) JOIN q2 USING (query_id)),
e2 AS ({_sql_with_chunks('h2')}), g2 AS (SELECT *, {_SQL_COVER} >= 0.8 AS relevant FROM e2 JOIN (SELECT query_id, rewritten FROM q2) USING (query_id)),
work AS (SELECT query_id, rank AS old_rank, doc_id, text, question, false AS rewritten FROM g WHERE relevant UNION ALL
  SELECT query_id, rank, doc_id, text, question, rewritten FROM g2 WHERE relevant OR query_id NOT IN (SELECT query_id FROM g2 WHERE relevant)),
r AS (SELECT query_id, old_rank, doc_id, text, question, rewritten, round({_SQL_COVER}, 4) AS rerank_score FROM work),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, old_rank)::INT AS rank FROM r),
{_SQL_SENTENCES.replace("FROM h)", "FROM rr)")},
a AS (SELECT query_id, string_agg(text || ' [' || rank || ']', ' ' ORDER BY rank) AS answer FROM b WHERE rn = 1 GROUP BY 1),
heads AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS text FROM rr GROUP BY 1),
c AS (SELECT query_id, question AS answer, round({_SQL_COVER}, 4) >= 0.8 AS grounded FROM (
  SELECT query_id, answer AS question, text FROM a JOIN heads USING (query_id))),
o AS (SELECT query_id, bool_or(rewritten) AS rewritten, count(*) AS n_sources, string_agg(rank || ':' || doc_id, ',' ORDER BY rank) AS sources FROM rr GROUP BY 1)
SELECT q.query_id, coalesce(answer, '{A.NO_HITS}') AS answer, o.query_id IS NOT NULL AS has_hits, grounded,
  coalesce(rewritten, false) AS rewritten, coalesce(n_sources, 0) AS n_sources, coalesce(sources, '') AS sources
FROM q LEFT JOIN c USING (query_id) LEFT JOIN o ON o.query_id = q.query_id"""


@query("rag_batch", _SQL_BATCH)
def rag_batch(spark, sf):
    docs, index = _indexed(spark, collection_with_chunks(spark, sf))
    rows = P.answer_questions(docs, questions(spark, sf), 5, grading=True, threshold=0.8, frequencies=index.frequencies())
    shown = F.transform("sources", lambda s: F.concat(s["rank"], F.lit(":"), s["doc_id"]))
    return rows.select("query_id", "answer", "has_hits", "grounded", "rewritten", "n_sources",
                       F.coalesce(F.array_join(shown, ","), F.lit("")).alias("sources"))
