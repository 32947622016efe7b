"""Batch question answering over a table of questions.

Retrieve, add first file chunks, grade; where nothing was relevant do all that
once more with a rewritten question; then rerank, answer, check the answer, list the sources.
Each stage adds columns or rows; no stage loops over questions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import text as X
from lectern.functions.vectors import embed_hashed
from lectern.operators import answers as A
from lectern.operators.joins import enrich_first_chunk
from lectern.operators.merge import top_per_group
from lectern.operators.search import search
from lectern.operators.skew import fits_broadcast, skewed_join
from lectern.session import materialise

DEFAULT_TOP_K = 10
REWRITE_TERMS = 8
SMALL_TERMS = 200_000
SMALL_HITS = 100_000
HIT_COLUMNS = ("doc_label", "source_db", "source_table", "text")


@dataclass(frozen=True)
class Models:
    """Slots of the chain; empty ones use the deterministic defaults."""
    embed: Callable[[Column], Column] = embed_hashed
    grader: A.PairFunction | None = None
    scorer: A.PairFunction | None = None
    generator: A.PairFunction | None = None
    checker: A.PairFunction | None = None
    # Characters of a document that a model takes, and sources that the checker takes; all of them by default.
    grader_chars: int | None = None
    scorer_chars: int | None = None
    generator_chars: int | None = None
    checker_chars: int | None = None
    checker_docs: int | None = None


def ask(collection: DataFrame, questions: DataFrame, k: int, models: Models = Models(),
        where: Column | None = None, small_hits: int = SMALL_HITS) -> DataFrame:
    """Hits for ``(query_id, question)`` against a collection with embeddings."""
    embedded = questions.withColumn("embedding", models.embed(F.col("question")))
    return search(collection, embedded, k, where=where, broadcast_rows=small_hits)


def rewrite_rarest(questions: DataFrame, collection: DataFrame, terms: int = REWRITE_TERMS,
                   frequencies: DataFrame | None = None, small_terms: int = SMALL_TERMS) -> DataFrame:
    """Questions cut down to their rarest terms in the collection, rarest first.

    With ``frequencies`` (``term, df``), such as a kept term index gives, no text of the collection is read.
    """
    asked = questions.select("query_id", F.explode(X.terms(F.col("question"))).alias("term"))
    wanted = materialise(asked.select("term").distinct(), "terms")
    if fits_broadcast(wanted, small_terms):
        wanted = F.broadcast(wanted)
    if frequencies is None:
        frequency = (collection.select(F.explode(X.terms(F.col("text"))).alias("term"))
                     .join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")))
    else:
        frequency = frequencies.join(wanted, "term", "left_semi")
    rare = top_per_group(skewed_join(asked, frequency, ["term"]), ["query_id"], ["df", "term"], terms, rank="place")
    words = F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda e: e["term"])
    new = rare.groupBy("query_id").agg(F.array_join(words, " ").alias("new_question"))
    return questions.join(new, "query_id", "left").select(
        "query_id", F.coalesce("new_question", "question").alias("question"),
        F.col("new_question").isNotNull().alias("rewritten"))


def retrieve(collection: DataFrame, questions: DataFrame, k: int, models: Models = Models(),
             where: Column | None = None, enrich: bool = False, small_hits: int = SMALL_HITS) -> DataFrame:
    """Hits, with the first chunks of the records among them if asked for."""
    hits = ask(collection, questions, k, models, where, small_hits)
    if not enrich:
        return hits
    hits = materialise(hits, "found")
    added = enrich_first_chunk(hits, collection, HIT_COLUMNS, small=fits_broadcast(hits.drop("text"), small_hits))
    named = questions.select("query_id", F.col("question").alias("_q"))
    return (added.join(named, "query_id").withColumn("question", F.col("_q")).withColumn("rank", F.col("position"))
            .drop("_q", "position", "added"))


def retrieve_graded(collection: DataFrame, questions: DataFrame, k: int, threshold: float,
                    models: Models = Models(), where: Column | None = None, enrich: bool = False,
                    frequencies: DataFrame | None = None, small_hits: int = SMALL_HITS) -> DataFrame:
    """Hits worth answering from: the relevant ones, after one retry for questions without any.

    Chunks are added before grading, in the retry too. When the retry finds
    nothing relevant either, its ungraded hits stay. The retry's questions are cut down by ``frequencies`` of terms
    if given, else by those counted in the collection.
    """
    def graded(asked: DataFrame) -> DataFrame:
        return A.grade(retrieve(collection, asked, k, models, where, enrich, small_hits), threshold, models.grader, models.grader_chars)

    first = materialise(graded(questions), "graded")
    good = first.where("relevant")
    failing = questions.join(good.select("query_id").distinct(), "query_id", "left_anti")
    changed = materialise(rewrite_rarest(failing, collection, frequencies=frequencies), "rewritten")
    second = materialise(graded(changed).join(changed.select("query_id", "rewritten"), "query_id"), "regraded")
    found = second.where("relevant").select("query_id").distinct().withColumn("_found", F.lit(True))
    kept = second.join(found, "query_id", "left").where(F.col("relevant") | F.col("_found").isNull()).drop("_found")
    return good.withColumn("rewritten", F.lit(False)).unionByName(kept)


def answer_questions(collection: DataFrame, questions: DataFrame, k: int = DEFAULT_TOP_K, *,
                     grading: bool = False, threshold: float = 0.5, reranking: bool = True,
                     enrich: bool = True, paths: DataFrame | None = None, models: Models = Models(),
                     where: Column | None = None, frequencies: DataFrame | None = None,
                     small_hits: int = SMALL_HITS) -> DataFrame:
    """One row per question with answer, flags and sources."""
    if grading:
        hits = retrieve_graded(collection, questions, k, threshold, models, where, enrich, frequencies, small_hits)
    else:
        hits = retrieve(collection, questions, k, models, where, enrich, small_hits).withColumn("rewritten", F.lit(False))
    hits = A.rerank(hits, scorer=models.scorer, chars=models.scorer_chars) if reranking else hits.withColumn("rerank_score", F.lit(None).cast("double"))
    hits = materialise(hits, "hits")
    asked = hits.select("query_id", "question").distinct()

    def write() -> DataFrame:
        if models.generator:
            return A.generate(asked, A.context_block(hits, models.generator_chars), models.generator)
        return A.extractive_answer(hits, models.generator_chars)

    checked = materialise(A.groundedness(
        write(), hits, threshold, models.checker, models.checker_chars, models.checker_docs), "answers")
    if models.generator:
        # One regeneration for answers the check did not accept; it is not checked again.
        again = asked.join(checked.where("NOT grounded").select("query_id"), "query_id", "left_semi")
        new = A.generate(again, A.context_block(hits, models.generator_chars), models.generator).withColumnRenamed("answer", "_new")
        checked = (checked.join(new, "query_id", "left").withColumn("answer", F.coalesce("_new", "answer")).drop("_new"))
    flags = hits.groupBy("query_id").agg(F.bool_or("rewritten").alias("rewritten"), F.count("*").alias("n_sources"),
                                         F.max("question").alias("final_question"))
    rows = A.with_fixed_answers(questions, checked, hits)
    return (rows.join(flags, "query_id", "left").join(A.source_list(hits, paths), "query_id", "left")
            .withColumn("rewritten", F.coalesce("rewritten", F.lit(False)))
            .withColumn("n_sources", F.coalesce("n_sources", F.lit(0))))
