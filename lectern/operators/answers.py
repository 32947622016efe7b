"""From hits to cited answers. One row per (question, hit), bounded by k per question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions import text as X

# The length of a snippet, and the fixed answers.
SNIPPET_CHARS = 400
SENTENCE = r"[^\n]+?(?:[.!?]+[ \t]+|\n|\z)"
PART_SEPARATOR = "\n\n---\n\n"
NO_HITS = "No relevant documents found for your query."
NO_MODEL = ("The LLM service is currently unavailable. "
            "Below are the most relevant documents found for your query.")
EMPTY_ANSWER = "LLM returned an empty response."
FAILED_ANSWER = "Failed to generate an answer. Please review the source documents directly."

PairFunction = Callable[[Column, Column], Column]


def head(text: Column, chars: int | None) -> Column:
    """The whole text, or its first ``chars`` characters for a model that takes no more."""
    return text if chars is None else F.substring(text, 1, chars)


def coverage(question: Column, text: Column) -> Column:
    """Share of the distinct question terms that occur in the text."""
    def share(asked: Column) -> Column:
        found = F.size(F.array_intersect(asked, X.tokens(text)))
        return F.when(F.size(asked) > 0, found / F.size(asked)).otherwise(0.0)

    return X.let(X.terms(question), share)


def grade(hits: DataFrame, threshold: float = 0.5, grader: PairFunction | None = None,
          chars: int | None = None) -> DataFrame:
    """Adds ``relevant``. A grader that fails (NULL) keeps the document."""
    text = head(F.col("text"), chars)
    verdict = grader(F.col("question"), text) if grader else coverage(F.col("question"), text) >= threshold
    return hits.withColumn("relevant", F.coalesce(verdict, F.lit(True)))


def pair_score(hits: DataFrame, scorer: PairFunction | None = None, chars: int | None = None) -> DataFrame:
    """Adds ``rerank_score``. A scorer that fails (NULL) falls back to ten times the search score."""
    score = (scorer or coverage)(F.col("question"), head(F.col("text"), chars))
    return hits.withColumn("rerank_score", F.round(F.coalesce(score, F.col("score") * 10), 4))


def rank_hits(hits: DataFrame, score: str = "score", then: str = "doc_id") -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(score), then)
    return hits.withColumn("rank", F.row_number().over(order))


def rerank(hits: DataFrame, top_n: int | None = None, scorer: PairFunction | None = None,
           chars: int | None = None) -> DataFrame:
    """New order by ``rerank_score``; equal scores keep their old order."""
    scored = pair_score(hits, scorer, chars).withColumnRenamed("rank", "old_rank")
    ranked = rank_hits(scored, "rerank_score", "old_rank")
    return ranked if top_n is None else ranked.where(F.col("rank") <= top_n)


def context_part(chars: int | None = None) -> Column:
    header = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col("doc_label"), F.lit(" ("), F.col("source_db"),
                      F.lit("."), F.col("source_table"), F.lit(")"))
    return F.concat(header, F.lit("\n"), head(F.col("text"), chars))


def _in_rank_order(part: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))), lambda e: e["part"])


def context_block(hits: DataFrame, chars: int | None = None) -> DataFrame:
    """One text per question: its hits in rank order under numbered headers."""
    joined = F.array_join(_in_rank_order(context_part(chars)), PART_SEPARATOR)
    return hits.groupBy("query_id").agg(joined.alias("context"), F.count("*").alias("n_docs"))


def best_sentence(question: Column, text: Column) -> Column:
    """The sentence that covers most question terms, the first of them on a tie."""
    def pick(asked: Column) -> Column:
        sentences = F.filter(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.length(X.strip(s)) > 0)
        scored = F.transform(sentences, lambda s, i: F.struct(
            F.size(F.array_intersect(asked, X.tokens(s))).alias("found"), (-i).alias("place"), X.strip(s).alias("s")))
        return F.array_max(scored)["s"]

    return X.let(X.terms(question), pick)


def extractive_answer(hits: DataFrame, chars: int | None = None) -> DataFrame:
    """Default generator: the best sentence of every source with its number."""
    sentence = best_sentence(F.col("question"), head(F.col("text"), chars))
    cited = hits.withColumn("cited", F.concat(sentence, F.lit(" ["), F.col("rank"), F.lit("]")))
    return cited.groupBy("query_id").agg(F.array_join(_in_rank_order(F.col("cited")), " ").alias("answer"))


def generate(questions: DataFrame, contexts: DataFrame, generator: PairFunction) -> DataFrame:
    """Answer of a model over the context block; fixed texts for empty and failed answers."""
    asked = questions.select("query_id", "question").join(contexts, "query_id")
    raw = generator(F.col("question"), F.col("context"))
    answer = F.when(raw.isNull(), FAILED_ANSWER).when(raw == "", EMPTY_ANSWER).otherwise(raw)
    return asked.select("query_id", answer.alias("answer"))


def groundedness(answers: DataFrame, hits: DataFrame, threshold: float = 0.5,
                 checker: PairFunction | None = None, chars: int | None = None, docs: int | None = None) -> DataFrame:
    """Share of answer terms found in the sources, and whether that is enough.

    A checker that takes no more can be given the heads (``chars``) of the first ``docs`` sources.
    """
    used = hits if docs is None else hits.where(F.col("rank") <= docs)
    sources = used.groupBy("query_id").agg(
        F.array_join(_in_rank_order(head(F.col("text"), chars)), "\n\n").alias("sources"))
    both = answers.join(sources, "query_id", "left")
    if checker:
        return both.withColumn("grounded", F.coalesce(checker(F.col("answer"), F.col("sources")), F.lit(True))).drop("sources")
    share = coverage(F.col("answer"), F.coalesce("sources", F.lit("")))
    return (both.withColumn("groundedness", F.round(share, 4)).drop("sources")
            .withColumn("grounded", F.col("groundedness") >= threshold))


def source_list(hits: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Sources per question: rank, scores, snippet and, where a file is known, its link."""
    rows = hits if paths is None else hits.join(paths.select("doc_id", "file_path").distinct(), "doc_id", "left")
    path = F.lit(None).cast("string") if paths is None else F.col("file_path")
    link = F.when(path.isNotNull(), F.concat(F.lit("/files/"), "doc_id"))
    entry = F.struct("rank", "doc_id", "score", F.col("doc_label").alias("label"), "source_db", "source_table",
                     F.substring("text", 1, SNIPPET_CHARS).alias("snippet"), "rerank_score", link.alias("file_link"))
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("sources"))


def with_fixed_answers(questions: DataFrame, answers: DataFrame, hit_ids: DataFrame) -> DataFrame:
    """Every question has a row: its answer, or a fixed text without hits or without a model."""
    found = hit_ids.select("query_id").distinct().withColumn("_hit", F.lit(True))
    rows = questions.join(found, "query_id", "left").join(answers, "query_id", "left")
    fixed = F.when(F.col("_hit").isNull(), NO_HITS).otherwise(F.coalesce("answer", F.lit(NO_MODEL)))
    return rows.withColumn("answer", fixed).withColumn("has_hits", F.col("_hit").isNotNull()).drop("_hit")
