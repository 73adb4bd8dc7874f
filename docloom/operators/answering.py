"""Answers to questions over the collection: scope, search or whole document, rerank, prompt, model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import prompts
from docloom.models import Encoder, LanguageModel, Reranker, asked
from docloom.operators import collection as C
from docloom.operators import retrieval as R
from docloom.runtime import written

NO_CONTEXT = "No context found"


def fragments(queries: DataFrame, stored: DataFrame, encoder: Encoder, *, reranker: Reranker | None = None, pool: int = 50, kept: int = 10,
              budget_tokens: int = 10_000, chars_per_token: float = 3.5, prefix: str = "zapytanie: ") -> DataFrame:
    """``(qid, rank, file_id, filename, parent_id, contents, full)`` of ``(qid, query, document_id)``.

    A question on one document gets its whole text where that fits the budget; every other one the best parents
    of a hybrid search, within its document (aliases stand for their originals) or in all of them. A question on
    an unknown document gets nothing.
    """
    scope = written(C.scope(stored))
    asked_for = written(queries.select("qid", "query", "document_id"))
    bound = asked_for.where("document_id is not null").select("qid", "document_id")
    # texts of the documents asked for only
    wanted = scope.join(bound.select(F.col("document_id").alias("file_id")).distinct(), "file_id", "left_semi")
    texts = C.texts_of(stored.join(wanted.select(F.col("canonical_file_id").alias("file_id")).distinct(), "file_id", "left_semi"))
    text = wanted.join(texts, "canonical_file_id").select(F.col("file_id").alias("document_id"), "text").where(R.route(F.length("text"), budget_tokens, chars_per_token) == "full").where("text <> ''")
    full = written(bound.join(text, "document_id").selectExpr("qid", "1 as rank", "document_id as file_id", "cast(null as string) as filename", "cast(null as bigint) as parent_id", "text as contents", "true as full"))
    search = R.query_vectors(R.scoped(asked_for.join(full.select("qid"), "qid", "left_anti"), scope), encoder, prefix)
    search = written(search.select("qid", "query", "scope", "v"))
    parents = R.parents_of(R.hybrid(stored, search, pool, width=encoder.width), stored)
    best = R.reranked(parents, search, kept, reranker).selectExpr("qid", "rank", "file_id", "filename", "parent_id", "contents", "false as full")
    return full.unionByName(best)


def prompted(queries: DataFrame, found: DataFrame, model_name: str = "") -> DataFrame:
    """``(qid, query, system)`` of the questions something was found for."""
    everywhere = found.join(queries.selectExpr("qid", "document_id is null as everywhere"), "qid")
    told = R.context(everywhere.withColumnRenamed("everywhere", "_e"), everywhere=F.col("_e"))
    return told.join(queries, "qid").select("qid", "query", prompts.rag_system(F.col("context"), F.col("document_id").isNull(), model_name).alias("system"))


def answer(queries: DataFrame, stored: DataFrame, encoder: Encoder, model: LanguageModel, *, model_name: str = "", **options) -> DataFrame:
    """``(qid, response, error, sources)`` of ``(qid, query, document_id)``: one row a question.

    ``sources`` are the fragments the answer was drawn from, best first. Without any the error says so.
    """
    found = written(fragments(queries, stored, encoder, **options))
    said = prompted(queries, found, model_name).withColumn("_a", asked(F.lit("OTHER"), F.col("query"), model, F.col("system"))).select("qid", "_a")
    sources = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "file_id", "filename", "parent_id", "contents"))).alias("sources"))
    rows = queries.select("qid").join(said, "qid", "left").join(sources, "qid", "left")
    return rows.select("qid", F.col("_a.text").alias("response"), F.coalesce(F.col("_a.error"), F.when(F.col("sources").isNull(), F.lit(NO_CONTEXT))).alias("error"), "sources")
