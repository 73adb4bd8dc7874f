"""Hybrid retrieval for sets of queries: sparse and dense legs, rank fusion, parents, rerank, context.

A stated set of queries meets all rows in blocks: a block of queries is held by every task, rows are
streamed past it once in Arrow batches, and a task answers with its own ``k`` best of each query. So
what is shuffled is at most ``k`` rows a query and task, however frequent a term is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import analysed
from docloom.models import Encoder, Reranker, encoded
from docloom.runtime import written

K1, B, RRF_K = 1.2, 0.75, 60
DIGITS = 6
#: Queries a block; rows scored at once, by the queries they meet.
QUERY_BLOCK, CELLS = 2000, 1 << 20
HITS = "qid long, id long, score double"


def ranked(scored: DataFrame, k: int, *, by: str = "qid", score: str = "score", key: str = "id") -> DataFrame:
    """The ``k`` best rows of each query with their rank; equal scores go by id."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Best:
    """The ``k`` best hits of each query of a block, as rows stream past."""

    def __init__(self, qids: np.ndarray, k: int):
        self.qids, self.k = qids, k
        self.least = np.full(len(qids), -np.inf)
        self.q, self.ids, self.scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        self.held = 0

    def offer(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        ok = scores >= self.least[q]
        self.q.append(q[ok]), self.ids.append(ids[ok]), self.scores.append(scores[ok])
        self.held += int(ok.sum())
        if self.held > 4 * self.k * len(self.qids) + 100_000:
            self._prune()

    def _prune(self) -> None:
        q, ids, scores = (np.concatenate(x) for x in (self.q, self.ids, self.scores))
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        last = rank == self.k - 1
        self.least[q[last]] = scores[last]
        keep = rank < self.k
        self.q, self.ids, self.scores = [q[keep]], [ids[keep]], [scores[keep]]
        self.held = int(keep.sum())

    def batch(self) -> pa.RecordBatch:
        self._prune()
        return pa.RecordBatch.from_arrays([pa.array(self.qids[self.q[0]]), pa.array(self.ids[0]), pa.array(self.scores[0])], names=["qid", "id", "score"])


def _blocks(queries: DataFrame) -> Iterator[pd.DataFrame]:
    """The stated queries, ``QUERY_BLOCK`` at a time."""
    rows = []
    for r in queries.toLocalIterator():
        rows.append(r)
        if len(rows) == QUERY_BLOCK:
            yield pd.DataFrame(rows, columns=queries.columns)
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=queries.columns)


def _scopes(block: pd.DataFrame) -> np.ndarray | None:
    """File each query is bound to, -1 for all files; ``None`` if no query is bound."""
    if "scope" not in block or block["scope"].isna().all():
        return None
    return block["scope"].fillna(-1).to_numpy(dtype=np.int64)


def _within(scope: np.ndarray, q: np.ndarray, files: np.ndarray) -> np.ndarray:
    return (scope[q] == -1) | (scope[q] == files)


def _streamed(rows: DataFrame, queries: DataFrame, k: int, prepare: Callable[[pd.DataFrame], Callable]) -> DataFrame:
    """Best ``k`` of each query: ``prepare`` makes of a block the function that scores one Arrow batch into a ``_Best``."""
    out = None
    for block in _blocks(queries):
        score = prepare(block)
        qids = block["qid"].to_numpy(dtype=np.int64)

        def run(batches: Iterator[pa.RecordBatch], score=score, qids=qids) -> Iterator[pa.RecordBatch]:
            best = _Best(qids, k)
            for batch in batches:
                if batch.num_rows:
                    score(batch, best)
            yield best.batch()

        part = rows.mapInArrow(run, HITS)
        out = part if out is None else out.unionByName(part)
    return rows.sparkSession.createDataFrame([], f"{HITS}, rank int") if out is None else ranked(out, k)


def postings(docs: DataFrame) -> DataFrame:
    """``(term, id, tf, len)`` of ``(id, text)``: one row a term and document, as a stored sparse index keeps them."""
    words = docs.select("id", analysed(F.col("text")).alias("_w"))
    return words.select("id", F.size("_w").alias("len"), F.explode("_w").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf")).select("term", "id", "tf", "len")


def bm25(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(qid, id, score, rank)`` for queries ``(qid, query)`` over documents ``(id, text)``.

    With a column ``scope`` in both, a query only meets documents of its own scope (null: all). Statistics
    are over all documents, as of one index.
    """
    words = docs.select("id", *[c for c in ("scope",) if c in docs.columns], analysed(F.col("text")).alias("_w"))
    n, avg = words.agg(F.count("*"), F.avg(F.size("_w"))).first()
    asked = written(queries.select("qid", *[c for c in ("scope",) if c in queries.columns], F.array_distinct(analysed(F.col("query"))).alias("terms")))
    terms = written(asked.select(F.explode("terms").alias("term")).distinct())
    # documents a term of the queries occurs in: counted on the map side, one row a term after it
    frequency = written(words.select(F.explode(F.array_distinct("_w")).alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")))
    with_df = asked.select("*", F.posexplode_outer("terms").alias("_i", "term")).join(frequency, "term", "left").groupBy("qid", *[c for c in ("scope",) if c in asked.columns]).agg(
        F.collect_list(F.when(F.col("df") > 0, F.struct("term", "df"))).alias("terms"))

    def prepare(block: pd.DataFrame) -> Callable:
        df: dict[str, int] = {t["term"]: t["df"] for ts in block["terms"] for t in ts}
        vocabulary = sorted(df)
        place = {t: i for i, t in enumerate(vocabulary)}
        pairs = sorted((place[t["term"]], q) for q, ts in enumerate(block["terms"]) for t in ts)
        q_of = np.array([q for _, q in pairs], dtype=np.int64)
        first = np.searchsorted(np.array([p for p, _ in pairs], dtype=np.int64), np.arange(len(vocabulary) + 1))
        d = np.array([df[t] for t in vocabulary], dtype=float)
        idf = np.log(1 + (n - d + 0.5) / (d + 0.5))
        value_set, count, scope = pa.array(vocabulary, pa.string()), len(block), _scopes(block)

        def score(batch: pa.RecordBatch, best: _Best) -> None:
            lists = batch.column("_w")
            lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = pc.index_in(lists.flatten(), value_set=value_set)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            known = at.is_valid().to_numpy(zero_copy_only=False)
            key, tf = np.unique(doc[known] * max(1, len(vocabulary)) + at.drop_null().to_numpy(), return_counts=True)
            doc, term = key // max(1, len(vocabulary)), key % max(1, len(vocabulary))
            w = idf[term] * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * lengths[doc] / (avg or 1.0)))
            ids, files = batch.column("id").to_numpy(), batch.column("scope").to_numpy(zero_copy_only=False) if scope is not None else None
            step = max(1, CELLS // max(1, count))
            for lo in range(0, len(lengths), step):
                a, b = np.searchsorted(doc, [lo, lo + step])
                fan = first[term[a:b] + 1] - first[term[a:b]]
                total = int(fan.sum())
                if not total:
                    continue
                begin = np.repeat(first[term[a:b]] - np.cumsum(fan) + fan, fan) + np.arange(total)
                cell = np.repeat(doc[a:b] - lo, fan) * count + q_of[begin]
                sums = np.bincount(cell, weights=np.repeat(w[a:b], fan), minlength=1)
                hit = np.unique(cell)
                who, which = hit % count, hit // count + lo
                points = np.round(sums[hit], DIGITS)
                if scope is not None:
                    ok = _within(scope, who, files[which])
                    who, which, points = who[ok], which[ok], points[ok]
                best.offer(who, ids[which], points)

        return score

    return _streamed(words, with_df, k, prepare)


def dense(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(qid, id, score, rank)`` by exact inner product of ``(qid, v)`` with all ``(id, v)``; ``scope`` as in ``bm25``."""

    def prepare(block: pd.DataFrame) -> Callable:
        q = np.array(block["v"].tolist(), dtype=np.float64)
        scope = _scopes(block)

        def score(batch: pa.RecordBatch, best: _Best) -> None:
            ids = batch.column("id").to_numpy()
            x = np.asarray(batch.column("v").flatten(), dtype=np.float64).reshape(len(ids), -1)
            files = batch.column("scope").to_numpy(zero_copy_only=False) if scope is not None else None
            step = max(1, CELLS // len(q))
            for lo in range(0, len(ids), step):
                s = np.round(x[lo: lo + step] @ q.T, DIGITS)
                which, who = np.nonzero(s >= best.least)
                points = s[which, who]
                if scope is not None:
                    ok = _within(scope, who, files[which + lo])
                    which, who, points = which[ok], who[ok], points[ok]
                best.offer(who, ids[which + lo], points)

        return score

    columns = [c for c in ("scope",) if c in vectors.columns]
    return _streamed(vectors.select("id", "v", *columns), queries.select("qid", "v", *[c for c in ("scope",) if c in queries.columns]), k, prepare)


def usable_vectors(column: str, width: int) -> Column:
    v = F.col(column)
    return v.isNotNull() & (F.size(v) == width) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e)) & F.exists(v, lambda e: e != 0)


def fused(legs: list[DataFrame], k: int) -> DataFrame:
    """Reciprocal-rank fusion of ``(qid, id, rank)`` legs."""
    both = legs[0].select("qid", "id", "rank")
    for leg in legs[1:]:
        both = both.unionByName(leg.select("qid", "id", "rank"))
    return ranked(both.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score")), k)


def hybrid(collection: DataFrame, queries: DataFrame, k: int, *, width: int) -> DataFrame:
    """``(qid, id, score, rank)``: children found for ``(qid, query, v)`` by both legs, twice ``k`` each, fused.

    All searchable children with text are in the sparse leg, those with a usable vector in the dense one. A
    ``scope`` column binds a query to one (canonical) file.
    """
    children = collection.where("is_search and hierarchy = 'child'").withColumn("scope", F.col("file_id"))
    bound = [c for c in ("scope",) if c in queries.columns]
    vectors = dense(children.where(usable_vectors("dense_embedding", width)).select("id", F.col("dense_embedding").alias("v"), "scope"), queries.where(usable_vectors("v", width)).select("qid", "v", *bound), 2 * k)
    words = bm25(children.where("contents is not null").select("id", F.col("contents").alias("text"), "scope"), queries.select("qid", "query", *bound), 2 * k)
    return fused([vectors, words], k)


def scoped(queries: DataFrame, scope: DataFrame) -> DataFrame:
    """Queries ``(qid, query, document_id)`` with the canonical file as ``scope``; those on unknown documents are left out."""
    bound = queries.join(scope.withColumnsRenamed({"file_id": "document_id", "canonical_file_id": "scope"}), "document_id", "left")
    return bound.where("document_id is null or scope is not null")


def query_vectors(queries: DataFrame, encoder: Encoder, prefix: str = "zapytanie: ") -> DataFrame:
    """Queries with ``v``: the encoder sees them behind the prefix, the sparse leg takes them as they are."""
    return queries.withColumn("v", encoded(F.col("query"), encoder, prefix))


def parents_of(hits: DataFrame, collection: DataFrame) -> DataFrame:
    """``(qid, parent_id, file_id, type, filename, contents)`` of the distinct parents of child hits."""
    children = collection.select("id", "parent_id")
    asked = hits.join(children, "id").where("parent_id is not null").select("qid", "parent_id").distinct()
    rows = collection.where("is_search and hierarchy = 'parent'").select("parent_id", "file_id", "type", "filename", "contents")
    return asked.join(rows, "parent_id").select("qid", "parent_id", "file_id", "type", "filename", "contents")


def lexical_overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text has: the stand-in reranker's score."""
    words = F.array_distinct(analysed(query))
    return F.when(F.size(words) > 0, F.round(F.size(F.array_intersect(words, analysed(text))) / F.size(words), DIGITS)).otherwise(F.lit(0.0))


def reranked(fragments: DataFrame, queries: DataFrame, k: int, reranker: Reranker | None = None) -> DataFrame:
    """The ``k`` best fragments of each query by a reranker, or by shared words where there is none."""
    rows = fragments.join(queries.select("qid", "query"), "qid").withColumn("contents", F.coalesce("contents", F.lit("")))
    if reranker is None:
        score = lexical_overlap(F.col("query"), F.col("contents"))
    else:
        @F.pandas_udf("double")
        def predict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for q, t in batches:
                yield pd.Series(reranker.score(list(zip(q, t))), dtype="float64")

        score = predict("query", "contents")
    return ranked(rows.withColumn("score", score), k, key="parent_id")


def context(fragments: DataFrame, *, everywhere: Column | bool) -> DataFrame:
    """``(qid, context)``: fragments in rank order under their headers; by document name where the search went ``everywhere``."""
    name = F.concat(F.lit("--- Fragment z dokumentu: "), F.coalesce(F.when(F.col("filename") != "", F.col("filename")), F.concat(F.lit("ID "), F.col("file_id").cast("string"))), F.lit(" ---\n"))
    number = F.concat(F.lit("--- Fragment "), F.col("rank").cast("string"), F.lit(" ---\n"))
    head = F.when(everywhere if isinstance(everywhere, Column) else F.lit(everywhere), name).otherwise(number)
    part = fragments.select("qid", "rank", F.concat(head, F.coalesce("contents", F.lit("")), F.lit("\n\n")).alias("part"))
    # at most as many fragments a query as the rerank kept
    return part.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"]), "").alias("context"))


def route(chars: Column, budget_tokens: int, chars_per_token: float = 3.5) -> Column:
    """``full`` where a document fits the context budget, else ``retrieval``."""
    return F.when(chars <= budget_tokens * chars_per_token, F.lit("full")).otherwise(F.lit("retrieval"))
