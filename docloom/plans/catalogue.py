"""Registered queries over the project's tables and their ANSI-SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import json_output as J
from docloom.functions import text as X
from docloom import prompts
from docloom.models import FirstChoice, HashedEncoder, RecordedModel
from docloom.operators import answering, chunking, collection, ingest, retrieval, tables, tasks
from docloom.runtime import table, written
from docloom.sources import uploads as U
from docloom.streaming.arrivals import event_counts

Query = Callable[[SparkSession, str], DataFrame]

#: White space of Unicode for engines whose ``\s`` is ASCII.
WS = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NWS = WS.replace("[", "[^", 1)


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null")


def _text_parents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("is_search and hierarchy = 'parent' and type = 'text' and contents is not null")


# --- text -----------------------------------------------------------------------

def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


def upload_hash(spark: SparkSession, d: str) -> DataFrame:
    """Uploads whose stated hash is not that of their bytes."""
    rows = table(spark, d, "documents_in").select("seq", F.coalesce("content_hash", F.lit("")).alias("stated"), X.content_hash(F.col("content")).alias("actual"))
    return rows.where("stated <> actual")


def page_text(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents_in").select("seq", U.page_text(F.col("pages")).alias("page_text"), tasks.summary_text(F.col("pages")).alias("summary_text"))
    return rows.select("seq", F.length("page_text").alias("chars"), F.md5("page_text").alias("page_md5"), F.md5("summary_text").alias("summary_md5"))


def mime_filter(spark: SparkSession, d: str) -> DataFrame:
    taken, other = U.admitted(table(spark, d, "documents_in"))
    both = taken.withColumn("admitted", F.lit(True)).unionByName(other.withColumn("admitted", F.lit(False)))
    return both.groupBy("content_type", "admitted").agg(F.count("*").alias("n"))


def preview(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.preview(F.col("text"), 2000).alias("preview"))


def strip_markdown(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(X.without_markdown(F.col("text"))).alias("plain_md5"))


def token_route(spark: SparkSession, d: str) -> DataFrame:
    n = X.token_estimate(F.col("text"))
    return _docs(spark, d).select("doc_id", n.alias("tokens"), F.when(n <= 3000, F.lit("single")).otherwise(F.lit("map_reduce")).alias("route"))


def context_route(spark: SparkSession, d: str) -> DataFrame:
    text = collection.document_text(table(spark, d, "chunks"))
    return text.select("file_id", F.length("text").alias("chars"), retrieval.route(F.length("text"), 500).alias("route"))


# --- chunking -------------------------------------------------------------------

def hard_split(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(chunking.windows(F.col("text"), 1500, 200)).alias("pos", "piece"))


def overlap_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The parents of each file in order, each led by the end of the one before it."""
    files = _text_parents(spark, d).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("parent_id", "id", "contents"))).alias("p"))
    led = files.select(F.explode(F.arrays_zip(F.transform("p", lambda x: x["id"]).alias("id"), chunking.overlapped(F.transform("p", lambda x: x["contents"]), 150).alias("chunk"))).alias("x"))
    return led.select("x.id", "x.chunk")


def sentences(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(chunking.sentence_array(F.col("text"))).alias("pos", "sentence"))


def parent_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(chunking.parent_chunks(F.col("text"))).alias("pos", "chunk"))


def child_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _text_parents(spark, d).select("id", F.posexplode(chunking.child_chunks(F.col("contents"))).alias("pos", "chunk"))


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.text_rows(_docs(spark, d).select(F.col("doc_id").alias("file_id"), "text"))
    return rows.select("file_id", chunking.composed_id(F.col("file_id"), F.col("local")).alias("parent_id"), "child_ord", "child")


def table_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents_in").select(F.col("seq").alias("file_id"), "tables").where("tables is not null")
    return tables.chunks(rows).withColumnRenamed("file_id", "seq")


# --- collection -----------------------------------------------------------------

def _incoming(spark: SparkSession, d: str) -> DataFrame:
    return collection.incoming_of(table(spark, d, "documents_in"))


def dedup_cascade(spark: SparkSession, d: str) -> DataFrame:
    rows = collection.cascade(_incoming(spark, d), table(spark, d, "chunks"))
    return rows.withColumn("canonical_file_id", F.coalesce("canonical_file_id", F.lit(-1)))


def alias_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = collection.alias_rows(dedup_cascade(spark, d), _incoming(spark, d), 64)
    return rows.withColumn("width", F.size("dense_embedding")).drop("dense_embedding")


def resolve_scope(spark: SparkSession, d: str) -> DataFrame:
    return collection.scope(table(spark, d, "chunks"))


def document_text(spark: SparkSession, d: str) -> DataFrame:
    return collection.document_text(table(spark, d, "chunks"))


def collection_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").groupBy("hierarchy", "type", "is_search").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("files"), F.sum(F.length("contents")).alias("chars"))


def ingest_rows(spark: SparkSession, d: str) -> DataFrame:
    """What the uploads add to the collection: cut, keyed, embedded, with alias rows."""
    return ingest.ingested(table(spark, d, "documents_in"), table(spark, d, "chunks"), HashedEncoder())


# --- retrieval ------------------------------------------------------------------

def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """For every vector whose id is divisible by 100, the ten best of all vectors."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieval.dense(v, v.where("id % 100 = 0").withColumnRenamed("id", "qid"), 10)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, d, "bench_items").where("text is not null").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return retrieval.bm25(docs, asked, 10)


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Searchable children with text and a usable vector whose id is divisible by 100, as queries."""
    rows = table(spark, d, "chunks").where("is_search and hierarchy = 'child' and contents is not null and id % 100 = 0").where(retrieval.usable_vectors("dense_embedding", 64))
    return rows.select(F.col("id").alias("qid"), F.col("contents").alias("query"), F.col("dense_embedding").alias("v"))


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid(table(spark, d, "chunks"), _asked(spark, d), 50, width=64)


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """For every usable child whose id is divisible by 100, its hybrid hits: all children with text, those with a vector in the dense leg."""
    return _hybrid(spark, d)


def parent_lookup(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.parents_of(_hybrid(spark, d), table(spark, d, "chunks")).select("qid", "parent_id", "file_id", "type")


def _reranked(spark: SparkSession, d: str) -> DataFrame:
    parents = retrieval.parents_of(_hybrid(spark, d), table(spark, d, "chunks"))
    return retrieval.reranked(parents, _asked(spark, d), 10)


def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d).select("qid", "parent_id", "score", "rank")


def rag_context(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.context(_reranked(spark, d), everywhere=True).select("qid", F.length("context").alias("chars"), F.md5("context").alias("context_md5"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions on single documents: the children whose id is divisible by 100, each bound to its own file."""
    rows = table(spark, d, "chunks").where("is_search and hierarchy = 'child' and contents is not null and id % 100 = 0")
    return rows.select(F.col("id").alias("qid"), F.substring("contents", 1, 200).alias("query"), F.col("file_id").alias("document_id"))


def scoped_topk(spark: SparkSession, d: str) -> DataFrame:
    """The sparse leg within each question's own document, aliases resolved."""
    chunks = table(spark, d, "chunks")
    docs = chunks.where("is_search and hierarchy = 'child' and contents is not null").select("id", F.col("contents").alias("text"), F.col("file_id").alias("scope"))
    return retrieval.bm25(docs, retrieval.scoped(_questions(spark, d), collection.scope(chunks)), 10)


def rag_prompt(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of the questions whose document fits the budget whole."""
    found = answering.fragments(_questions(spark, d), table(spark, d, "chunks"), HashedEncoder(), budget_tokens=500)
    told = answering.prompted(_questions(spark, d), written(found).where("full"))
    return told.select("qid", F.length("system").alias("chars"), F.md5("system").alias("system_md5"))


def rag_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a stand-in model, by whole document or by search, and how many sources each has."""
    rows = answering.answer(_questions(spark, d), table(spark, d, "chunks"), HashedEncoder(), RecordedModel(), budget_tokens=500)
    return rows.select("qid", "response", "error", F.size("sources").alias("sources"))


# --- answers and tasks -------------------------------------------------------------

def parse_json(spark: SparkSession, d: str) -> DataFrame:
    v = J.recovered(F.col("raw"))
    return table(spark, d, "raw_answers").select("doc_id", "attempt", "task_type", v.isNotNull().alias("parsed"), J.text_field(v, "category").alias("category"), J.text_field(v, "subcategory").alias("subcategory"))


def _names(spark: SparkSession, d: str) -> Column:
    listed = table(spark, d, "taxonomy").where("subcategory is null").agg(F.array_sort(F.collect_list("category")).alias("names"))
    return listed.scalar()


def coerce_category(spark: SparkSession, d: str) -> DataFrame:
    """Category answers coerced to the closed vocabulary by edit similarity alone."""
    rows = table(spark, d, "structured_output").select("answer_id", "category", _names(spark, d).alias("_v"))
    values = X.with_coerced(rows.select("category", "_v").where("category is not null").distinct(), "coerced", "category", "_v").select("category", "coerced")
    return rows.select("answer_id", "category").join(values, "category", "left").select("answer_id", "coerced")


def _categories(spark: SparkSession, d: str) -> Column:
    entries = table(spark, d, "taxonomy").groupBy("category").agg(F.array_sort(F.collect_list("subcategory")).alias("subs"))
    return entries.agg(F.array_sort(F.collect_list(F.struct(F.col("category").alias("name"), "subs"))).alias("c")).scalar()


def resolve_category(spark: SparkSession, d: str) -> DataFrame:
    """Recorded answers resolved to category and subcategory, later attempts repairing earlier ones."""
    rows = table(spark, d, "raw_answers").withColumn("_cats", _categories(spark, d))
    return tasks.recorded_categories(rows, "_cats")


def confidential_report(spark: SparkSession, d: str) -> DataFrame:
    """Reports with their kinds coerced; an unknown kind voids the report."""
    known = F.array(*[F.lit(t) for t in J.CONFIDENTIAL_LABELS])
    rows = table(spark, d, "confidential_reports").select("document_id", "task_id", "contains_sensitive", F.transform(F.coalesce("types", F.array().cast("array<string>")), lambda t: X.coerced(t, known)).alias("t"))
    ok = F.col("contains_sensitive").isNotNull() & ~F.exists("t", lambda t: t.isNull())
    return rows.select("document_id", "task_id", F.when(ok, J.rendered_confidential(F.col("contains_sensitive"), F.col("t"))).otherwise(F.lit(J.MANUAL_REVIEW)).alias("report"))


def category_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "taxonomy").groupBy("category").agg(F.array_sort(F.collect_list("subcategory")).alias("subs"))
    return rows.select("category", prompts.category_listing(F.array(F.struct(F.col("category").alias("name"), "subs"))).alias("line"))


def department_listing(spark: SparkSession, d: str) -> DataFrame:
    """Departments of each request, with their descriptions where given."""
    rows = tasks.with_params(table(spark, d, "task_requests").where("task_type = 'DEPARTMENT_ASSIGNMENT'"))
    return rows.select("task_id", F.unix_micros("requested_at").alias("at_us"), prompts.department_listing(F.col("departments")).alias("listing"), J.department_schema_of(F.transform("departments", lambda x: x["name"])).alias("schema"))


def resolve_confidential(spark: SparkSession, d: str) -> DataFrame:
    """Recorded confidentiality answers, resolved from their raw JSON and rendered."""
    rows = J.with_confidential(table(spark, d, "raw_answers").where("task_type = 'CHECK_CONFIDENTIAL'"), "raw")
    return rows.select("doc_id", "attempt", F.coalesce(J.rendered_confidential(F.col("contains_sensitive"), F.col("types")), F.lit(J.MANUAL_REVIEW)).alias("report"))


def task_params(spark: SparkSession, d: str) -> DataFrame:
    """Parameters of task requests, flattened."""
    rows = tasks.with_params(table(spark, d, "task_requests"))
    return rows.select("task_id", F.unix_micros("requested_at").alias("at_us"), "task_type", F.size("categories").alias("categories"), F.size("departments").alias("departments"), "query")


def latest_requests(spark: SparkSession, d: str) -> DataFrame:
    """One row a task: the request that came last, however late it was written."""
    last = Window.partitionBy("task_id").orderBy(F.col("requested_at").desc(), "document_id", "task_type")
    return table(spark, d, "task_requests").withColumn("rn", F.row_number().over(last)).where("rn = 1").select("task_id", "document_id", "task_type", F.unix_micros("requested_at").alias("at_us"))


def summaries(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of the uploads, from their stripped pages."""
    docs = table(spark, d, "documents_in").select(F.col("seq").alias("file_id"), X.strip(tasks.summary_text(F.col("pages"))).alias("text"))
    return tasks.summaries(docs, RecordedModel())


def _dispatched(spark: SparkSession, d: str) -> DataFrame:
    said = tasks.summaries(collection.document_text(table(spark, d, "chunks")), RecordedModel())
    return tasks.dispatch(table(spark, d, "task_requests"), written(said), FirstChoice())


def task_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return _dispatched(spark, d)


def structured_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies of a model that takes the first choice it is offered: shape of the payloads of structured tasks."""
    rows = _dispatched(spark, d).where(F.col("task_type").isin(*tasks.STRUCTURED))
    field = lambda path: F.get_json_object("payload", f"$.{path}")
    return rows.select("document_id", "task_id", "task_type", "ok", field("results.CATEGORY_SUBCATEGORY.CATEGORY").alias("category"), field("results.CATEGORY_SUBCATEGORY.SUBCATEGORY").alias("subcategory"),
                       field("results.DEPARTMENT_ASSIGNMENT").alias("department"), field("results.BASE_EXTRACTION").alias("extraction"), field("results.CHECK_CONFIDENTIAL").alias("confidential"), field("error").alias("error"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = event_counts(table(spark, d, "events").select("ts", "event_type", "value"))
    return rows.select(F.unix_micros(F.col("window_start").cast("timestamp")).alias("start_us"), "event_type", "n", F.round("total", 2).alias("total"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    content_hash, upload_hash, page_text, mime_filter, preview, strip_markdown, token_route, context_route, hard_split, overlap_chunks, sentences, parent_chunks, child_chunks,
    chunk_rows, table_chunks, dedup_cascade, alias_rows, resolve_scope, document_text, collection_counts, ingest_rows, dense_topk, bm25_topk, hybrid_topk, parent_lookup,
    rerank_topk, rag_context, scoped_topk, rag_prompt, rag_answers, department_listing, resolve_confidential, structured_replies, parse_json, coerce_category, resolve_category, confidential_report, category_listing, task_params, latest_requests, summaries, task_dispatch, event_windows)}


# --- the same in SQL ----------------------------------------------------------------

_BM25 = """
    words AS (SELECT id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM corpus),
    stats AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM words),
    asked_terms AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+')) AS term FROM asked),
    tf AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM words) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    sparse AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
        SELECT qid, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 6) AS score
        FROM asked_terms JOIN tf USING (term) JOIN df USING (term), stats GROUP BY qid, id))"""

_HYBRID = f"""
    searchable AS (SELECT * FROM chunks WHERE is_search AND hierarchy = 'child'),
    children AS (SELECT * FROM searchable WHERE len(dense_embedding) = 64
        AND NOT list_bool_or(list_transform(dense_embedding, lambda e: isnan(e))) AND list_bool_or(list_transform(dense_embedding, lambda e: e <> 0))),
    corpus AS (SELECT id, contents AS text FROM searchable WHERE contents IS NOT NULL),
    asked AS (SELECT id AS qid, contents AS query, dense_embedding AS v FROM children WHERE id % 100 = 0 AND contents IS NOT NULL),
    {_BM25},
    dense AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
        SELECT qid, c.id, round(list_inner_product(v::DOUBLE[], c.dense_embedding::DOUBLE[]), 6) AS score FROM asked, children c)),
    legs AS (SELECT qid, id, rank FROM dense WHERE rank <= 100 UNION ALL SELECT qid, id, rank FROM sparse WHERE rank <= 100),
    fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
        SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM legs GROUP BY qid, id)) WHERE rank <= 50)"""

_PARENTS = f"""{_HYBRID},
    hit_parents AS (SELECT DISTINCT qid, parent_id FROM fused JOIN chunks USING (id) WHERE parent_id IS NOT NULL),
    fragments AS (SELECT qid, p.* FROM hit_parents JOIN chunks p USING (parent_id) WHERE p.is_search AND p.hierarchy = 'parent'),
    reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, parent_id) AS rank FROM (
        SELECT f.qid, f.parent_id, f.file_id, f.filename, f.contents, CASE WHEN len(q) > 0 THEN round(len(list_filter(q, lambda t: list_contains(w, t)))::DOUBLE / len(q), 6) ELSE 0.0 END AS score
        FROM (SELECT fragments.*, list_distinct(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) AS q, regexp_extract_all(lower(coalesce(contents, '')), '[\\p{{L}}\\p{{N}}]+') AS w
              FROM fragments JOIN asked USING (qid)) f)) WHERE rank <= 10)"""

_SCOPE = """
    files AS (SELECT file_id, max(is_search::INT) AS searchable, max(content_hash) AS content_hash FROM chunks GROUP BY file_id),
    targets AS (SELECT content_hash, min(file_id) AS canonical_file_id FROM files WHERE searchable = 1 AND content_hash <> '' GROUP BY content_hash),
    scope AS (SELECT file_id, file_id AS canonical_file_id FROM files WHERE searchable = 1
              UNION ALL SELECT f.file_id, t.canonical_file_id FROM files f JOIN targets t USING (content_hash) WHERE f.searchable = 0 AND f.content_hash <> '')"""

_DOCUMENT_TEXT = f"""{_SCOPE},
    whole AS (SELECT file_id AS canonical_file_id, string_agg(coalesce(contents, ''), chr(10) ORDER BY parent_id, id) AS text FROM chunks
              WHERE is_search AND hierarchy = 'parent' AND type = 'text' GROUP BY file_id),
    document_texts AS (SELECT scope.file_id, text FROM scope JOIN whole USING (canonical_file_id))"""

_CASCADE = f"""
    incoming AS (SELECT seq, file_id, filename, coalesce(sha256(content), '') AS content_hash,
        coalesce(list_bool_or(list_transform(pages, lambda p: p IS NOT NULL AND regexp_matches(p, '{NWS}'))), false)
        OR coalesce(list_bool_or(list_transform(tables, lambda t: len(t.data) > 1)), false) AS has_rows FROM documents_in),
    turns AS (SELECT *, row_number() OVER (PARTITION BY file_id, has_rows ORDER BY seq) AS turn, file_id IN (SELECT file_id FROM chunks) AS stored FROM incoming),
    canonical AS (SELECT lower(content_hash) AS content_hash, min(file_id) AS canonical FROM chunks WHERE is_search AND content_hash <> '' GROUP BY lower(content_hash)),
    fresh AS (SELECT t.*, c.canonical, row_number() OVER (PARTITION BY t.content_hash ORDER BY seq) AS rn, first_value(file_id) OVER (PARTITION BY t.content_hash ORDER BY seq) AS first_file
              FROM turns t LEFT JOIN canonical c ON t.content_hash = c.content_hash WHERE has_rows AND turn = 1 AND NOT stored),
    decided AS (SELECT t.seq, t.file_id,
        CASE WHEN NOT t.has_rows THEN 'empty' WHEN f.seq IS NULL THEN 'skip' WHEN f.content_hash = '' THEN 'full' WHEN f.canonical IS NOT NULL OR f.rn > 1 THEN 'alias' ELSE 'full' END AS action,
        CASE WHEN f.seq IS NULL THEN NULL WHEN f.content_hash = '' THEN f.file_id WHEN f.canonical IS NOT NULL THEN f.canonical ELSE f.first_file END AS canonical_file_id
        FROM turns t LEFT JOIN fresh f ON t.seq = f.seq)"""

_PLAIN = "regexp_replace(translate({}, 'ąćęłńóśźż', 'ACELNOSZQ'), '[^\\x00-\\x7F]', '~', 'g')"  # one byte a character, so that edits count characters


def _squash(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '{WS}+', ' ', 'g'))"


def _similarity(a: str, b: str) -> str:
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END"


def _winner(scored: str, key: str, name: str) -> str:
    """The only entry within 0.02 of the best, if that reaches 0.8."""
    return (f"SELECT {key}, min({name}) AS coerced FROM (SELECT *, max(s) OVER (PARTITION BY {key}) AS b FROM {scored}) "
            f"WHERE s >= b - 0.02::DOUBLE AND b >= 0.8::DOUBLE GROUP BY {key} HAVING count(*) = 1")


def _cell(c: str) -> str:
    one_line = f"replace({c}, chr(10), ' ')"
    return f"coalesce({_strip(one_line)}, '')"


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _sentences(source: str, key: str, text: str, where: str) -> str:
    """The sentence split in SQL: fragments after marks and blank lines, joined while the one before goes on."""
    return f"""
        split_up AS (SELECT {key}, string_split(regexp_replace(regexp_replace({text}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), '\\n{{2,}}', chr(1), 'g'), chr(1)) AS parts FROM {source} WHERE {where}),
        placed AS (SELECT {key}, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM split_up),
        fragments AS (SELECT {key}, i, {_strip("part")} AS f FROM placed WHERE regexp_matches(part, '{NWS}')),
        tested AS (SELECT *, lower(rtrim(regexp_extract(f, '({NWS}+)$', 1), '.')) AS w FROM fragments),
        marked AS (SELECT *, CASE WHEN f LIKE '%.' AND (length(w) <= 1 OR regexp_full_match(w, '[0-9]+')
            OR regexp_replace(w, '[^a-ząćęłńóśźż0-9.]', '', 'g') IN ({', '.join(repr(a) for a in sorted(chunking.ABBREVIATIONS))})) THEN 0 ELSE 1 END AS ends FROM tested),
        grouped AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM marked),
        sentences AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY g) - 1 AS pos, sentence FROM (
            SELECT {key}, g, string_agg(f, ' ' ORDER BY i) AS sentence FROM grouped GROUP BY {key}, g))"""


_CLEAN = "regexp_replace(raw, '```(json)?', '', 'gi')"

ORACLE: dict[str, str] = {
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL",
    "upload_hash": "SELECT * FROM (SELECT seq, coalesce(content_hash, '') AS stated, sha256(content) AS actual FROM documents_in) WHERE stated <> actual",
    "page_text": f"""
        SELECT seq, length(t) AS chars, md5(t) AS page_md5, md5(s) AS summary_md5 FROM (
            SELECT seq, {_strip("array_to_string(pages, chr(10) || chr(10))")} AS t,
                   array_to_string(list_transform(list_filter(pages, lambda p: p IS NOT NULL), lambda p: {_strip("p")}), chr(10) || chr(10)) AS s FROM documents_in)""",
    "mime_filter": f"SELECT content_type, coalesce(content_type IN ({', '.join(repr(t) for t in U.CONTENT_TYPES)}), false) AS admitted, count(*) AS n FROM documents_in GROUP BY ALL",
    "preview": """SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text ELSE substr(text, 1, 2000) || '… [truncated ' || (length(text) - 2000) || ' of ' || length(text) || ' chars]' END AS preview
        FROM documents WHERE text IS NOT NULL""",
    "token_route": """SELECT doc_id, floor(length(text) / 3.5)::INT AS tokens, CASE WHEN floor(length(text) / 3.5) <= 3000 THEN 'single' ELSE 'map_reduce' END AS route
        FROM documents WHERE text IS NOT NULL""",
    "context_route": f"WITH {_DOCUMENT_TEXT} SELECT file_id, length(text) AS chars, CASE WHEN length(text) <= 1750 THEN 'full' ELSE 'retrieval' END AS route FROM document_texts",
    "hard_split": f"""
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, piece FROM (
            SELECT doc_id, i, substr(text, i + 1, 1500) AS piece FROM (SELECT doc_id, text, unnest(range(0, length(text), 1300)) AS i FROM documents WHERE text IS NOT NULL))
        WHERE regexp_matches(piece, '{NWS}')""",
    "overlap_chunks": f"""
        SELECT id, CASE WHEN p IS NULL THEN contents ELSE {_strip(f"regexp_replace(right(p, 150), '^{WS}+', '') || ' ' || contents")} END AS chunk FROM (
            SELECT id, contents, lag(contents) OVER (PARTITION BY file_id ORDER BY parent_id, id) AS p FROM chunks
            WHERE is_search AND hierarchy = 'parent' AND type = 'text' AND contents IS NOT NULL)""",
    "sentences": f"WITH {_sentences('documents', 'doc_id', 'text', 'text IS NOT NULL')} SELECT doc_id, pos, sentence FROM sentences",
    "child_chunks": f"""
        WITH RECURSIVE parents AS (SELECT id, contents FROM chunks WHERE is_search AND hierarchy = 'parent' AND type = 'text' AND contents IS NOT NULL),
        {_sentences('parents', 'id', 'contents', 'length(contents) > 400')},
        fold AS (
            SELECT DISTINCT id, -1::BIGINT AS n, '' AS held, '' AS closed, '' AS long FROM sentences
            UNION ALL
            SELECT f.id, s.pos, CASE WHEN length(s.sentence) > 400 THEN '' WHEN f.held = '' OR length(f.held) + 1 + length(s.sentence) > 400 THEN s.sentence ELSE f.held || ' ' || s.sentence END,
                   CASE WHEN length(s.sentence) > 400 OR f.held <> '' AND length(f.held) + 1 + length(s.sentence) > 400 THEN f.held ELSE '' END,
                   CASE WHEN length(s.sentence) > 400 THEN s.sentence ELSE '' END
            FROM fold f JOIN sentences s ON f.id = s.id AND s.pos = f.n + 1),
        pieces AS (
            SELECT id, n, 0 AS kind, 0 AS w, closed AS c FROM fold WHERE closed <> ''
            UNION ALL SELECT id, n, 1, w, substr(long, w + 1, 400) FROM (SELECT id, n, long, unnest(range(0, length(long), 400)) AS w FROM fold WHERE long <> '')
            UNION ALL SELECT id, n, 2, 0, held FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC) AS r FROM fold) WHERE r = 1 AND held <> ''
            UNION ALL SELECT id, 0, 0, 0, contents FROM parents WHERE length(contents) <= 400),
        stripped AS (SELECT id, n, kind, w, {_strip("c")} AS chunk FROM pieces WHERE regexp_matches(c, '{NWS}'))
        SELECT id, row_number() OVER (PARTITION BY id ORDER BY n, kind, w) - 1 AS pos, chunk FROM stripped""",
    "table_chunks": f"""
        WITH t AS (SELECT seq, unnest(tables) AS t, generate_subscripts(tables, 1) - 1 AS table_no FROM documents_in WHERE tables IS NOT NULL),
        d AS (SELECT seq, table_no, t.data AS data FROM t WHERE t.data IS NOT NULL AND len(t.data) > 0),
        u AS (SELECT seq, table_no, list_transform(data[1], lambda c: {_cell("c")}) AS h, data[2:] AS body FROM d
              WHERE NOT (len(list_filter(data[1], lambda c: c IS NOT NULL AND regexp_matches(c, '{NWS}'))) < 2 AND len(data) < 2)),
        r AS (SELECT seq, table_no, h, unnest(body) AS r, generate_subscripts(body, 1) - 1 AS row_no FROM u),
        c AS (SELECT seq, table_no, row_no, h, unnest(r) AS c, generate_subscripts(r, 1) AS j FROM r),
        n AS (SELECT seq, table_no, row_no, j, j <= len(h) AS headed, CASE WHEN j <= len(h) THEN h[j] ELSE 'column_' || j END AS n, {_cell("c")} AS v FROM c),
        members AS (SELECT seq, table_no, row_no, n, min(j) AS place, arg_max(v, j) AS v FROM n WHERE n <> '' GROUP BY seq, table_no, row_no, n),
        objects AS (SELECT seq, table_no, row_no, '{{' || string_agg(to_json(n) || ':' || to_json(v), ',' ORDER BY place) || '}}' AS o FROM members GROUP BY seq, table_no, row_no),
        parents AS (SELECT seq, table_no, '[' || string_agg(o, ',' ORDER BY row_no) || ']' AS parent FROM objects GROUP BY seq, table_no),
        said AS (SELECT seq, table_no, row_no, 'W tej tabeli wiersz zawiera następujące dane: '
                        || string_agg('wartość dla ' || chr(39) || n || chr(39) || ' to ' || chr(39) || v || chr(39), '; ' ORDER BY j) || '.' AS child
                 FROM n WHERE headed AND n <> '' AND v <> '' GROUP BY seq, table_no, row_no)
        SELECT seq, table_no, row_no, parent, child FROM said JOIN parents USING (seq, table_no)""",
    "dedup_cascade": f"WITH {_CASCADE} SELECT seq, file_id, action, coalesce(canonical_file_id, -1) AS canonical_file_id FROM decided",
    "alias_rows": f"""WITH {_CASCADE}
        SELECT d.file_id, d.file_id AS parent_id, 'parent' AS hierarchy, 'text' AS type, u.filename, u.content_hash, false AS is_search, 'x' AS contents, 64 AS width
        FROM decided d JOIN incoming u USING (seq) WHERE action = 'alias'""",
    "resolve_scope": f"WITH {_SCOPE} SELECT * FROM scope",
    "document_text": f"WITH {_DOCUMENT_TEXT} SELECT * FROM document_texts",
    "collection_counts": "SELECT hierarchy, type, is_search, count(*) AS n, count(DISTINCT file_id) AS files, sum(length(contents))::BIGINT AS chars FROM chunks GROUP BY ALL",
    "dense_topk": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
            SELECT q.vec_id AS qid, v.vec_id AS id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
            FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)) WHERE rank <= 10""",
    "bm25_topk": f"""
        WITH corpus AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL), asked AS (SELECT item_id AS qid, text AS query FROM bench_items WHERE text IS NOT NULL), {_BM25}
        SELECT qid, id, score, rank FROM sparse WHERE rank <= 10""",
    "hybrid_topk": f"WITH {_HYBRID} SELECT qid, id, score, rank FROM fused",
    "parent_lookup": f"WITH {_PARENTS} SELECT qid, parent_id, file_id, type FROM fragments",
    "rerank_topk": f"WITH {_PARENTS} SELECT qid, parent_id, score, rank FROM reranked",
    "rag_context": f"""WITH {_PARENTS}
        SELECT qid, length(context) AS chars, md5(context) AS context_md5 FROM (
            SELECT qid, string_agg('--- Fragment z dokumentu: ' || coalesce(nullif(filename, ''), 'ID ' || file_id) || ' ---' || chr(10) || coalesce(contents, '') || chr(10) || chr(10), '' ORDER BY rank) AS context
            FROM reranked GROUP BY qid)""",
    "parse_json": f"""
        WITH cleaned AS (SELECT doc_id, attempt, task_type, {_strip(_CLEAN)} AS c FROM raw_answers),
        found AS (SELECT *, CASE WHEN json_valid(c) THEN c WHEN json_valid(regexp_extract(c, '(?s)\\{{.*\\}}')) THEN regexp_extract(c, '(?s)\\{{.*\\}}') END AS j FROM cleaned)
        SELECT doc_id, attempt, task_type, j IS NOT NULL AS parsed,
               CASE WHEN json_type(json_extract(j, '$.category')) = 'VARCHAR' THEN json_extract_string(j, '$.category') END AS category,
               CASE WHEN json_type(json_extract(j, '$.subcategory')) = 'VARCHAR' THEN json_extract_string(j, '$.subcategory') END AS subcategory FROM found""",
    "coerce_category": f"""
        WITH vocabulary AS (SELECT category AS name, {_PLAIN.format(_squash("category"))} AS n FROM taxonomy WHERE subcategory IS NULL),
        entered AS (SELECT DISTINCT category, {_PLAIN.format(_squash("category"))} AS v FROM structured_output WHERE category IS NOT NULL),
        scored AS (SELECT category, name, CASE WHEN greatest(length(v), length(n)) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein(v, n)::DOUBLE / greatest(length(v), length(n)) END AS s FROM entered, vocabulary),
        best AS (SELECT *, max(s) OVER (PARTITION BY category) AS b FROM scored),
        won AS (SELECT category, min(name) AS coerced FROM best WHERE s >= b - 0.02::DOUBLE AND b >= 0.8::DOUBLE GROUP BY category HAVING count(*) = 1)
        SELECT answer_id, coerced FROM structured_output LEFT JOIN won USING (category)""",
    "confidential_report": f"""
        WITH kinds(kind, label) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in J.CONFIDENTIAL_LABELS.items())}),
        reports AS (SELECT row_number() OVER () AS rid, * FROM confidential_reports),
        entered AS (SELECT DISTINCT t, {_PLAIN.format(_squash("t"))} AS v FROM (SELECT unnest(types) AS t FROM reports) WHERE t IS NOT NULL),
        scored AS (SELECT t, kind, {_similarity("v", "kind")} AS s FROM entered, kinds),
        won AS ({_winner("scored", "t", "kind")}),
        items AS (SELECT rid, i, coerced FROM (SELECT rid, unnest(types) AS t, generate_subscripts(types, 1) AS i FROM reports) LEFT JOIN won USING (t)),
        firsts AS (SELECT rid, coerced, min(i) AS i FROM items GROUP BY rid, coerced),
        listed AS (SELECT rid, bool_or(coerced IS NULL) AS bad, string_agg('- ' || label, chr(10) ORDER BY i) AS lines FROM firsts LEFT JOIN kinds ON coerced = kind GROUP BY rid)
        SELECT document_id, task_id, CASE WHEN contains_sensitive IS NULL OR coalesce(bad, false) THEN '{J.MANUAL_REVIEW}' WHEN NOT contains_sensitive THEN 'Dane wrażliwe: NIE'
            WHEN lines IS NULL THEN 'Dane wrażliwe: TAK' ELSE 'Dane wrażliwe: TAK' || chr(10) || 'Wykryte typy:' || chr(10) || lines END AS report FROM reports LEFT JOIN listed USING (rid)""",
    "resolve_category": f"""
        WITH cleaned AS (SELECT row_number() OVER () AS rid, doc_id, attempt, {_strip(_CLEAN)} AS c FROM raw_answers WHERE task_type = 'CATEGORY_SUBCATEGORY'),
        found AS (SELECT *, CASE WHEN json_valid(c) THEN c WHEN json_valid(regexp_extract(c, '(?s)\\{{.*\\}}')) THEN regexp_extract(c, '(?s)\\{{.*\\}}') END AS j FROM cleaned),
        fields AS (SELECT rid, doc_id, attempt, CASE WHEN json_type(json_extract(j, '$.category')) = 'VARCHAR' THEN json_extract_string(j, '$.category') END AS cat,
                          CASE WHEN json_type(json_extract(j, '$.subcategory')) = 'VARCHAR' THEN json_extract_string(j, '$.subcategory') END AS sub FROM found),
        plain AS (SELECT *, {_PLAIN.format(_squash("cat"))} AS vc, {_PLAIN.format(_squash("sub"))} AS vs FROM fields),
        names AS (SELECT DISTINCT category, {_PLAIN.format(_squash("category"))} AS n FROM taxonomy),
        c_scored AS (SELECT rid, category, {_similarity("vc", "n")} AS s FROM plain, names WHERE cat IS NOT NULL),
        c_won AS ({_winner("c_scored", "rid", "category")}),
        subs AS (SELECT category, subcategory, {_PLAIN.format(_squash("subcategory"))} AS n FROM taxonomy WHERE subcategory IS NOT NULL),
        s_scored AS (SELECT p.rid, subcategory, {_similarity("vs", "n")} AS s FROM plain p JOIN c_won USING (rid) JOIN subs ON subs.category = c_won.coerced WHERE sub IS NOT NULL),
        s_won AS ({_winner("s_scored", "rid", "subcategory")}),
        done AS (SELECT doc_id, attempt, c_won.coerced AS category, s_won.coerced AS subcategory FROM plain JOIN c_won USING (rid) LEFT JOIN s_won USING (rid)
                 WHERE s_won.coerced IS NOT NULL OR c_won.coerced NOT IN (SELECT category FROM subs)),
        first_done AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY attempt, category, subcategory) AS rn FROM done)
        SELECT d.doc_id, coalesce(f.category, '{J.MANUAL_REVIEW}') AS category, f.subcategory FROM (SELECT DISTINCT doc_id FROM plain) d LEFT JOIN first_done f ON d.doc_id = f.doc_id AND rn = 1""",
    "category_listing": """
        SELECT category, '- ' || category || CASE WHEN count(subcategory) > 0 THEN ': ' || string_agg(subcategory, ', ' ORDER BY subcategory) ELSE '' END AS line FROM taxonomy GROUP BY category""",
    "task_params": """
        SELECT task_id, epoch_us(requested_at) AS at_us, task_type,
               len(list_distinct(list_transform(json_extract(params, '$.CATEGORY_SUBCATEGORY.categories[*]'), lambda c: json_extract_string(c, '$.name'))))::INT AS categories,
               coalesce(json_array_length(json_extract(params, '$.DEPARTMENT_ASSIGNMENT.departments')), 0)::INT AS departments,
               json_extract_string(params, '$.OTHER.query') AS query FROM (SELECT * REPLACE (coalesce(params, '{}') AS params) FROM task_requests)""",
    "department_listing": """
        WITH d AS (SELECT task_id, requested_at, i, CASE WHEN json_type(x) = 'VARCHAR' THEN json_extract_string(x, '$') ELSE json_extract_string(x, '$.name') END AS name,
                          CASE WHEN json_type(x) = 'OBJECT' THEN json_extract_string(x, '$.description') END AS description
            FROM (SELECT rowid AS r, task_id, requested_at, unnest(json_extract(params, '$.DEPARTMENT_ASSIGNMENT.departments[*]')) AS x,
                         generate_subscripts(json_extract(params, '$.DEPARTMENT_ASSIGNMENT.departments[*]'), 1) AS i
                  FROM (SELECT row_number() OVER () AS rowid, * FROM task_requests) WHERE task_type = 'DEPARTMENT_ASSIGNMENT'))
        SELECT task_id, epoch_us(requested_at) AS at_us, string_agg('- ' || name || CASE WHEN coalesce(description, '') <> '' THEN ': ' || description ELSE '' END, chr(10) ORDER BY i) AS listing,
               '{"type":"object","properties":{"department":{"enum":' || to_json(list(name ORDER BY i)) || '}},"required":["department"],"additionalProperties":false}' AS schema
        FROM d GROUP BY task_id, requested_at""",
    "resolve_confidential": f"""
        WITH kinds(kind, label) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in J.CONFIDENTIAL_LABELS.items())}),
        cleaned AS (SELECT row_number() OVER () AS rid, doc_id, attempt, {_strip(_CLEAN)} AS c FROM raw_answers WHERE task_type = 'CHECK_CONFIDENTIAL'),
        found AS (SELECT *, CASE WHEN json_valid(c) THEN c WHEN json_valid(regexp_extract(c, '(?s)\\{{.*\\}}')) THEN regexp_extract(c, '(?s)\\{{.*\\}}') END AS j FROM cleaned),
        flags AS (SELECT *, CASE WHEN json_type(json_extract(j, '$.contains_sensitive')) = 'BOOLEAN' THEN json_extract_string(j, '$.contains_sensitive') = 'true'
            WHEN json_type(json_extract(j, '$.contains_sensitive')) = 'VARCHAR' THEN CASE WHEN lower(trim(json_extract_string(j, '$.contains_sensitive'))) IN ('true', 'tak', 'yes', '1') THEN true
                WHEN lower(trim(json_extract_string(j, '$.contains_sensitive'))) IN ('false', 'nie', 'no', '0') THEN false END END AS flag FROM found),
        entered AS (SELECT rid, unnest(json_extract_string(j, '$.types[*]')) AS t, generate_subscripts(json_extract_string(j, '$.types[*]'), 1) AS i FROM flags),
        plain AS (SELECT DISTINCT t, {_PLAIN.format(_squash("t"))} AS v FROM entered WHERE t IS NOT NULL),
        scored AS (SELECT t, kind, {_similarity("v", "kind")} AS s FROM plain, kinds),
        won AS ({_winner("scored", "t", "kind")}),
        firsts AS (SELECT rid, coerced, min(i) AS i FROM entered LEFT JOIN won USING (t) GROUP BY rid, coerced),
        listed AS (SELECT rid, bool_or(coerced IS NULL) AS bad, string_agg('- ' || label, chr(10) ORDER BY i) AS lines FROM firsts LEFT JOIN kinds ON coerced = kind GROUP BY rid)
        SELECT doc_id, attempt, CASE WHEN flag IS NULL OR coalesce(bad, false) OR (json_extract(j, '$.types') IS NOT NULL AND json_type(json_extract(j, '$.types')) <> 'ARRAY') THEN '{J.MANUAL_REVIEW}'
            WHEN NOT flag THEN 'Dane wrażliwe: NIE' WHEN lines IS NULL THEN 'Dane wrażliwe: TAK'
            ELSE 'Dane wrażliwe: TAK' || chr(10) || 'Wykryte typy:' || chr(10) || lines END AS report FROM flags LEFT JOIN listed USING (rid)""",
    "structured_replies": f"""
        WITH {_DOCUMENT_TEXT},
        rows AS (SELECT r.*, d.text, json_extract(coalesce(params, '{{}}'), '$.CATEGORY_SUBCATEGORY.categories[*]') AS cats,
                        json_extract(coalesce(params, '{{}}'), '$.DEPARTMENT_ASSIGNMENT.departments[*]') AS deps
                 FROM task_requests r LEFT JOIN document_texts d ON r.document_id = d.file_id
                 WHERE task_type IN ('CATEGORY_SUBCATEGORY', 'DEPARTMENT_ASSIGNMENT', 'BASE_EXTRACTION', 'CHECK_CONFIDENTIAL')),
        picked AS (SELECT *, json_extract_string(cats[1], '$.name') AS first_name FROM rows),
        last_of AS (SELECT *, list_filter(cats, lambda c: json_extract_string(c, '$.name') = first_name)[-1] AS c FROM picked),
        told AS (SELECT *, CASE WHEN task_type = 'CATEGORY_SUBCATEGORY' AND len(cats) = 0 THEN 'categories must not be empty'
            WHEN task_type = 'DEPARTMENT_ASSIGNMENT' AND len(deps) = 0 THEN 'departments must not be empty' WHEN text IS NULL THEN 'document has no summary' END AS error FROM last_of)
        SELECT document_id, task_id, task_type, error IS NULL AS ok, CASE WHEN error IS NULL AND task_type = 'CATEGORY_SUBCATEGORY' THEN first_name END AS category,
               CASE WHEN error IS NULL AND task_type = 'CATEGORY_SUBCATEGORY' THEN json_extract_string(c, '$.subcategories[0].name') END AS subcategory,
               CASE WHEN error IS NULL AND task_type = 'DEPARTMENT_ASSIGNMENT' THEN CASE WHEN json_type(deps[1]) = 'VARCHAR' THEN json_extract_string(deps[1], '$') ELSE json_extract_string(deps[1], '$.name') END END AS department,
               CASE WHEN error IS NULL AND task_type = 'BASE_EXTRACTION' THEN '' END AS extraction,
               CASE WHEN error IS NULL AND task_type = 'CHECK_CONFIDENTIAL' THEN 'Dane wrażliwe: NIE' END AS confidential, error FROM told""",
    "scoped_topk": f"""
        WITH {_SCOPE},
        corpus AS (SELECT id, contents AS text, file_id FROM chunks WHERE is_search AND hierarchy = 'child' AND contents IS NOT NULL),
        asked AS (SELECT c.id AS qid, substr(contents, 1, 200) AS query, s.canonical_file_id AS bound FROM chunks c JOIN scope s USING (file_id)
                  WHERE is_search AND hierarchy = 'child' AND contents IS NOT NULL AND id % 100 = 0),
        {_BM25.replace("FROM asked_terms JOIN tf USING (term) JOIN df USING (term), stats", "FROM asked_terms JOIN tf USING (term) JOIN df USING (term) JOIN corpus co USING (id) JOIN asked q USING (qid), stats WHERE co.file_id = q.bound")}
        SELECT qid, id, score, rank FROM sparse WHERE rank <= 10""",
    "rag_prompt": f"""
        WITH {_DOCUMENT_TEXT},
        asked AS (SELECT id AS qid, file_id FROM chunks WHERE is_search AND hierarchy = 'child' AND contents IS NOT NULL AND id % 100 = 0),
        told AS (SELECT qid, {_sql_text(prompts.rag_parts()[0])} || '--- Fragment 1 ---' || chr(10) || text || chr(10) || chr(10) || {_sql_text(prompts.rag_parts()[1])} AS s
                 FROM asked JOIN document_texts USING (file_id) WHERE length(text) <= 1750 AND text <> '')
        SELECT qid, length(s) AS chars, md5(s) AS system_md5 FROM told""",
    "latest_requests": """
        SELECT task_id, document_id, task_type, epoch_us(requested_at) AS at_us FROM (
            SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY requested_at DESC, document_id, task_type) AS rn FROM task_requests) WHERE rn = 1""",
    "event_windows": """
        SELECT epoch_us(ts) - epoch_us(ts) % 3600000000 AS start_us, event_type, count(*) AS n, round(round(sum(value), 4), 2) AS total FROM events GROUP BY ALL""",
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
