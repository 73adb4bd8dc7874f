"""Model tasks over documents: summaries by map and reduce, resolving with repair, dispatch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import prompts
from docloom.functions import json_output as J
from docloom.functions.text import is_blank, strip, without_markdown
from docloom.models import LanguageModel, asked
from docloom.operators.chunking import parent_chunks
from docloom.runtime import written

TASK_TYPES = ("SUMMARY", "CATEGORY_SUBCATEGORY", "DEPARTMENT_ASSIGNMENT", "BASE_EXTRACTION", "CHECK_CONFIDENTIAL", "SUGGESTED_ACTION", "OTHER")
STRUCTURED = ("CATEGORY_SUBCATEGORY", "DEPARTMENT_ASSIGNMENT", "BASE_EXTRACTION", "CHECK_CONFIDENTIAL")
CATEGORIES, DEPARTMENTS = "array<struct<name:string,subs:array<string>>>", "array<struct<name:string,description:string>>"
MAX_REPAIRS, REDUCE_PASSES = 1, 5


def with_params(requests: DataFrame, column: str = "params") -> DataFrame:
    """Adds ``categories``, ``departments``, ``query`` and ``params_error`` read from a JSON column.

    A category named twice keeps its place and takes the last list of subcategories; a department is a name or
    an object with a description. What is no JSON is told in ``params_error``; an absent value is no error.
    """
    v = F.try_parse_json(F.coalesce(column, F.lit("{}")))
    rows = requests.withColumn("_v", v)
    cats = F.coalesce(F.try_variant_get("_v", "$.CATEGORY_SUBCATEGORY.categories", "array<struct<name:string,subcategories:array<struct<name:string>>>>"),
                      F.array().cast("array<struct<name:string,subcategories:array<struct<name:string>>>>"))
    rows = rows.withColumn("_c", F.filter(cats, lambda c: c["name"].isNotNull()))
    last = F.transform(F.array_distinct(F.transform("_c", lambda c: c["name"])), lambda n: F.struct(
        n.alias("name"), F.transform(F.coalesce(F.element_at(F.filter("_c", lambda c: c["name"] == n), -1)["subcategories"], F.array().cast("array<struct<name:string>>")), lambda s: s["name"]).alias("subs")))
    listed = F.coalesce(F.try_variant_get("_v", "$.DEPARTMENT_ASSIGNMENT.departments", "array<variant>"), F.array().cast("array<variant>"))
    named = F.transform(listed, lambda d: F.struct(
        F.when(F.schema_of_variant(d) == "STRING", F.try_variant_get(d, "$", "string")).otherwise(F.try_variant_get(d, "$.name", "string")).alias("name"),
        F.when(F.schema_of_variant(d) != "STRING", F.try_variant_get(d, "$.description", "string")).alias("description")))
    return rows.withColumn("categories", last).withColumn("departments", F.filter(named, lambda d: d["name"].isNotNull())).withColumn(
        "query", F.try_variant_get("_v", "$.OTHER.query", "string")).withColumn(
        "params_error", F.when(F.col(column).isNotNull() & F.col("_v").isNull(), F.lit("params are no JSON"))).drop("_v", "_c")


def summary_text(pages: Column) -> Column:
    """The text a summary is made from: each page stripped, joined by blank lines."""
    return F.array_join(F.transform(F.filter(pages, lambda p: p.isNotNull()), strip), "\n\n")


def _or_raise(answer: Column) -> Column:
    """An answer's text; a part that failed fails its document's summary, which is told instead of hidden."""
    return F.coalesce(answer["text"], F.when(answer["error"].isNotNull(), F.concat(F.lit("\x00"), answer["error"])))


def summaries(docs: DataFrame, model: LanguageModel, budget_chars: int = 10_500, model_name: str = "") -> DataFrame:
    """``(file_id, summary, error)`` of ``(file_id, text)``.

    Texts within the budget get one call. Longer ones are cut, each part is summarised, the
    parts are joined in order, and that repeats while the result is too long, at most
    ``REDUCE_PASSES`` times; what still is too long is cut off.
    """
    fits = budget_chars + 3  # the budget is in whole tokens of 3.5 characters
    current = docs.select("file_id", F.coalesce("text", F.lit("")).alias("text"))
    for _ in range(REDUCE_PASSES):
        current = written(current)
        long = current.where(F.length("text") > fits)
        if long.isEmpty():
            break
        parts = long.select("file_id", F.posexplode(parent_chunks(F.col("text"), budget_chars, min(200, budget_chars // 10))).alias("n", "part"))
        told = prompts.system("SUMMARY_PART", model_name)
        said = parts.select("file_id", "n", _or_raise(asked(F.lit("SUMMARY_PART"), F.col("part"), model, told)).alias("s")).where(F.col("s").isNotNull() & ~is_blank(F.col("s")))
        joined = said.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]), "\n\n").alias("text"))
        current = current.where(F.length("text") <= fits).unionByName(long.select("file_id").join(joined, "file_id", "left").select("file_id", F.coalesce("text", F.lit("")).alias("text")))
    # a failed part carries its error in front of everything else
    failed = F.regexp_extract("text", "\\x{0}([^\\n]*)", 1)
    current = current.withColumn("_e", F.when(F.col("text").contains("\x00"), failed))
    whole = F.when(F.length("text") > fits, F.substring("text", 1, budget_chars)).otherwise(F.col("text"))
    rows = current.withColumn("_a", asked(F.lit("SUMMARY"), F.when(~is_blank(F.col("text")) & F.col("_e").isNull(), whole), model, prompts.system("SUMMARY", model_name)))
    error = F.coalesce("_e", F.col("_a.error"))
    return rows.select("file_id", F.when(error.isNull(), without_markdown(F.coalesce("_a.text", F.lit("")))).alias("summary"), error.alias("error"))


def resolved(rows: DataFrame, resolve: Callable[[DataFrame], DataFrame], repair: Callable[[DataFrame], DataFrame], *, repairs: int = MAX_REPAIRS) -> DataFrame:
    """Rows ``(.., raw, error)`` with what ``resolve`` adds, ``ok`` among it.

    Rows that are not ``ok`` are asked again by ``repair``, which sees the answer rejected last; rows with an
    error are not. After ``repairs`` calls the rest stays unresolved.
    """
    done = written(resolve(rows))
    for _ in range(repairs):
        bad = done.where("not ok and error is null")
        if bad.isEmpty():
            break
        again = resolve(repair(bad).select(*rows.columns))
        done = written(done.where("ok or error is not null").unionByName(again))
    return done


def recorded_categories(raw_answers: DataFrame, categories: str) -> DataFrame:
    """``(doc_id, category, subcategory)`` from recorded answers, ``categories`` a column: the first attempt that resolves, else manual review.

    A later attempt stands for the repair call of the one before it.
    """
    rows = J.with_category(raw_answers.where("task_type = 'CATEGORY_SUBCATEGORY'"), "raw", categories)
    best = rows.groupBy("doc_id").agg(F.min(F.when(F.col("category").isNotNull(), F.struct("attempt", "category", "subcategory"))).alias("r"))
    return best.select("doc_id", F.coalesce(F.col("r.category"), F.lit(J.MANUAL_REVIEW)).alias("category"), F.col("r.subcategory").alias("subcategory"))


def _resolve(rows: DataFrame) -> DataFrame:
    """All that a raw answer of a structured task can hold, each kind by its own rules."""
    kind = F.col("task_type")
    rows = J.with_category(rows, "raw", "categories")
    rows = J.with_department(rows.withColumn("_names", F.transform("departments", lambda d: d["name"])), "raw", "_names").drop("_names")
    rows = J.with_confidential(rows, "raw").withColumn("data", J.extraction_of(F.col("raw")))
    ok = (F.when(kind == "CATEGORY_SUBCATEGORY", F.col("category").isNotNull()).when(kind == "DEPARTMENT_ASSIGNMENT", F.col("department").isNotNull())
          .when(kind == "CHECK_CONFIDENTIAL", F.col("contains_sensitive").isNotNull()).when(kind == "BASE_EXTRACTION", F.col("data").isNotNull()).otherwise(F.lit(True)))
    return rows.withColumn("ok", ok)


def _told(kind: Column, model_name: str) -> Column:
    """System prompt of each task, with its list of choices."""
    kinds = F.lit("\n".join(f"- {k}" for k in J.CONFIDENTIAL_LABELS))
    listing = {"CATEGORY_SUBCATEGORY": prompts.category_listing(F.col("categories")), "DEPARTMENT_ASSIGNMENT": prompts.department_listing(F.col("departments")), "CHECK_CONFIDENTIAL": kinds}
    out = F.lit("")
    for task in (*STRUCTURED, "SUGGESTED_ACTION"):
        out = F.when(kind == task, prompts.system(task, model_name, listing.get(task))).otherwise(out)
    return out


def dispatch(requests: DataFrame, summary: DataFrame, model: LanguageModel, *, repairs: int = MAX_REPAIRS, model_name: str = "") -> DataFrame:
    """``(document_id, task_id, task_type, ok, payload)``: one reply for each request.

    Every task but ``OTHER`` sees the summary, ``OTHER`` only its own query. Structured answers are resolved, asked
    again with the rejected answer where they cannot be, and go to manual review after that. A task that
    fails yields a reply with its error and does not touch the others. All tasks that ask the model do so in one
    pass over the requests, and each repair in one over those left.
    """
    rows = with_params(requests.select("document_id", "task_id", "task_type", "params")).join(
        summary.selectExpr("file_id as document_id", "summary", "error as summary_error"), "document_id", "left")
    kind = F.col("task_type")
    schema = (F.when(kind == "CATEGORY_SUBCATEGORY", J.category_schema_of(F.col("categories"))).when(kind == "DEPARTMENT_ASSIGNMENT", J.department_schema_of(F.transform("departments", lambda d: d["name"])))
              .when(kind == "BASE_EXTRACTION", F.lit(J.EXTRACTION_SCHEMA)).when(kind == "CHECK_CONFIDENTIAL", F.lit(J.CONFIDENTIAL_SCHEMA)))
    before = (F.when(~kind.isin(*TASK_TYPES), F.concat(F.lit("Unsupported task type: "), kind)).when(F.col("params_error").isNotNull(), F.col("params_error"))
              .when((kind == "CATEGORY_SUBCATEGORY") & (F.size("categories") == 0), F.lit("categories must not be empty"))
              .when((kind == "DEPARTMENT_ASSIGNMENT") & (F.size("departments") == 0), F.lit("departments must not be empty"))
              .when((kind != "OTHER") & F.col("summary").isNull(), F.coalesce("summary_error", F.lit("document has no summary"))))
    rows = rows.withColumn("error", before).withColumn("system", _told(kind, model_name)).withColumn("schema", schema).withColumn(
        "prompt", F.when(kind == "OTHER", F.coalesce("query", F.lit(""))).otherwise(F.col("summary")))
    calls = kind.isin(*STRUCTURED, "SUGGESTED_ACTION", "OTHER") & F.col("error").isNull()
    rows = rows.withColumn("_a", asked(kind, F.when(calls, F.col("prompt")), model, F.col("system"), F.col("schema")))
    rows = rows.withColumn("raw", F.col("_a.text")).withColumn("error", F.coalesce("error", F.col("_a.error"))).select(
        "document_id", "task_id", "task_type", "categories", "departments", "summary", "system", "schema", "prompt", "raw", "error")

    def repair(bad: DataFrame) -> DataFrame:
        again = bad.withColumn("_a", asked(kind, prompts.repair_prompt(F.col("prompt"), F.col("raw")), model, prompts.repair_system(F.col("system")), F.col("schema")))
        return again.withColumn("raw", F.col("_a.text")).withColumn("error", F.col("_a.error"))

    done = resolved(rows, _resolve, repair, repairs=repairs)
    manual, good = F.lit(J.MANUAL_REVIEW), F.col("ok")
    text = lambda c: F.when(good, c).otherwise(manual)
    results = F.struct(
        F.when(kind == "SUMMARY", F.col("summary")).alias("SUMMARY"),
        F.when(kind == "CATEGORY_SUBCATEGORY", F.struct(text(F.col("category")).alias("CATEGORY"), F.when(good, F.col("subcategory")).alias("SUBCATEGORY"))).alias("CATEGORY_SUBCATEGORY"),
        F.when(kind == "DEPARTMENT_ASSIGNMENT", text(F.col("department"))).alias("DEPARTMENT_ASSIGNMENT"),
        F.when(kind == "BASE_EXTRACTION", text(J.rendered_extraction(F.col("data")))).alias("BASE_EXTRACTION"),
        F.when(kind == "CHECK_CONFIDENTIAL", text(J.rendered_confidential(F.col("contains_sensitive"), F.col("types")))).alias("CHECK_CONFIDENTIAL"),
        F.when(kind == "SUGGESTED_ACTION", without_markdown(F.col("raw"))).alias("SUGGESTED_ACTION"),
        F.when(kind == "OTHER", without_markdown(F.col("raw"))).alias("OTHER"))
    return done.select("document_id", "task_id", "task_type", F.col("error").isNull().alias("ok"), J.payload(F.col("document_id"), F.col("task_id"), kind, results, F.col("error")).alias("payload"))
