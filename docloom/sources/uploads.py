"""Uploads: files or a table of them, checked by kind and read as pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import strip
from docloom.models import Parser

#: The kinds of upload that are taken.
CONTENT_TYPES = (
    "application/pdf",
    "application/doc",
    "application/msword",
    "application/docx",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/txt",
    "text/plain",
    "application/xml",
    "text/xml",
)


TABLES = "array<struct<page_number:int,data:array<array<string>>>>"


def files(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path with their bytes: ``path, modificationTime, length, content``."""
    return spark.read.format("binaryFile").load(path)


def admitted(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Uploads of a known kind, and the others."""
    known = F.coalesce(F.col("content_type").isin(*CONTENT_TYPES), F.lit(False))
    return uploads.where(known), uploads.where(~known)


def page_text(pages: Column) -> Column:
    """A document's text: pages joined by blank lines, white space at the outer ends removed."""
    return strip(F.array_join(pages, "\n\n"))


def parsed(uploads: DataFrame, parser: Parser) -> DataFrame:
    """Uploads with ``pages``, ``tables`` and ``error``: a file that cannot be read does not stop the others."""
    kept = [f for f in uploads.schema.fields if f.name not in ("pages", "tables", "error")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pages, tables, errors = [], [], []
            for content, kind in zip(pdf["content"], pdf["content_type"]):
                try:
                    text, found = parser.pages(bytes(content), kind)
                    pages.append(list(text))
                    tables.append([{"page_number": t["page_number"], "data": t["data"]} for t in found])
                    errors.append(None)
                except Exception as e:
                    pages.append(None)
                    tables.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf[[f.name for f in kept]].assign(pages=pages, tables=tables, error=errors)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return uploads.mapInPandas(run, f"{schema}, pages array<string>, tables {TABLES}, error string")


def received(forms: DataFrame) -> DataFrame:
    """Upload forms ``(document_id, content_type, tasks, params, content)`` as checked requests with a status.

    ``status`` is 200, 400 for a missing field or broken JSON, 415 for a kind that is not taken; only rows
    of status 200 carry ``task_list``, each task with an id of its own.
    """
    tasks = F.from_json("tasks", "array<string>")
    number = F.expr("try_cast(document_id AS bigint)")
    missing = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"Missing required field: {c}")) for c in ("document_id", "content_type", "tasks", "content")])
    broken = F.when(tasks.isNull() | F.try_parse_json("tasks").isNull() | F.try_parse_json(F.coalesce("params", F.lit("{}"))).isNull(), F.lit("Invalid JSON in 'tasks' or 'params' field."))
    kind = F.when(~F.col("content_type").isin(*CONTENT_TYPES), F.concat(F.lit("Unsupported Media Type: "), F.col("content_type")))
    error = F.coalesce(missing, F.when(number.isNull(), F.lit("documentId is no number")), broken, kind)
    status = F.when(missing.isNotNull() | number.isNull() | broken.isNotNull(), 400).when(kind.isNotNull(), 415).otherwise(200)
    rows = forms.withColumn("error", error).withColumn("status", status)
    return rows.withColumn("task_list", F.when(F.col("status") == 200, F.transform(tasks, lambda t: F.struct(t.alias("task_type"), F.expr("uuid()").alias("task_id")))))


def within_capacity(requests: DataFrame, pending: int, most: int = 500, retry_after: int = 10) -> DataFrame:
    """Of the accepted requests in order of ``seq``, the first ``most - pending`` keep status 200; the others get 503 and ``retry_after``.

    The cut is found from the ``seq`` of the first request too many, not by ranking all of them in one task.
    """
    room = max(0, most - pending)
    taken = requests.where("status = 200").orderBy("seq").limit(room + 1).agg(F.count("*").alias("n"), F.max("seq").alias("last")).first()
    full = F.lit(taken["n"] > room) & (F.col("seq") >= F.lit(taken["last"])) & (F.col("status") == 200)
    return requests.withColumn("retry_after", F.when(full, F.lit(retry_after))).withColumn("error", F.when(full, F.lit("Server busy; too many pending documents")).otherwise(F.col("error"))).withColumn(
        "status", F.when(full, 503).otherwise(F.col("status")))
