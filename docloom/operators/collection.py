"""The stored collection: which upload becomes what, and reading a document back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import content_hash, is_blank
from docloom.runtime import written


def cascade(incoming: DataFrame, collection: DataFrame) -> DataFrame:
    """``(seq, file_id, action, canonical_file_id)`` with action ``skip``, ``alias`` or ``full``.

    The outcome of taking uploads one by one, computed for all at once: a file id that is
    stored or came before is skipped; else the first upload of a non-empty hash that no
    stored file has is kept in full and later ones are its aliases. Uploads that would
    give no row at all cannot become canonical and are ``empty``.
    """
    stored = collection.select("file_id").distinct().withColumn("_stored", F.lit(True))
    canonical = collection.where("is_search and content_hash <> ''").groupBy(F.lower("content_hash").alias("content_hash")).agg(F.min("file_id").alias("_canonical"))
    rows = incoming.select("seq", "file_id", F.coalesce("content_hash", F.lit("")).alias("content_hash"), "has_rows")
    # firsts by aggregation, which combines before it shuffles: one file may be uploaded any number of times
    turns = rows.where("has_rows").groupBy("file_id").agg(F.min("seq").alias("_turn"))
    fresh = rows.where("has_rows").join(turns, "file_id").where("seq = _turn").join(stored, "file_id", "left").where("_stored is null").join(canonical, "content_hash", "left")
    fresh = written(fresh.select("seq", "file_id", "content_hash", "_canonical"))
    firsts = fresh.where("content_hash <> ''").groupBy("content_hash").agg(F.min(F.struct("seq", "file_id")).alias("_f"))
    named = fresh.join(firsts, "content_hash", "left")
    first = F.col("_f").isNull() | (F.col("_f.seq") == F.col("seq"))
    settled = named.select("seq", F.when(F.col("_canonical").isNotNull() | ~first, F.lit("alias")).otherwise(F.lit("full")).alias("_a"),
                           F.when(F.col("_canonical").isNotNull(), F.col("_canonical")).when(~first, F.col("_f.file_id")).otherwise(F.col("file_id")).alias("_c"))
    return rows.join(settled, "seq", "left").select(
        "seq", "file_id", F.when(~F.col("has_rows"), F.lit("empty")).otherwise(F.coalesce("_a", F.lit("skip"))).alias("action"), F.col("_c").alias("canonical_file_id"))


def incoming_of(uploads: DataFrame) -> DataFrame:
    """Uploads as the cascade takes them: their own bytes' hash, and would any text or usable table come of them?

    The hash an upload states is not trusted: it may be missing, spelled otherwise or wrong. Without bytes there is none.
    """
    text = F.exists(F.coalesce("pages", F.array().cast("array<string>")), lambda p: p.isNotNull() & ~is_blank(p))
    tables = F.exists(F.coalesce("tables", F.array().cast("array<struct<page_number:int,data:array<array<string>>>>")), lambda t: F.size(t["data"]) > 1)
    return uploads.select("seq", "file_id", "filename", F.coalesce(content_hash(F.col("content")), F.lit("")).alias("content_hash"), (text | tables).alias("has_rows"))


def alias_rows(decided: DataFrame, incoming: DataFrame, width: int) -> DataFrame:
    """Rows that stand for a duplicate: not searchable, zero vector, parent id the file's own."""
    rows = decided.where("action = 'alias'").select("seq").join(incoming, "seq")
    return rows.select("file_id", F.col("file_id").alias("parent_id"), F.lit("parent").alias("hierarchy"), F.lit("text").alias("type"), "filename", "content_hash",
                       F.lit(False).alias("is_search"), F.lit("x").alias("contents"), F.array_repeat(F.lit(0.0).cast("float"), width).alias("dense_embedding"))


def scope(collection: DataFrame) -> DataFrame:
    """``(file_id, canonical_file_id)``: a searchable file stands for itself, an alias for the file with its hash."""
    files = collection.groupBy("file_id").agg(F.max("is_search").alias("searchable"), F.max("content_hash").alias("content_hash"))
    own = files.where("searchable").select("file_id", F.col("file_id").alias("canonical_file_id"))
    target = files.where("searchable and content_hash <> ''").groupBy("content_hash").agg(F.min("file_id").alias("canonical_file_id"))
    return own.unionByName(files.where("not searchable and content_hash <> ''").join(target, "content_hash").select("file_id", "canonical_file_id"))


def texts_of(collection: DataFrame) -> DataFrame:
    """``(canonical_file_id, text)``: a file's searchable text parents in order, joined by line breaks."""
    parents = collection.where("is_search and hierarchy = 'parent' and type = 'text'")
    return parents.groupBy(F.col("file_id").alias("canonical_file_id")).agg(
        F.array_sort(F.collect_list(F.struct("parent_id", "id", F.coalesce("contents", F.lit("")).alias("contents")))).alias("_p")).select(
        "canonical_file_id", F.array_join(F.transform("_p", lambda x: x["contents"]), "\n").alias("text"))


def document_text(collection: DataFrame) -> DataFrame:
    """``(file_id, text)`` of each file, an alias with the text of the file it stands for."""
    return scope(collection).join(texts_of(collection), "canonical_file_id").select("file_id", "text")
