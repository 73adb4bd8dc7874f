"""From uploads to collection rows: settle duplicates first, then cut and embed what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import content_hash
from docloom.models import Encoder, encoded
from docloom.operators import chunking, collection, tables
from docloom.runtime import written
from docloom.sources.uploads import page_text


def rows_of(docs: DataFrame, encoder: Encoder) -> DataFrame:
    """Collection rows of ``(file_id, filename, content_hash, pages, tables)``: parents, then children."""
    width = encoder.width
    text = docs.select("file_id", page_text(F.col("pages")).alias("text"))
    cut = written(chunking.text_rows(text))
    counts = cut.groupBy("file_id").agg((F.max("local") + 1).alias("n_text"))
    tab = tables.chunks(docs.select("file_id", "tables").where("tables is not null")).join(counts, "file_id", "left")
    pairs = cut.select("file_id", "local", F.lit("text").alias("type"), "parent", "child_ord", "child").unionByName(
        tab.select("file_id", (F.col("table_no") + F.coalesce("n_text", F.lit(0))).alias("local"), F.lit("table").alias("type"), "parent", F.col("row_no").alias("child_ord"), "child"))
    pairs = pairs.withColumn("parent_id", chunking.composed_id(F.col("file_id"), F.col("local"))).join(docs.select("file_id", "filename", "content_hash"), "file_id")
    common = ["file_id", "parent_id", "type", "filename", "content_hash"]
    zero = F.array_repeat(F.lit(0.0).cast("float"), width)
    # a parent comes from its first child, so that one without children is never stored
    parents = pairs.withColumn("_rn", F.expr("row_number() over (partition by parent_id order by child_ord)")).where("_rn = 1").select(
        *common, F.lit("parent").alias("hierarchy"), F.lit(0).alias("ord"), F.col("parent").alias("contents"), zero.alias("dense_embedding"))
    children = pairs.select(*common, F.lit("child").alias("hierarchy"), (F.col("child_ord") + 1).alias("ord"), F.col("child").alias("contents"), encoded(F.col("child"), encoder).alias("dense_embedding"))
    return parents.unionByName(children).withColumn("is_search", F.lit(True))


def ingested(uploads: DataFrame, stored: DataFrame, encoder: Encoder) -> DataFrame:
    """All rows a batch of uploads adds to the stored collection."""
    incoming = collection.incoming_of(uploads)
    decided = written(collection.cascade(incoming, stored))
    full = uploads.join(decided.where("action = 'full'").select("seq"), "seq", "left_semi")
    docs = full.select("file_id", "filename", F.coalesce(content_hash(F.col("content")), F.lit("")).alias("content_hash"), "pages", "tables")
    new = rows_of(docs, encoder)
    aliases = collection.alias_rows(decided, incoming, encoder.width).withColumn("ord", F.lit(0))
    keyed = new.unionByName(aliases)
    return keyed.withColumn("id", F.xxhash64("file_id", "parent_id", "hierarchy", "ord")).drop("ord")
