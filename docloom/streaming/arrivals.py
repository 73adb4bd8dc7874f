"""Uploads as a stream of files: each micro-batch goes through the same ingest as a table would."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from docloom.models import Encoder
from docloom.operators.ingest import ingested
from docloom.sources import store


def uploads_stream(spark: SparkSession, path: str, schema: StructType, *, files_per_batch: int = 500) -> DataFrame:
    """New Parquet files of uploads, at most so many a batch: the admission limit of a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def start(stream: DataFrame, target: str, checkpoint: str, encoder: Encoder, *, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Ingest each batch into the collection at ``target``.

    A batch that is run again finds its files stored and skips them, so replays add nothing.
    """
    def ingest(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store.ensure(spark, target)
        rows = ingested(batch, store.read(spark, target), encoder)
        store.append(rows, target)
        if after is not None:
            after(batch, number)

    return stream.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, *, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type, with a watermark; works on a stream and on a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("window.start").alias("window_start"), "event_type", "n", "total")
