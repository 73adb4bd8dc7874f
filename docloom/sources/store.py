"""The collection on disk and the replies' way out."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.config import ConfigError

SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("file_id", T.LongType()),
    T.StructField("parent_id", T.LongType()),
    T.StructField("hierarchy", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("is_search", T.BooleanType()),
    T.StructField("contents", T.StringType()),
    T.StructField("dense_embedding", T.ArrayType(T.FloatType())),
])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def ensure(spark: SparkSession, path: str) -> bool:
    """Create an empty collection where there is none; whether it did."""
    if _exists(spark, path):
        return False
    spark.createDataFrame([], SCHEMA).write.partitionBy("hierarchy").parquet(path)
    return True


def reset(spark: SparkSession, path: str) -> None:
    """Replace the collection by an empty one. All rows are lost."""
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").partitionBy("hierarchy").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    """Add rows, split by hierarchy, so that parent and child reads prune each other's files."""
    rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in SCHEMA.fields]).write.mode("append").partitionBy("hierarchy").parquet(path)


def hold_encoder(spark: SparkSession, path: str, name: str, width: int) -> None:
    """Remember the encoder a collection's vectors come from; another one or another width is an error from then on."""
    beside = f"{path.rstrip('/')}.encoder"
    if not _exists(spark, beside):
        spark.createDataFrame([(name, width)], "name string, width int").coalesce(1).write.json(beside)
        return
    held = spark.read.schema("name string, width int").json(beside).first()
    if (held["name"], held["width"]) != (name, width):
        raise ConfigError(f"the collection holds vectors of {held['name']} ({held['width']}), not of {name} ({width})")


def retried(read: Callable[[], DataFrame], wait_s: float = 1.0) -> DataFrame:
    """A read tried once more where planning it failed, as when a file was replaced meanwhile; tasks are retried by Spark."""
    try:
        return read()
    except Exception:
        time.sleep(wait_s)
        return read()


def addressed(replies: DataFrame, success_col: str = "success_url", error_col: str = "error_url") -> DataFrame:
    """Replies with the address theirs goes to: one for results, one for errors."""
    return replies.withColumn("callback_url", F.when(F.col("ok"), F.col(success_col)).otherwise(F.col(error_col)))


def send(replies: DataFrame, post: Callable[[str, str], None], *, attempts: int = 3, backoff_s: float = 1.0, url_col: str = "callback_url") -> DataFrame:
    """Post each reply, retrying with a growing pause; ``(task_id, sent, tries)``.

    A retried Spark task posts again, so receivers must take a task's id as the key.
    """
    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for url, task, body in zip(pdf[url_col], pdf["task_id"], pdf["payload"]):
                sent = False
                tries = 0
                while not sent and tries < attempts:
                    tries += 1
                    try:
                        post(url, body)
                        sent = True
                    except Exception:
                        if tries < attempts:
                            time.sleep(backoff_s * tries)
                out.append((task, sent, tries))
            yield pd.DataFrame(out, columns=["task_id", "sent", "tries"])

    return replies.select(url_col, "task_id", "payload").mapInPandas(run, "task_id string, sent boolean, tries int")
