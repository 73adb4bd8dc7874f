"""Session helpers shared by every operator: where lineage is cut, and how."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share, as named in ``spark.checkpoint.dir``.

    Only where the setting is absent (unit tests, a laptop) is one chosen here, and only
    for a single-process ``local`` master: on a cluster a machine-local folder would not
    be readable by the other executors, so that is an error instead.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
    return sc.getCheckpointDir()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="docloom-ship-")  # read by the driver alone, which sends it on
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "docloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is already gone: the folder's owner cleans it
        pass


def written(df: DataFrame, *, partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder.

    Survives the loss of executors (the files are outside them), is columnar and
    compressed, and is removed when the session's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/docloom-{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's Parquet tables (a file or a folder of files)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
