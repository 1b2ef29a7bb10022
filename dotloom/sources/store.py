"""Folders that the driver and all executors share."""

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local session gets a folder of its own, removed at exit, and a cluster ValueError."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="dotloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; what is written there is deleted at exit."""
    path = f"{shared_folder(spark)}/dotloom-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


class Kept:
    """A table written once: ``df`` reads it, ``drop()`` deletes it; it goes at exit at the latest."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, scratch(df.sparkSession, name)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def kept(df: DataFrame, name: str = "table") -> Kept:
    """Cuts lineage: the table is written to the shared folder, so that a lost executor loses nothing, and none of it is computed again."""
    return Kept(df, name)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder; a missing one is no error."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass
