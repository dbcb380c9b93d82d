"""Folders that all executors share, and written tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Removes an execution's shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Settings of a write: also, what a task and its Python worker hold of rows at once.
WRITING = {SHUFFLE_CLEANUP: "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Only a local session, as in tests, gets a folder of its own when the setting is missing.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="vecspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """The session with these settings for a while."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: a lost executor costs no recomputation.

    The shuffle files of the write go with its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path = path or work_dir(spark, name)
    with settings(spark, WRITING):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """An operator's own tables in one folder of the shared one: each goes when it is of no more use."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, work_dir(spark, name)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, name, f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            drop_path(self.spark, f"{self.path}/{name}")

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """df written outside the folder, which goes."""
        out = written(df, name)
        drop_path(self.spark, self.path)
        return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of this session's own work."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
