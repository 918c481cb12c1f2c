"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that a task should get from a shuffle.
TASK_BYTES = 64 << 20


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-millrace-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session sets it. Where it is unset, as in tests, a folder of this process in local mode,
    where driver and executors are one; an error on a cluster, where no other folder is known to be shared."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_folder()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: lineage ends there and a lost
    executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder of its own in the shared one for tables that are only needed until a result is written; close(), or the end of a with block,
    removes it and the catalogue tables named in ``tables``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.tables = spark, new_path(spark, name), []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def new_path(self, name: str) -> str:
        return f"{self.path}/{name}-{uuid.uuid4().hex}"

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = self.new_path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def partitions_for(spark: SparkSession, size: int) -> int:
    """Partitions of a shuffle of so many bytes: as the session sets it, or more where tasks would get more than TASK_BYTES."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
