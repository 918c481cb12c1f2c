"""Registered queries and the SQL that each is compared with."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ts as an instant and k from the props."""
    from pyspark.sql import functions as F

    rows = table(spark, sf_dir, "events")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("int"))


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-millrace-")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir. Where that is unset, as in tests, one of this process in
    local mode, where they are one; an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own_folder()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of rows that a task should get from a shuffle.
TASK_BYTES = 64 << 20


def spread(df: DataFrame, size: int, *keys: str) -> DataFrame:
    """df dealt by the keys, so that a task gets about TASK_BYTES of the ``size`` bytes; as it is where the session's own number of partitions does that."""
    parts = -(-size // TASK_BYTES)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


#: k of an event's props, in SQL.
K = "CAST(json_extract(props, '$.k') AS INTEGER)"
