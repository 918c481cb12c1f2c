"""Queries published as views or tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def publish_name(stem: str) -> str:
    """A name that no other query uses."""
    return f"{stem}_{uuid.uuid4().hex}"


def publish(spark: SparkSession, name: str, df: DataFrame, as_: str = "view", path: str | None = None) -> DataFrame:
    """Makes a query available by name: a view is evaluated at each use, a table is written now, under path where one is given."""
    if as_ == "view":
        df.createOrReplaceTempView(name)
    elif as_ == "table":
        writer = df.write.mode("overwrite")
        (writer.option("path", path) if path else writer).saveAsTable(name)
    else:
        raise ValueError("as_ is 'view' or 'table'")
    return spark.table(name)
