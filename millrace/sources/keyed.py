"""Keyed tables in buckets: a change rewrites the buckets that its keys are in, and a manifest makes it visible at once.

A version is a folder that holds the buckets it rewrote. The manifest of a version says for every bucket which version's
folder has its rows. Readers take the newest manifest; folders that neither it nor the one before names are removed, so a
data frame of an older version loses its rows after two more merges.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a new table, and the most that a table gets: the manifest has a line for each, so their number bounds what the driver holds.
BUCKETS, MOST_BUCKETS = 16, 1 << 16
#: Bytes that a bucket should have, which bounds what a task rewrites.
BUCKET_BYTES = 32 << 20
MANIFESTS = "_manifests"

Combine = Callable[[DataFrame | None, DataFrame], DataFrame]


def _files(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, its path class)."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark._jsc.hadoopConfiguration()), of


def _names(spark: SparkSession, path: str) -> list[str]:
    files, of = _files(spark, path)
    return [s.getPath().getName() for s in files.listStatus(of(path))] if files.exists(of(path)) else []


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{path}/{MANIFESTS}/{version:08d}.json", wholetext=True).first()[0])


def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions, oldest first."""
    return sorted(int(n[:8]) for n in _names(spark, f"{path}/{MANIFESTS}") if n[:8].isdigit() and n.endswith(".json"))


def _rows(spark: SparkSession, path: str, manifest: dict, buckets: set[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(manifest["schema"])
    folders = [f"{path}/{folder}/_bucket={b}" for b, folder in manifest["folders"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table's rows; None before its first version."""
    found = versions(spark, path)
    return _rows(spark, path, _manifest(spark, path, found[-1])) if found else None


def _fitting(old: dict, bucket_bytes: int) -> int:
    """Buckets of the next version: as many as there are, or more where they hold over twice the bytes that they should."""
    size = sum(old.get("sizes", {}).values())
    buckets = old["buckets"]
    while size > 2 * buckets * bucket_bytes and buckets < MOST_BUCKETS:
        buckets *= 2
    return buckets


def _sizes(spark: SparkSession, folder: str) -> dict[str, int]:
    """Bytes of each bucket that a version wrote."""
    files, of = _files(spark, folder)
    if not files.exists(of(folder)):
        return {}
    return {n.split("=")[1]: files.getContentSummary(of(f"{folder}/{n}")).getLength() for n in _names(spark, folder) if n.startswith("_bucket=")}


def merge(df: DataFrame, path: str, keys: list[str], combine: Combine, buckets: int = BUCKETS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes a new version in which the rows of the touched buckets are combine(rows so far, df), and returns the table.
    combine decides by key, so that a batch which is merged again changes nothing.

    A table whose buckets have grown over twice bucket_bytes is written once with more of them; each later batch then rewrites the buckets of its keys alone, a
    task for each. The batch is kept while it is merged, as it is used twice. Where another writer has written the same version first, this one fails.
    """
    spark = df.sparkSession
    found = versions(spark, path)
    old = _manifest(spark, path, found[-1]) if found else None
    buckets = _fitting(old, bucket_bytes) if old else buckets
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket")
    df = df.persist()
    try:
        grown = old is not None and buckets != old["buckets"]
        touched = set(range(buckets)) if grown else {r[0] for r in df.select(bucket).distinct().collect()}
        version = found[-1] + 1 if found else 0
        folder = f"v{version:08d}"
        rows = combine(_rows(spark, path, old, None if grown else touched) if old else None, df)
        staged = f"{path}/.{folder}-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", bucket).repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(staged)
        kept = {} if grown else {b: f for b, f in (old["folders"] if old else {}).items() if int(b) not in touched}
        sizes = _sizes(spark, staged)
        new = {"buckets": buckets, "schema": rows.schema.jsonValue(), "folders": kept | dict.fromkeys(sizes, folder), "sizes": {b: n for b, n in (old or {}).get("sizes", {}).items() if b in kept} | sizes}
        _publish(spark, path, folder, staged, version, new)
    finally:
        df.unpersist()
    _clean(spark, path, [new] + ([old] if old else []), found[:-1])
    return _rows(spark, path, new)


def _publish(spark: SparkSession, path: str, folder: str, staged: str, version: int, manifest: dict) -> None:
    """Moves a version's folder to its place, which only the first writer of that version can do, and then its manifest."""
    files, of = _files(spark, path)
    files.mkdirs(of(f"{path}/{MANIFESTS}"))
    target, line = of(f"{path}/{folder}"), of(f"{path}/{MANIFESTS}/{version:08d}.json")
    if files.exists(line):
        files.delete(of(staged), True)
        raise RuntimeError(f"another writer has written version {version} of {path}")
    if files.exists(target):
        files.delete(target, True)  # of a writer that ended before its manifest
    draft = of(f"{path}/{MANIFESTS}/.{version:08d}.{uuid.uuid4().hex}.draft")
    stream = files.create(draft, True)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()
    if not files.rename(of(staged), target) or files.exists(line) or not files.rename(draft, line):
        raise RuntimeError(f"another writer has written version {version} of {path}")


def _clean(spark: SparkSession, path: str, used: list[dict], stale: list[int]) -> None:
    files, of = _files(spark, path)
    for version in stale:
        files.delete(of(f"{path}/{MANIFESTS}/{version:08d}.json"), False)
    live = {(folder, b) for m in used for b, folder in m["folders"].items()}
    for folder in (n for n in _names(spark, path) if n[:1] == "v" and n[1:].isdigit()):
        own = [n for n in _names(spark, f"{path}/{folder}") if n.startswith("_bucket=")]
        gone = [n for n in own if (folder, n.split("=")[1]) not in live]
        if len(gone) == len(own) and folder not in {f for m in used[:1] for f in m["folders"].values()}:
            files.delete(of(f"{path}/{folder}"), True)
        else:
            for n in gone:
                files.delete(of(f"{path}/{folder}/{n}"), True)
