"""Sinks: logs, archives, indices, key-value pairs, tables."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.cdc import latest_per_key
from millrace.sources import keyed
from millrace.sources.parsers import require_class


def to_log_json(df: DataFrame, key_col: str, value_cols: list[str]) -> DataFrame:
    """(key, value): the key column as text, the value columns as JSON."""
    return df.select(F.col(key_col).cast("string").alias("key"), F.to_json(F.struct(*value_cols)).alias("value"))


def encode_avro(df: DataFrame, schema: str, cols: list[str]) -> DataFrame:
    """The columns as one Avro value. Needs Spark's Avro package."""
    from pyspark.sql.avro.functions import to_avro

    require_class(df.sparkSession, "org.apache.spark.sql.avro.CatalystDataToAvro", "encoding Avro", "spark-avro")
    return df.select(to_avro(F.struct(*cols), schema).alias("value"))


def write_log(df: DataFrame, topic: str, path: str | None = None, servers: str | None = None, checkpoint: str | None = None):
    """Appends records to a topic, at least once: Kafka with servers, else a Parquet log under path.
    A stream returns its query, which ends when all there is has been written."""
    rows = df.withColumn("topic", F.lit(topic))
    if df.isStreaming:
        writer = rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        return writer.format("kafka").option("kafka.bootstrap.servers", servers).start() if servers else writer.format("parquet").option("path", path).start()
    if servers:
        require_class(df.sparkSession, "org.apache.spark.sql.kafka010.KafkaSourceProvider", "writing Kafka", "spark-sql-kafka")
        rows.write.format("kafka").option("kafka.bootstrap.servers", servers).save()
    else:
        rows.write.mode("append").parquet(path)
    return None


def upsert_by_key(df: DataFrame, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """Merges rows into a keyed table and returns it: the highest order of each key stays, so a repeated batch changes nothing.
    Only the buckets that the keys are in are rewritten."""

    def combine(current: DataFrame | None, new: DataFrame) -> DataFrame:
        both = new if current is None else current.unionByName(new, allowMissingColumns=True)
        return latest_per_key(both, keys, order)

    return keyed.merge(df, path, keys, combine)


def index_rows(df: DataFrame, key: str | None = None) -> DataFrame:
    """Documents with an _id: topic+partition+offset for appended records, or the key, of which the last offset stays."""
    if key is None:
        return df.withColumn("_id", F.concat_ws("+", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))).dropDuplicates(["_id"])
    return latest_per_key(df.withColumn("_id", F.col(key).cast("string")), ["_id"], "offset")


def write_index(df: DataFrame, path: str, key: str | None = None) -> DataFrame:
    """Adds documents to an index, or replaces those of the same _id by a later offset, and returns the index."""
    return upsert_by_key(index_rows(df, key), path, ["_id"], ["offset"])


#: The fields of an archived record.
ARCHIVE_FIELDS = ["key", "value", "offset", "timestamp", "headers"]
#: Files of a topic, day and partition that one task writes.
ARCHIVE_FILES = 64


def archive_log(df: DataFrame, path: str, max_records: int = 500) -> None:
    """Gzipped JSON under topic=/day=/partition=, at most max_records in a file."""
    rows = df.withColumn("day", F.date_format("timestamp", "yyyy-MM-dd"))
    fields = [c for c in ARCHIVE_FIELDS if c in df.columns]
    # A partition's day is cut into ranges of offsets, so that a busy one isn't one task's.
    piece = F.floor(F.col("offset") / (max_records * ARCHIVE_FILES))
    ordered = rows.select("topic", "day", "partition", *fields).repartition("topic", "day", "partition", piece).sortWithinPartitions("topic", "day", "partition", "offset")
    ordered.write.mode("append").partitionBy("topic", "day", "partition").option("maxRecordsPerFile", max_records).option("compression", "gzip").json(path)


def write_evolving(df: DataFrame, path: str) -> DataFrame:
    """Appends rows to a table that gains the columns it lacks; returns the whole table."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.option("mergeSchema", "true").parquet(path)


def write_table_stream(df: DataFrame, path: str, checkpoint: str, trigger: str | None = None):
    """A stream into a Parquet table; each trigger is one commit. Without a trigger it ends with what is there."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def to_kv(df: DataFrame, prefix: str, key: str, order: list[str]) -> DataFrame:
    """(key, value): prefix and key, the row as JSON; the last row of each key."""
    last = latest_per_key(df, [key], order)
    return last.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def split_dead_letter(df: DataFrame, decoded: str) -> tuple[DataFrame, DataFrame]:
    """(records that decoded, records that didn't)."""
    return df.where(F.col(decoded).isNotNull()), df.where(F.col(decoded).isNull())


def with_retry(fn: Callable[[DataFrame, int], None], retries: int = 3, wait: float = 1.0) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that is tried again after a failure; fn has to be idempotent for a batch id."""

    def run(batch: DataFrame, batch_id: int) -> None:
        for attempt in range(retries + 1):
            try:
                return fn(batch, batch_id)
            except Exception:
                if attempt == retries:
                    raise
                time.sleep(wait)

    return run


def write_points(df: DataFrame, path: str) -> None:
    """Time-series points (measurement, tags, fields, ts) by measurement and day."""
    df.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("measurement", "day").parquet(path)


def write_vectors(df: DataFrame, path: str, dim: int | None = None, vector_col: str = "vector") -> None:
    """Appends vectors; a vector of another length than dim raises."""
    rows = df
    if dim is not None:
        rows = df.withColumn(vector_col, F.when(F.size(vector_col) == dim, F.col(vector_col)).otherwise(F.raise_error(F.lit(f"a vector's length is not {dim}"))))
    rows.write.mode("append").parquet(path)


def write_sorted(df: DataFrame, path: str, order_by: list[str]) -> None:
    """Range-partitioned and sorted files, so that file and page statistics prune."""
    df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).write.mode("overwrite").parquet(path)


def to_event_envelope(df: DataFrame) -> DataFrame:
    """One JSON event for each record."""
    return df.select(F.to_json(F.struct(F.struct(*df.columns).alias("event"))).alias("value"))


def to_metric_series(df: DataFrame, metric: str, ts: str, value: str, host: str, width: str = "1 day") -> DataFrame:
    """(metric, host, payload) with the points of a metric and host within each time span in order of time, as a JSON payload.
    width bounds the points of a payload."""
    moment = F.col(ts).cast("timestamp")
    points = F.array_sort(F.collect_list(F.struct(F.unix_timestamp(moment).alias("timestamp"), F.col(value).alias("value"))))
    rows = df.groupBy(F.col(metric).alias("metric"), F.col(host).cast("string").alias("host"), F.window(moment, width).alias("span")).agg(points.alias("points"))
    series = F.struct("metric", "points", F.array(F.struct(F.col("host").alias("name"), F.lit("host").alias("type"))).alias("resources"))
    return rows.select("metric", "host", F.to_json(series).alias("payload"))
