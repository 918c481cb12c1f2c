"""Stream operators on log records, and draining a stream into a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.cdc import cdc_image, cdc_ops, current_rows, first_versions, key_events, latest_per_key, merge_versions
from millrace.operators.charts import top_n
from millrace.operators.transforms import select_topics
from millrace.operators.windows import chunk
from millrace.sources.readers import read_archive
from millrace.sources import keyed
from millrace.sources.sinks import upsert_by_key


def capitalize(stream: DataFrame, col: str = "value") -> DataFrame:
    """Upper-case values; stateless."""
    return stream.withColumn(col, F.upper(F.col(col).cast("string")))


def map_column(df: DataFrame, col: str, fn: Callable[[Column], Column] | Callable[[pd.Series], pd.Series], returns: str | None = None) -> DataFrame:
    """Maps a column by a column expression, or by a pandas function where a return type is given."""
    if returns is None:
        return df.withColumn(col, fn(F.col(col)))
    return df.withColumn(col, F.pandas_udf(fn, returns)(F.col(col)))


def replicate(stream: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """The records of the chosen topics with their key, headers, partition and offset."""
    return select_topics(stream, include, exclude)


#: Results of calls that go out as one frame.
RESULTS = 1024


def process_by_key(df: DataFrame, key: str, order: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch: int = 5, partitions: int | None = None) -> DataFrame:
    """Calls fn with up to batch consecutive rows of a key, in order. Keys are spread over partitions, and a partition
    streams through its rows, so a key with many rows isn't gathered."""
    ordered = (df.repartition(partitions, key) if partitions else df.repartition(key)).sortWithinPartitions(key, *order)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for part in parts:
            rows = part if held is None else pd.concat([held, part], ignore_index=True)
            if rows.empty:
                continue
            # A key's rows are together, a null key's too.
            values = rows[key]
            new = ~((values == values.shift()) | (values.isna() & values.shift().isna())).to_numpy(bool)
            new[0] = True
            at = np.arange(len(rows))
            starts = np.flatnonzero((at - np.maximum.accumulate(np.where(new, at, 0))) % batch == 0)
            ends = np.r_[starts[1:], len(rows)]
            done = len(starts) - (ends[-1] - starts[-1] < batch)
            # What is left may go on in the next rows. Results go out together: a frame for each call costs more than most calls.
            held = rows.iloc[starts[-1] :] if done < len(starts) else None
            for i in range(0, done, RESULTS):
                yield pd.concat([fn(rows.iloc[a:z]) for a, z in zip(starts[i : min(done, i + RESULTS)], ends[i : min(done, i + RESULTS)], strict=True)], ignore_index=True)
        if held is not None and len(held):
            yield fn(held)

    return ordered.mapInPandas(run, schema)


def as_table(changelog: DataFrame, key: str = "key", order: str = "offset", value: str = "value") -> DataFrame:
    """The table behind a changelog: the last value of each key; a null value deletes."""
    return latest_per_key(changelog, [key], order, F.col(value).isNull())


def drain(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all there is, handing each micro-batch to write."""
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each batch to its own folder: a batch that is run again replaces itself."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def upsert_batches(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    return lambda batch, batch_id: upsert_by_key(batch, path, keys, order) and None


def cdc_batches(path: str, cols: list[str], keys: list[str] | None, order: list[str], start: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """Applies each batch of changes to a keyed table that holds the last change of each key, deletions too. Batches may
    come in any order, and twice. start: the table from before all changes. current_table() reads the result."""
    keys = keys or cols

    def write(batch: DataFrame, batch_id: int) -> None:
        events = key_events(batch, cols, keys, order)
        if start is not None and not keyed.versions(batch.sparkSession, path):
            keyed.merge(first_versions(start, keys, events), path, keys, lambda _, new: new)
        keyed.merge(events, path, keys, lambda state, new: merge_versions(state, new, keys))

    return write


def current_table(spark: SparkSession, path: str) -> DataFrame:
    """The table behind the changes that cdc_batches applied."""
    return current_rows(keyed.read(spark, path))


def view_batches(path: str, region: int, keys: list[str], cols: list[str], version: list[str]) -> Callable[[DataFrame, int], None]:
    """Keeps the view of one region: each batch's changes are merged into the buckets of their keys, in any order. current_view() reads it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = cdc_ops(batch).select(*cdc_image(batch, cols), "op", *version).where(F.col("region") == region)
        upsert_by_key(rows, path, keys, version)

    return write


def current_view(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    return keyed.read(spark, path).where("op <> 'd'").select(*cols)


def chart_batches(path: str, n: int = 5) -> Callable[[DataFrame, int], None]:
    """Adds each batch's plays (genre, song_id) to a count table; charts() ranks it. Old counts leave the chart as new ones enter.

    Batches already counted are known by their id, so a repeated batch isn't counted twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        new = batch.groupBy("genre", "song_id").agg(F.count("*").alias("plays")).withColumn("batch", F.lit(batch_id))
        new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def charts(spark: SparkSession, path: str, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(by genre, overall) as the counts are now."""
    counts = spark.read.parquet(path).groupBy("genre", "song_id").agg(F.sum("plays").alias("plays"))
    order = [F.desc("plays"), F.asc("song_id")]
    return top_n(counts, ["genre"], order, n), counts.orderBy(*order).limit(n)


def serve(spark: SparkSession, path: str) -> DataFrame:
    """The state of a stream as its sink holds it."""
    rows = keyed.read(spark, path)
    return spark.read.parquet(path) if rows is None else rows


def shard_charts(path: str) -> Callable[[DataFrame, int], None]:
    """Keeps the newest chart of each genre and shard (see stateful.top_n_stream); chart() ranks them together."""

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_by_key(batch.withColumn("batch", F.lit(batch_id)), path, ["genre", "shard", "rank"], ["batch"])

    return write


def chart(spark: SparkSession, path: str, n: int = 5, by_genre: bool = True) -> DataFrame:
    """The n most played songs, of each genre or of all: they are among the n of their shards."""
    rows = keyed.read(spark, path).select("genre", "song_id", "plays")
    order = [F.desc("plays"), F.asc("song_id")]
    if by_genre:
        return top_n(rows, ["genre"], order, n)
    return rows.orderBy(*order, "genre").limit(n)


def retracting_chart_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Keeps the newest first rows of each shard of the charts of stateful.retracting_charts; retracting_chart() ranks them together."""

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_by_key(batch.withColumn("batch", F.lit(batch_id)), path, ["chart", "shard", "rank"], ["batch"])

    return write


def retracting_chart(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    """(chart, rank, song_id, plays) of every chart as it is now."""
    rows = keyed.read(spark, path).where("song_id is not null").select("chart", "song_id", "plays")
    return top_n(rows, ["chart"], [F.desc("plays"), F.asc("song_id")], n)


def count_batches(path: str, key: str, order: list[str], n: int) -> Callable[[DataFrame, int], None]:
    """Cuts each micro-batch into chunks of at most n rows of a key, which go out together; the rest goes out at its end."""

    def write(batch: DataFrame, batch_id: int) -> None:
        chunk(batch, key, order, n).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def restore_logs(spark: SparkSession, path: str, dest: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Adds archived records to an index under ids of their own, and returns it. An id comes from the archive's file, the record and its number among equal
    ones of that file, so equal records stay apart and restoring twice adds nothing."""
    records = read_archive(spark, path, schema)
    hashed = records.withColumn("_record", F.sha2(F.concat_ws("\n", F.input_file_name(), F.to_json(F.struct(*records.columns))), 256))
    # Equal records are alike, so it doesn't matter which of them gets which number.
    numbered = hashed.withColumn("_n", F.row_number().over(Window.partitionBy("_record").orderBy(F.lit(0))))
    return upsert_by_key(numbered.withColumn("_id", F.concat_ws("-", "_record", "_n")).drop("_record", "_n"), dest, ["_id"], ["_id"])
