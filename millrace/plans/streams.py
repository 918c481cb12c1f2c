"""Queries that run a stream over the tables' files until all is read, and return what its sink holds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import scalars
from millrace.operators import charts, windows
from millrace.plans import batch
from millrace.plans.cdc import APPLIED, REGION, changes, start_table
from millrace.plans.registry import K, events, new_folder, query, table
from millrace.plans.sources import log
from millrace.sources import readers, sinks
from millrace.streaming import stateful, streams


def event_stream(spark, sf_dir, path: str, parts: int = 4) -> DataFrame:
    """events, written as files in order of time and read one file at each trigger."""
    events(spark, sf_dir).repartitionByRange(parts, "event_id").sortWithinPartitions("event_id").write.parquet(f"{path}/in")
    schema = spark.read.parquet(f"{path}/in").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


#: Tasks that write a range of an ordered stream; a trigger reads as many files.
WRITERS = 8


def ordered_stream(spark, sf_dir, path: str, files: int = 4) -> DataFrame:
    """events as ranges of their ids that are written one after another, each by several tasks, and read in that order."""
    rows = events(spark, sf_dir)
    ends = rows.agg(F.min("event_id").alias("a"), F.max("event_id").alias("z")).first()
    for i in range(files):
        step = F.floor((F.col("event_id") - ends["a"]) * files / (ends["z"] - ends["a"] + 1))
        rows.where(step == i).repartition(WRITERS).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", WRITERS).parquet(f"{path}/in")


def close_stream(spark, sf_dir, path: str, days: int, event_type: str | None = None) -> None:
    """Appends a row of nobody from long after all others, which ends all waiting."""
    rows = events(spark, sf_dir)
    end = rows.agg((F.max("ts") + F.expr(f"interval {days} days")).alias("ts"))
    closing = spark.createDataFrame([], rows.schema).unionByName(end, allowMissingColumns=True)
    closing.withColumns({"user_id": F.lit(-1).cast(rows.schema["user_id"].dataType), "event_type": F.lit(event_type).cast("string")}).write.mode("append").parquet(f"{path}/in")


def drained(spark, stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    streams.drain(stream, streams.write_batch(f"{path}/out"), f"{path}/check", mode)
    return spark.read.parquet(f"{path}/out").drop("batch")


@query(batch.PRICE_RANGE)
def price_range_stream(spark, sf_dir):
    """In update mode: a window's last version counts."""
    path = new_folder(spark, "price")
    windowed = windows.price_range(batch.ticks(event_stream(spark, sf_dir, path)).withWatermark("ts", "30 days"), "1 hour")
    streams.drain(windowed, streams.write_batch(f"{path}/out"), f"{path}/check", "update")
    rows = spark.read.parquet(f"{path}/out")
    last = rows.groupBy("window_start", "symbol").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "batch"]), "batch").alias("r")).select("r.*")
    return batch.shown(last)


@query(batch.LOGIN_AUDIT)
def login_audit_stream(spark, sf_dir):
    """Two aggregations in a chain; windows come out as the watermark passes them, the last ones after a closing row."""
    path = new_folder(spark, "audit")
    logs = batch.logs(ordered_stream(spark, sf_dir, path)).withWatermark("ts", "1 hour")
    write = streams.upsert_batches(f"{path}/out", ["user_id", "window_start"], ["login_attempts"])
    windowed = windows.login_audit(logs, "1 day", action="click")
    streams.drain(windowed, write, f"{path}/check", "append")
    close_stream(spark, sf_dir, path, 9, "click")
    streams.drain(windowed, write, f"{path}/check", "append")
    return batch.audit_shown(streams.serve(spark, f"{path}/out"))


@query("SELECT event_id, upper(event_type) AS value FROM events")
def capitalize_stream(spark, sf_dir):
    path = new_folder(spark, "capital")
    stream = event_stream(spark, sf_dir, path).select("event_id", F.col("event_type").alias("value"))
    return drained(spark, streams.capitalize(stream), path)


@query("SELECT event_id AS \"offset\", event_type AS topic FROM events WHERE event_type <> 'error'")
def replicate_stream(spark, sf_dir):
    path = new_folder(spark, "replica")
    log(spark, sf_dir).repartition(3, "partition").write.parquet(f"{path}/in")
    stream = readers.read_log(spark, [], f"{path}/in", schema=spark.read.parquet(f"{path}/in").schema, max_files=1)
    return drained(spark, streams.replicate(stream, [".*"], ["err.*"]), path).select("offset", "topic")


@query(batch.BREACH)
def breach_stream(spark, sf_dir):
    """Rows are released as the watermark, an hour behind the newest one, passes them; a last row from long after ends the waiting."""
    path = new_folder(spark, "breach")
    stream = ordered_stream(spark, sf_dir, path)
    with stateful.rocksdb(spark):
        breaches = stateful.breach_stream(stream, 60, 3, "1 hour")
        streams.drain(breaches, streams.write_batch(f"{path}/out"), f"{path}/check")
        close_stream(spark, sf_dir, path, 90)
        streams.drain(breaches, streams.write_batch(f"{path}/out"), f"{path}/check")
    return spark.read.parquet(f"{path}/out").select("event_id", "user_id", F.col("counter").cast("long"), "fires")


@query(f"""WITH c AS (SELECT user_id, ts, 'g' || CAST({K} % 4 AS VARCHAR) AS genre, {K} % 5 = 0 AS gone FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view')
    SELECT v.event_id, v.user_id, CASE WHEN c.gone THEN NULL ELSE c.genre END AS genre FROM v ASOF LEFT JOIN c ON v.user_id = c.user_id AND v.ts >= c.ts""")
def changelog_join_stream(spark, sf_dir):
    """Views with the genre that their user had at that time: the users' table is a stream of changes and deletions, which its purchases make."""
    path = new_folder(spark, "changelog")
    read = ordered_stream(spark, sf_dir, path)
    views = read.where("event_type = 'view' or user_id = -1").select("ts", "event_id", "user_id")
    stream = ordered_stream(spark, sf_dir, f"{path}/table").where("event_type = 'purchase' or user_id = -1")
    changes = stream.select("ts", "user_id", F.concat(F.lit("g"), (F.col("k") % 4).cast("string")).alias("genre"), F.col("event_id").alias("offset"), (F.col("k") % 5 == 0).alias("deleted"))
    with stateful.rocksdb(spark):
        joined = stateful.changelog_join(views, changes, "user_id", "1 hour", shards=2)
        streams.drain(joined, streams.write_batch(f"{path}/out"), f"{path}/check")
        for folder in (path, f"{path}/table"):
            close_stream(spark, sf_dir, folder, 90)
        streams.drain(joined, streams.write_batch(f"{path}/out"), f"{path}/check")
    return spark.read.parquet(f"{path}/out").select("event_id", "user_id", "genre")


RETRACTED = f"""WITH s AS (SELECT user_id AS song_id, arg_max(CASE WHEN {K} % 9 = 0 THEN '-' ELSE 'g' || CAST({K} % 4 AS VARCHAR) END, event_id) AS genre FROM events WHERE event_type = 'purchase' GROUP BY 1),
    p AS (SELECT user_id AS song_id, count(*) AS plays FROM events WHERE event_type <> 'purchase' GROUP BY 1), c AS (SELECT genre, song_id, plays FROM s JOIN p USING (song_id) WHERE genre <> '-')"""


def _retracted(spark, sf_dir) -> DataFrame:
    """Charts of a stream in which songs change their genre and are deleted again and again."""
    path = new_folder(spark, "retracted")
    rows = ordered_stream(spark, sf_dir, path)
    genre = F.when(F.col("k") % 9 != 0, F.concat(F.lit("g"), (F.col("k") % 4).cast("string")))
    songs = rows.where("event_type = 'purchase'").select(F.col("user_id").alias("song_id"), genre.alias("genre"), F.col("event_id").alias("version"))
    plays = rows.where("event_type <> 'purchase'").select(F.col("user_id").alias("song_id"))
    with stateful.rocksdb(spark):
        streams.drain(stateful.retracting_charts(plays, songs, 5, 4), streams.retracting_chart_batches(f"{path}/out"), f"{path}/check")
    return streams.retracting_chart(spark, f"{path}/out", 5)


@query(f"{RETRACTED} SELECT genre, CAST(rank AS INTEGER) AS rank, song_id, plays FROM (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY plays DESC, song_id) AS rank FROM c) WHERE rank <= 5")
def retraction_chart_stream(spark, sf_dir):
    """One stateful operator counts and sends pairs of old and new, a second keeps the charts."""
    return _retracted(spark, sf_dir).where(F.col("chart") != stateful.ALL).select(F.col("chart").alias("genre"), "rank", "song_id", "plays")


@query(f"{RETRACTED} SELECT CAST(row_number() OVER (ORDER BY plays DESC, song_id) AS INTEGER) AS rank, song_id, plays FROM c ORDER BY plays DESC, song_id LIMIT 5")
def retraction_chart_stream_all(spark, sf_dir):
    """The chart of all songs, from the same state."""
    return _retracted(spark, sf_dir).where(F.col("chart") == stateful.ALL).select("rank", "song_id", "plays")


TOP = """WITH c AS (SELECT event_type AS genre, user_id AS song_id, count(*) AS plays FROM events GROUP BY 1, 2)
    SELECT genre, CAST(rank AS INTEGER) AS rank, song_id, plays FROM (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY plays DESC, song_id) AS rank FROM c) WHERE rank <= 5"""


def _charts(spark, sf_dir) -> str:
    """The folder of the charts of all shards, kept by a stream."""
    path = new_folder(spark, "charts")
    with stateful.rocksdb(spark):
        plays = event_stream(spark, sf_dir, path).select(F.col("event_type").alias("genre"), F.col("user_id").alias("song_id"))
        streams.drain(stateful.top_n_stream(plays, 5, 4), streams.shard_charts(f"{path}/out"), f"{path}/check", "update")
    return f"{path}/out"


@query(TOP)
def top_n_stream(spark, sf_dir):
    """The state of each genre's shard holds its counts and its chart."""
    return streams.chart(spark, _charts(spark, sf_dir), 5).select("genre", "rank", "song_id", "plays")


@query("SELECT event_type AS genre, user_id AS song_id, count(*) AS plays FROM events GROUP BY 1, 2 ORDER BY plays DESC, song_id, genre LIMIT 5")
def top_n_stream_all(spark, sf_dir):
    """The global chart, from the same state."""
    return streams.chart(spark, _charts(spark, sf_dir), 5, by_genre=False)


@query(TOP)
def chart_batches_stream(spark, sf_dir):
    """Counts of each batch are added to a table, which is ranked when it is read."""
    path = new_folder(spark, "counts")
    plays = event_stream(spark, sf_dir, path).select(F.col("event_type").alias("genre"), F.col("user_id").alias("song_id"))
    streams.drain(plays, sinks.with_retry(streams.chart_batches(f"{path}/out")), f"{path}/check")
    return streams.charts(spark, f"{path}/out")[0].select("genre", "rank", "song_id", "plays")


@query("SELECT event_id, user_id, lower(p_type) AS genre FROM events JOIN part ON user_id = p_partkey WHERE event_type = 'view'")
def stream_table_join(spark, sf_dir):
    path = new_folder(spark, "enriched")
    songs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("user_id"), F.lower("p_type").alias("genre"))
    stream = event_stream(spark, sf_dir, path).where("event_type = 'view'").select("event_id", "user_id")
    return drained(spark, charts.enrich(stream, songs, "user_id").where("genre is not null"), path).select("event_id", "user_id", "genre")


@query("SELECT user_id, count(*) AS rows, CAST(ceil(count(*) / 5.0) AS BIGINT) AS batches, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY user_id")
def key_ordered(spark, sf_dir):
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["event_id"].to_numpy()
        assert (ids[1:] >= ids[:-1]).all()
        return pd.DataFrame({"user_id": [rows["user_id"].iloc[0]], "n": [len(ids)], "first": [ids[0]], "last": [ids[-1]]})

    out = streams.process_by_key(events(spark, sf_dir).select("user_id", "event_id"), "user_id", ["event_id"], one, "user_id long, n long, first long, last long", 5, 8)
    return out.groupBy("user_id").agg(F.sum("n").alias("rows"), F.count("*").alias("batches"), F.min("first").alias("first"), F.max("last").alias("last"))


def change_stream(spark, sf_dir, path: str) -> DataFrame:
    """The change log as files of ranges of its positions, read one at each trigger; which comes first is up to the file system."""
    changes(spark, sf_dir).repartitionByRange(3, "lsn").write.parquet(f"{path}/in")
    return spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


@query(APPLIED)
def cdc_apply_stream(spark, sf_dir):
    path = new_folder(spark, "cdc")
    write = streams.cdc_batches(f"{path}/table", ["id", "region", "total"], ["id"], ["lsn"], start_table(spark, sf_dir))
    streams.drain(change_stream(spark, sf_dir, path), sinks.with_retry(write), f"{path}/check")
    return streams.current_table(spark, f"{path}/table")


@query(REGION)
def cdc_view_stream(spark, sf_dir):
    """The view of a region, kept up to date batch by batch."""
    path = new_folder(spark, "view")
    write = streams.view_batches(f"{path}/view", 1, ["id"], ["id", "region", "total"], ["lsn"])
    streams.drain(change_stream(spark, sf_dir, path), sinks.with_retry(write), f"{path}/check")
    return streams.current_view(spark, f"{path}/view", ["id", "region", "total"])


@query(batch.SUSPICIOUS)
def suspicious_logins_stream(spark, sf_dir):
    """Logins as a stream, the audit as a table that each batch reads."""
    path = new_folder(spark, "logins")
    stream = event_stream(spark, sf_dir, path).where("event_type = 'error'")
    out = drained(spark, windows.suspicious_logins(stream, batch.last_audit(events(spark, sf_dir))), path)
    return out.select("event_id", "user_id", "event_type", "distinct_ips")


@query("""SELECT event_type AS source, 'u' || CAST(user_id % 3 AS VARCHAR) AS target, count(*) AS beats, CAST(floor(epoch_us(max(ts)) / 1000) AS BIGINT) AS last_ts FROM events GROUP BY 1, 2""")
def heartbeat_stream(spark, sf_dir):
    """Number and time of the last beat of each pair, as the stream goes on."""
    path = new_folder(spark, "beats")
    beats = batch.beats(event_stream(spark, sf_dir, path)).groupBy("source", "target").agg(F.count("*").alias("beats"), F.max("ts").alias("last_ts"))
    streams.drain(beats, streams.upsert_batches(f"{path}/out", ["source", "target"], ["beats"]), f"{path}/check", "update")
    return streams.serve(spark, f"{path}/out")


@query("""WITH h AS (SELECT CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS t, event_type AS source, 'u' || CAST(user_id % 3 AS VARCHAR) AS target FROM events),
    g AS (SELECT *, lead(t) OVER (PARTITION BY source, target ORDER BY t) AS n FROM h)
    SELECT source, target, 'alarm' AS kind, t AS last_ts, t + 7200000 AS at FROM g WHERE n IS NULL OR n - t > 7200000 UNION ALL SELECT source, target, 'back', t, n FROM g WHERE n - t > 7200000""")
def heartbeat_alarm_stream(spark, sf_dir):
    """An alarm two hours after the last beat of a pair, and the beat that ends it."""
    path = new_folder(spark, "alarms")
    rows = ordered_stream(spark, sf_dir, path)
    beats = rows.select("ts", F.coalesce("event_type", F.lit("-")).alias("source"), F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("target"))
    with stateful.rocksdb(spark):
        alarms = stateful.absence_alarms(beats, 7_200_000, "1 hour", span_ms=3_600_000)
        streams.drain(alarms, streams.write_batch(f"{path}/out"), f"{path}/check")
        close_stream(spark, sf_dir, path, 90)
        streams.drain(alarms, streams.write_batch(f"{path}/out"), f"{path}/check")
    return spark.read.parquet(f"{path}/out").where("source <> '-'").select("source", "target", "kind", "last_ts", "at")


@query("SELECT user_id, b AS batch, CAST(least(5, n - 5 * b) AS BIGINT) AS rows FROM (SELECT user_id, n, unnest(range((n + 4) // 5)) AS b FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1))")
def count_or_time_stream(spark, sf_dir):
    """Batches of five rows of a user, filled across micro-batches and a restart; what is left goes out when its time is over."""
    path = new_folder(spark, "buffered")
    rows = ordered_stream(spark, sf_dir, path).select("ts", "user_id", "event_id")
    with stateful.rocksdb(spark):
        out = stateful.buffered(rows, "user_id", 5, 400 * 86_400_000, "1 hour")
        streams.drain(out, streams.write_batch(f"{path}/out"), f"{path}/check")
        close_stream(spark, sf_dir, path, 900)
        streams.drain(out, streams.write_batch(f"{path}/out"), f"{path}/check")
    sent = spark.read.parquet(f"{path}/out").drop_duplicates(["event_id"]).where("user_id >= 0")
    return sent.groupBy("user_id", F.col("sent_batch").alias("batch")).agg(F.count("*").alias("rows"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def processing_time_stream(spark, sf_dir):
    """Rows by the hour in which they are processed; none can be late, so the watermark has no delay. The counts of a user's hours add up."""
    path = new_folder(spark, "stamped")
    stamped = scalars.stamp(event_stream(spark, sf_dir, path).select("user_id")).withWatermark("now", "0 seconds")
    counts = stamped.groupBy(F.window("now", "1 hour").alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")
    streams.drain(counts, streams.upsert_batches(f"{path}/out", ["start", "user_id"], ["n"]), f"{path}/check", "update")
    return streams.serve(spark, f"{path}/out").groupBy("user_id").agg(F.sum("n").alias("n"))


@query("SELECT user_id, count(*) AS rows, true AS bounded FROM events GROUP BY user_id")
def count_batches_stream(spark, sf_dir):
    """Each micro-batch in chunks of at most five rows of a user."""
    path = new_folder(spark, "counted")
    streams.drain(event_stream(spark, sf_dir, path).select("user_id", "event_id"), streams.count_batches(f"{path}/out", "user_id", ["event_id"], 5), f"{path}/check")
    chunks = spark.read.parquet(f"{path}/out").groupBy("user_id", "batch", "chunk").agg(F.count("*").alias("n"))
    return chunks.groupBy("user_id").agg(F.sum("n").alias("rows"), (F.max("n") <= 5).alias("bounded"))


@query("SELECT event_id, reverse(event_type) AS event_type, value * 2 AS value FROM events")
def map_column_stream(spark, sf_dir):
    """A column by an expression, another by a pandas function."""
    path = new_folder(spark, "mapped")
    stream = event_stream(spark, sf_dir, path).select("event_id", "event_type", "value")
    turned = streams.map_column(streams.map_column(stream, "value", lambda c: c * 2), "event_type", _reversed, "string")
    return drained(spark, turned, path)


def _reversed(names: pd.Series) -> pd.Series:
    return names.str[::-1]


@query("SELECT event_id, value FROM events")
def restart_no_duplicates(spark, sf_dir):
    """Half of the files, then a new query on the same checkpoint with the rest; the last batch is written twice."""
    path = new_folder(spark, "restart")
    rows = events(spark, sf_dir).select("event_id", "value")
    rows.where("event_id % 2 = 0").repartition(2).write.parquet(f"{path}/in")
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    write = streams.write_batch(f"{path}/out")

    def twice(frame: DataFrame, batch_id: int) -> None:
        write(frame, batch_id)
        write(frame, batch_id)

    streams.drain(stream(), twice, f"{path}/check")
    rows.where("event_id % 2 = 1").repartition(2).write.mode("append").parquet(f"{path}/in")
    streams.drain(stream(), twice, f"{path}/check")
    return spark.read.parquet(f"{path}/out").select("event_id", "value")


@query("SELECT event_id, event_type FROM events")
def table_stream(spark, sf_dir):
    path = new_folder(spark, "table")
    stream = event_stream(spark, sf_dir, path).select("event_id", "event_type")
    sinks.write_table_stream(stream, f"{path}/out", f"{path}/check").awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("SELECT event_id, event_type FROM events")
def restore_archive(spark, sf_dir):
    """Archived records go into an index again, each with an id of its own; a second time adds nothing."""
    path = new_folder(spark, "restore")
    sinks.archive_log(log(spark, sf_dir), f"{path}/archive")
    restore = lambda: streams.restore_logs(spark, f"{path}/archive", f"{path}/index", "key string, value string, offset long, timestamp timestamp")
    restore()
    back = restore()
    return back.select(F.col("offset").alias("event_id")).join(events(spark, sf_dir).select("event_id", "event_type"), "event_id")
