"""Queries on sources, parsers and sinks; sinks are written to a new shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.cdc import latest_per_key
from millrace.plans.batch import TABLES
from millrace.plans.registry import K, events, new_folder, query, table
from millrace.sources import parsers, readers, sinks


def log(spark, sf_dir) -> DataFrame:
    """events as log records: the topic is the type, the partition the user modulo 3."""
    ev = events(spark, sf_dir)
    return ev.select(
        F.col("event_type").alias("topic"), (F.col("user_id") % 3).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.col("ts").alias("timestamp"),
        F.col("user_id").cast("string").alias("key"), F.to_json(F.struct("event_id", "user_id", "value")).alias("value"),
    )


@query("SELECT event_id, user_id, value, event_type AS measurement, CAST(user_id AS VARCHAR) AS host, epoch_us(ts) * 1000 AS ts FROM events")
def line_protocol(spark, sf_dir):
    ev = events(spark, sf_dir)
    line = F.concat(F.col("event_type"), F.lit(",host="), F.col("user_id").cast("string"), F.lit(" value="), F.col("value").cast("string"), F.lit(",id="), F.col("event_id").cast("string"), F.lit("i "), (F.unix_micros("ts") * 1000).cast("string"))
    points = parsers.parse_line_protocol(ev.select(line.alias("value")))
    return points.select(F.col("fields")["id"].cast("long").alias("event_id"), F.col("tags")["host"].cast("long").alias("user_id"), F.col("fields")["value"].alias("value"), "measurement", F.col("tags")["host"].alias("host"), "ts")


@query("SELECT event_id, value FROM events WHERE event_type = 'view'")
def exposition_parse(spark, sf_dir):
    ev = events(spark, sf_dir)
    cpu = F.when(F.col("event_type") == "view", "cpu-total").otherwise(F.col("event_type"))
    line = F.when(F.col("event_id") % 50 == 1, F.lit("# HELP a comment")).otherwise(F.concat(F.lit('cpu_usage_idle{cpu="'), cpu, F.lit('",id="'), F.col("event_id").cast("string"), F.lit('"} '), F.col("value").cast("string")))
    comments = ev.where("event_id % 50 = 1").select(F.concat(F.lit('cpu_usage_idle{cpu="'), cpu, F.lit('",id="'), F.col("event_id").cast("string"), F.lit('"} '), F.col("value").cast("string")).alias("value"))
    rows = parsers.parse_exposition(ev.select(line.alias("value")).unionByName(comments))
    return rows.where(F.col("labels")["cpu"] == "cpu-total").select(F.col("labels")["id"].cast("long").alias("event_id"), "value")


@query("""SELECT event_type AS "group", 'topic-' || CAST(user_id % 4 AS VARCHAR) AS topic, event_id AS current_offset FROM events WHERE user_id % 9 <> 0""")
def group_describe(spark, sf_dir):
    from millrace.functions.scalars import safe_offset

    ev = events(spark, sf_dir)
    offset = F.when(F.col("user_id") % 9 == 0, "-").otherwise(F.col("event_id").cast("string"))
    line = F.concat_ws("   ", F.col("event_type"), F.concat(F.lit("topic-"), (F.col("user_id") % 4).cast("string")), (F.col("user_id") % 3).cast("string"), offset, F.lit("99999"), F.lit("0"), F.lit("consumer-1"))
    lines = ev.select(line.alias("value")).unionByName(ev.limit(1).select(F.lit("GROUP TOPIC PARTITION CURRENT-OFFSET LOG-END-OFFSET LAG CONSUMER-ID").alias("value")))
    rows = parsers.parse_group_describe(lines).withColumn("current_offset", safe_offset("current_offset"))
    return rows.where("current_offset is not null").select("group", "topic", "current_offset")


@query("SELECT 'perf-' || event_type AS metric, count(*) AS n, round(sum(CASE WHEN user_id % 10 = 0 THEN 0 ELSE value END), 4) AS total FROM events GROUP BY 1")
def perf_metrics(spark, sf_dir):
    value = F.when(F.col("user_id") % 10 == 0, "NaN").otherwise(F.col("value").cast("string"))
    lines = events(spark, sf_dir).select(F.concat(F.col("event_type"), F.lit(":{client-id=producer-1}                : "), value).alias("value"))
    return parsers.parse_perf_metrics(lines, "perf-").groupBy("metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT CAST(doc_id AS VARCHAR) AS channel, lang, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END AS referrer FROM documents WHERE doc_id % 6 <> 0")
def ragged_csv(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    line = F.when(F.col("doc_id") % 6 == 0, F.lit("# a comment")).when(F.col("doc_id") % 4 == 0, F.concat_ws(";", F.col("doc_id").cast("string"), "lang")).otherwise(F.concat_ws(";", F.col("doc_id").cast("string"), "lang", "source"))
    rows = parsers.parse_ragged(d.select(line.alias("value")), ["channel", "lang", "referrer", "ip"])
    return rows.where(F.col("session_id").isNotNull() & F.col("ip").isNull()).select("channel", "lang", "referrer")


@query("SELECT event_id, event_type, value FROM events")
def roundtrip_delimited(spark, sf_dir):
    """A gzipped tab-separated file with a header."""
    path = new_folder(spark, "tsv")
    events(spark, sf_dir).select("event_id", "event_type", "value").write.option("compression", "gzip").csv(path, sep="\t", header=True)
    return readers.read_delimited(spark, path, "event_id long, event_type string, value double")


@query("SELECT user_id, event_id FROM events")
def roundtrip_headerless(spark, sf_dir):
    path = new_folder(spark, "csv")
    events(spark, sf_dir).select("user_id", "event_id").write.csv(path)
    return readers.read_delimited(spark, path, "user_id long, event_id long", ",", header=False)


@query("SELECT event_id, 7 AS schema_id, event_type AS body FROM events")
def registry_frames(spark, sf_dir):
    framed = events(spark, sf_dir).select("event_id", F.concat(F.unhex(F.lit("0000000007")), F.col("event_type").cast("binary")).alias("value"))
    head = parsers.registry_header(F.col("value"))
    return framed.select("event_id", head.alias("h")).where("h.magic = 0").select("event_id", F.col("h.schema_id").cast("int").alias("schema_id"), F.col("h.body").cast("string").alias("body"))


@query("SELECT event_id, user_id, value, event_type AS topic FROM events")
def archive_fields(spark, sf_dir):
    path = new_folder(spark, "archive")
    sinks.archive_log(log(spark, sf_dir), path)
    back = readers.read_archive(spark, path, "key string, value string, offset long, timestamp timestamp")
    named = back.withColumn("topic", F.regexp_extract(F.input_file_name(), "/topic=([^/]+)/", 1))
    body = F.from_json("value", "event_id long, user_id long, value double")
    return named.select(body.alias("b"), "topic").select("b.*", "topic")


@query("SELECT event_type || '+' || CAST(user_id % 3 AS VARCHAR) || '+' || CAST(event_id AS VARCHAR) AS _id FROM events")
def doc_id_sink(spark, sf_dir):
    path = new_folder(spark, "index")
    return sinks.write_index(log(spark, sf_dir), path).select("_id")


@query("SELECT event_id % 4 <> 0 AS good, count(*) AS n FROM events GROUP BY 1")
def dead_letter(spark, sf_dir):
    value = F.when(F.col("event_id") % 4 == 0, "{broken").otherwise(F.col("props"))
    records = events(spark, sf_dir).select("event_id", value.alias("value"), F.from_json(value, "k int").alias("d"))
    checked = records.withColumn("d", F.when(F.col("d.k").isNotNull(), F.col("d")))
    good, bad = sinks.split_dead_letter(checked, "d")
    return good.select(F.lit(True).alias("good")).unionByName(bad.select(F.lit(False).alias("good"))).groupBy("good").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, {K} AS k, event_type FROM events")
def roundtrip_json_log(spark, sf_dir):
    path = new_folder(spark, "log")
    records = sinks.to_log_json(events(spark, sf_dir), "event_id", ["event_id", "k", "event_type"])
    sinks.write_log(records, "events", path)
    rows = readers.read_log(spark, ["events"], path, streaming=False, schema=spark.read.parquet(path).schema)
    return parsers.decode_json(rows, "event_id long, k int, event_type string").select("value.*")


@query("SELECT 'user:' || CAST(user_id AS VARCHAR) AS key, max(event_id) AS event_id FROM events GROUP BY user_id")
def roundtrip_kv(spark, sf_dir):
    path = new_folder(spark, "kv")
    sinks.to_kv(events(spark, sf_dir).select("user_id", "event_id", "value"), "user:", "user_id", ["event_id"]).write.parquet(path)
    return spark.read.parquet(path).select("key", F.get_json_object("value", "$.event_id").cast("long").alias("event_id"))


@query("SELECT CAST(user_id AS VARCHAR) AS _id, max(event_id) AS \"offset\" FROM events GROUP BY user_id")
def roundtrip_index(spark, sf_dir):
    path = new_folder(spark, "index")
    records = log(spark, sf_dir)
    sinks.write_index(records.where("offset % 2 = 1"), path, "key")
    return sinks.write_index(records.where("offset % 2 = 0"), path, "key").select("_id", "offset")


@query("SELECT event_type AS measurement, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def roundtrip_points(spark, sf_dir):
    path = new_folder(spark, "points")
    points = events(spark, sf_dir).select(F.col("event_type").alias("measurement"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("tags"), F.create_map(F.lit("value"), "value").alias("fields"), "ts")
    sinks.write_points(points, path)
    return spark.read.parquet(path).groupBy("measurement", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("fields")["value"]), 4).alias("total"))


@query("SELECT vec_id, label, round(CAST(embedding[1] AS DOUBLE), 5) AS first FROM embeddings")
def roundtrip_vectors(spark, sf_dir):
    path = new_folder(spark, "vectors")
    sinks.write_vectors(table(spark, sf_dir, "embeddings"), path, 64, "embedding")
    return readers.read_keyed(spark, path, ["vec_id", "label", "embedding"]).select("vec_id", "label", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem")
def roundtrip_sorted(spark, sf_dir):
    path = new_folder(spark, "sorted")
    sinks.write_sorted(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), path, ["l_orderkey", "l_linenumber"])
    return spark.read.parquet(path)


@query("SELECT event_id, user_id, value FROM events")
def event_envelope(spark, sf_dir):
    out = sinks.to_event_envelope(events(spark, sf_dir).select("event_id", "user_id", "value"))
    return out.select(F.from_json("value", "event struct<event_id: long, user_id: long, value: double>").alias("e")).select("e.event.*")


@query("SELECT event_type AS metric, CAST(user_id % 10 AS VARCHAR) AS host, strftime(ts, '%Y-%m-%d') AS day, count(*) AS points FROM events GROUP BY 1, 2, 3")
def metric_series(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("host", F.col("user_id") % 10)
    parsed = F.from_json("payload", "metric string, points array<struct<timestamp: long, value: double>>, resources array<struct<name: string, type: string>>")
    series = sinks.to_metric_series(ev, "event_type", "ts", "value", "host").select(parsed.alias("p"))
    first = F.timestamp_seconds(F.get("p.points", F.lit(0))["timestamp"])
    return series.select("p.metric", F.get("p.resources", F.lit(0))["name"].alias("host"), F.date_format(first, "yyyy-MM-dd").alias("day"), F.size("p.points").cast("long").alias("points"))


@query("""SELECT "table", rows, CAST(n AS INTEGER) AS nullable FROM (""" + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows, (SELECT count(*) FROM (DESCRIBE {t})) AS n FROM {t}" for t in TABLES) + ")")
def copy_schema(spark, sf_dir):
    """Every table."""
    report = readers.copy_schema(spark, {t: table(spark, sf_dir, t) for t in TABLES}, new_folder(spark, "copy"))
    return report.select("table", "rows", F.size("nullable_cols").alias("nullable"))


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def upsert_sink(spark, sf_dir):
    path = new_folder(spark, "upsert")
    ev = events(spark, sf_dir).select("user_id", "event_id", "value")
    sinks.upsert_by_key(ev.where("event_id % 2 = 0"), path, ["user_id"], ["event_id"])
    return sinks.upsert_by_key(ev.where("event_id % 2 = 1"), path, ["user_id"], ["event_id"]).select("user_id", "event_id")


@query("SELECT event_id, CASE WHEN event_id % 2 = 1 THEN value END AS value FROM events")
def evolving_sink(spark, sf_dir):
    path = new_folder(spark, "evolving")
    ev = events(spark, sf_dir)
    sinks.write_evolving(ev.where("event_id % 2 = 0").select("event_id"), path)
    return sinks.write_evolving(ev.where("event_id % 2 = 1").select("event_id", "value"), path).select("event_id", "value")


@query("SELECT user_id AS key, max(event_id) AS \"offset\" FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def changelog_table(spark, sf_dir):
    from millrace.streaming.streams import as_table

    rows = events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("offset"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return as_table(rows).select("key", "offset")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest_orders(spark, sf_dir):
    return latest_per_key(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")
