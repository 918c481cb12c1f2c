"""Queries on change data, routing and record shaping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import cdc, transforms
from millrace.plans.registry import K, events, query, table

OP = "CASE event_type WHEN 'signup' THEN 'c' WHEN 'purchase' THEN 'r' WHEN 'error' THEN 'd' ELSE 'u' END"
ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("region", T.LongType()), T.StructField("total", T.IntegerType())])


def changes(spark, sf_dir) -> DataFrame:
    """events as a change log: the key is the user, the position is the event."""
    ev = events(spark, sf_dir)
    op = F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "purchase", "r").when(F.col("event_type") == "error", "d").otherwise("u")
    image = F.struct(F.col("user_id").alias("id"), (F.col("user_id") % 2).alias("region"), F.col("k").alias("total"))
    rows = ev.withColumn("op", op).withColumn("image", image)
    return rows.select(
        F.when(F.col("op").isin("u", "d"), F.col("image")).alias("before"), F.when(F.col("op") != "d", F.col("image")).alias("after"), "op",
        F.struct(F.lit("public").alias("schema"), F.lit("population").alias("table"), F.lit("s").alias("sequence"), F.col("event_id").alias("lsn")).alias("source"),
        F.unix_millis("ts").alias("ts_ms"), F.col("event_id").alias("lsn"),
    )


LATEST = f"SELECT user_id AS id, user_id % 2 AS region, {K} AS total, {OP} AS op, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events"


@query(f"SELECT id, region, total FROM ({LATEST}) WHERE r = 1 AND op <> 'd'")
def cdc_latest(spark, sf_dir):
    rows = cdc.cdc_ops(changes(spark, sf_dir))
    images = rows.select(*cdc.cdc_image(rows, ["id", "region", "total"]), "op", "lsn")
    return cdc.latest_per_key(images, ["id"], "lsn", F.col("op") == "d").select("id", "region", "total")


REGION = f"SELECT id, region, total FROM ({LATEST}) WHERE r = 1 AND op <> 'd' AND region = 1"


@query(REGION)
def cdc_view_region(spark, sf_dir):
    return cdc.cdc_view(changes(spark, sf_dir), 1, ["id"], ["id", "region", "total"], ["lsn"])


def start_table(spark, sf_dir) -> DataFrame:
    """The customers as the table before the changes."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 2).alias("region"), F.lit(-1).alias("total"))


APPLIED = f"""SELECT id, region, total FROM ({LATEST}) WHERE r = 1 AND op <> 'd'
    UNION ALL SELECT c_custkey, c_custkey % 2, -1 FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)"""


@query(APPLIED)
def cdc_apply(spark, sf_dir):
    return cdc.apply_cdc(start_table(spark, sf_dir), changes(spark, sf_dir), ["id"], ["lsn"])


@query(f"""SELECT event_id AS "source.lsn", {OP} AS op, CASE WHEN {OP} IN ('u', 'd') THEN user_id END AS "before.id", CASE WHEN {OP} <> 'd' THEN {K} END AS "after.total" FROM events""")
def cdc_flatten(spark, sf_dir):
    encoded = changes(spark, sf_dir).select(F.to_json(F.struct("before", "after", "source", "op", "ts_ms")).alias("value"))
    return cdc.read_cdc(encoded, ROW, nested=False).select("`source.lsn`", "op", "`before.id`", "`after.total`")


@query(f"SELECT event_id AS lsn, {OP} AS op FROM events WHERE event_id % 5 <> 0")
def payload_unwrap(spark, sf_dir):
    one = F.to_json(F.struct("before", "after", "source", "op", "ts_ms"))
    wrapped = F.to_json(F.struct(F.struct("before", "after", "source", "op", "ts_ms").alias("payload")))
    value = F.when(F.col("lsn") % 5 == 0, F.lit(None).cast("string")).when(F.col("lsn") % 2 == 0, wrapped).otherwise(one)
    records = transforms.drop_tombstones(changes(spark, sf_dir).select(value.alias("value")))
    return cdc.read_cdc(records, ROW).select("source.lsn", "op")


@query("""SELECT event_id, strftime(DATE '1970-01-01' + CAST(event_id % 20000 AS INTEGER), '%Y-%m-%d') AS d, printf('%02d:%02d:%02d', (event_id * 1000) // 3600000, ((event_id * 1000) // 60000) % 60, (event_id) % 60) AS t,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS ms, strftime(ts, '%Y-%m-%d %H:%M:%S') AS us, event_type AS b, 2 AS n FROM events""")
def cdc_cast(spark, sf_dir):
    ev = events(spark, sf_dir)
    raw = ev.select(
        "event_id", (F.col("event_id") % 20000).alias("d"), (F.col("event_id") * 1000).alias("t"), F.unix_millis("ts").alias("ms"), F.unix_micros("ts").alias("us"),
        F.base64(F.col("event_type").cast("binary")).alias("b"), F.lit("x,y").alias("s"),
    )
    config = {"date_fields": ["d"], "time_fields": ["t"], "datetime_milli_fields": ["ms"], "datetime_micro_fields": ["us"], "binary_fields": ["b"], "set_fields": ["s"]}
    fmt = "yyyy-MM-dd HH:mm:ss"
    return cdc.cast_cdc(raw, config).select("event_id", F.col("d").cast("string").alias("d"), "t", F.date_format("ms", fmt).alias("ms"), F.date_format("us", fmt).alias("us"), F.col("b").cast("string").alias("b"), F.size("s").alias("n"))


@query(f"SELECT user_id AS id, user_id % 2 AS region, {K} AS total FROM events WHERE {OP} <> 'd' AND {K} < 5")
def struct_star_filter(spark, sf_dir):
    return transforms.expand(changes(spark, sf_dir).where(F.col("after.total") < 5), "after")


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS \"kId\", value FROM events")
def key_to_value(spark, sf_dir):
    keyed = events(spark, sf_dir).select("event_id", "value", F.to_json(F.struct(F.col("user_id").alias("keyId"))).alias("key"))
    return transforms.key_to_value(keyed, {"keyId": "kId"}).select("event_id", "kId", "value")


@query("SELECT event_id, CASE WHEN event_type LIKE 'e%' THEN 'server.public.' || event_type ELSE event_type END AS topic FROM events")
def route_regex(spark, sf_dir):
    topic = F.concat(F.lit("cdc.server.public."), "event_type")
    named = events(spark, sf_dir).select("event_id", F.when(F.col("event_type").startswith("e"), F.substring(topic, 5, 100)).otherwise(topic).alias("topic"))
    return transforms.route_regex(named, "cdc\\.server\\.public\\.(.*)", "$1")


@query("SELECT event_id, event_type || '-' || strftime(ts, '%Y_%m_%d') AS topic FROM events")
def route_daily(spark, sf_dir):
    return transforms.route_timestamp(events(spark, sf_dir).select("event_id", F.col("event_type").alias("topic"), F.col("ts").alias("timestamp"))).select("event_id", "topic")


TOPIC = "CASE event_id % 5 WHEN 0 THEN event_type || '.internal' WHEN 1 THEN event_type || '.replica' WHEN 2 THEN '__' || event_type WHEN 3 THEN 'connect-' || event_type ELSE event_type END"


def _topics(spark, sf_dir) -> DataFrame:
    kind, i = F.col("event_type"), F.col("event_id") % 5
    topic = F.when(i == 0, F.concat(kind, F.lit(".internal"))).when(i == 1, F.concat(kind, F.lit(".replica"))).when(i == 2, F.concat(F.lit("__"), kind)).when(i == 3, F.concat(F.lit("connect-"), kind)).otherwise(kind)
    return events(spark, sf_dir).select("event_id", topic.alias("topic"))


#: Topics that replication leaves out.
BLACKLIST = [".*[\\-\\.]internal", ".*\\.replica", "__.*", "connect.*"]


@query("SELECT event_id, event_type AS topic FROM events WHERE event_id % 5 = 4")
def topic_filter(spark, sf_dir):
    return transforms.select_topics(_topics(spark, sf_dir), [".*"], BLACKLIST)


@query(f"SELECT event_id, {TOPIC} AS topic FROM events WHERE {TOPIC} LIKE 'connect-%' OR {TOPIC} LIKE '%.replica'")
def glob_filter(spark, sf_dir):
    return transforms.glob_filter(_topics(spark, sf_dir), "topic", ["connect-*", "*.replica", "connect-?iew"])


@query("SELECT event_id, user_id FROM events WHERE user_id % 2 = 1")
def tenant_view(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("region", F.col("user_id") % 2)
    transforms.tenant_view(rows, 1, "tenant_1")
    return spark.table("tenant_1").select("event_id", "user_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)licensed|rights reserved')")
def track_keywords(spark, sf_dir):
    return transforms.track(table(spark, sf_dir, "documents"), "text", ["licensed", "rights reserved"]).select("doc_id")


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag = 'R')")
def public_route(spark, sf_dir):
    route = F.struct(F.when(F.col("l_returnflag") == "R", "public").otherwise("dynamic").alias("route"))
    services = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(route).alias("components"))
    return transforms.services_with_public_route(services).select("l_orderkey")


@query(f"""SELECT event_id AS id, event_type AS message, CASE WHEN user_id % 3 <> 0 THEN 'category_' || CAST(user_id % 3 AS VARCHAR) END AS category, CASE WHEN user_id % 3 <> 0 THEN CAST({K} AS BIGINT) END AS value FROM events""")
def vector_record(spark, sf_dir):
    data = F.when(F.col("user_id") % 3 != 0, F.struct(F.concat(F.lit("category_"), (F.col("user_id") % 3).cast("string")).alias("category"), F.col("k").alias("value")))
    messages = events(spark, sf_dir).select(F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("message"), data.alias("data"))).alias("value"))
    return transforms.to_vector_record(messages).select("id", "message", "category", "value")


@query("SELECT event_id, event_type AS topic, CASE WHEN event_type = 'view' THEN value END AS value FROM events WHERE event_type IN ('view', 'click')")
def union_topics(spark, sf_dir):
    ev = events(spark, sf_dir)
    views = ev.where("event_type = 'view'").select("event_id", F.col("event_type").alias("topic"), "value")
    clicks = ev.where("event_type = 'click'").select("event_id", F.col("event_type").alias("topic"))
    aligned = transforms.align_schema(clicks, views.schema)
    return transforms.union_logs(views, aligned).select("event_id", "topic", "value")
