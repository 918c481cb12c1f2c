"""Operators on small frames with results known by hand."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars
from millrace.operators import cdc, charts, reports, search, timeseries, transforms, vector, windows
from millrace.sources import keyed, parsers, readers, sinks
from millrace.streaming import stateful, streams


def one(df):
    return [tuple(r) for r in df.collect()]


def test_chart_ties_and_short_plays(spark):
    plays = spark.createDataFrame([(1, 60000)] * 3 + [(2, 60000)] * 3 + [(3, 29999)] * 9 + [(9, 60000)], "song_id long, duration long")
    songs = spark.createDataFrame([(1, "Punk", "a"), (2, "PUNK", "b"), (3, "Punk", "c")], "id long, genre string, name string")
    by_genre, overall = charts.music_charts(plays, songs)
    assert one(by_genre.select("genre", "rank", "song_id", "plays").orderBy("rank")) == [("punk", 1, 1, 3), ("punk", 2, 2, 3)]
    assert overall.count() == 2


def test_breach_counter_golden(spark):
    values = [96.6, 96.6, 96.7, 45.3, 45.3, 45.3, 35.8, 35.8, 35.8]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, t int, v double")
    out = windows.consecutive_breach(df, "k", "t", "v", 60, 6).orderBy("t")
    assert [r.counter for r in out.collect()] == [0, 0, 0, 1, 2, 3, 4, 5, 6]
    assert [r.fires for r in out.collect()][-2:] == [False, True]


def test_price_range_nine_seconds(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("A", t0 + dt.timedelta(seconds=s), p, p + 1) for s, p in ((0, 5.0), (4, 9.0), (10, 7.0))], "symbol string, ts timestamp, bid_price double, ask_price double")
    rows = windows.price_range(df).orderBy("window_start").collect()
    assert [(r.change_bid_price, r.time_interval) for r in rows] == [(4.0, 4), (0.0, 0)]


def test_latest_per_key_doesnt_depend_on_order(spark):
    data = [(1, 1, "a", False), (1, 3, "c", True), (1, 2, "b", False), (2, 1, "x", False)]
    for rows in (data, data[::-1]):
        df = spark.createDataFrame(rows, "id int, v int, x string, gone boolean")
        assert one(cdc.latest_per_key(df, ["id"], "v", "gone").select("id", "x")) == [(2, "x")]


def changes(spark, rows):
    return spark.createDataFrame(rows, "before struct<id:int,x:string>, after struct<id:int,x:string>, ts_ms long")


def test_apply_cdc_cases_and_replay(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, x string")
    batch = changes(spark, [((1, "a"), (1, "A"), 1), ((2, "b"), None, 2), (None, (4, "d"), 3), ((3, "c"), (5, "c"), 4), (None, None, 5), (None, (4, "d"), 6)])
    once = cdc.apply_cdc(target, batch, ["id"])
    expected = [(1, "A"), (4, "d"), (5, "c")]
    assert sorted(one(once)) == expected
    assert sorted(one(cdc.apply_cdc(once, batch, ["id"]))) == expected
    assert sorted(one(cdc.apply_cdc(target, batch))) == expected


def test_flatten_and_globs(spark):
    df = spark.createDataFrame([((1, (2, "x")),)], "s struct<a:int, t struct<b:int,c:string>>")
    assert transforms.flatten(df).columns == ["s.a", "s.t.b", "s.t.c"]
    names = spark.createDataFrame([("logs-1",), ("logs-a",), ("x.y",), ("xzy",)], "n string")
    assert sorted(one(transforms.glob_filter(names, "n", ["logs-[0-9]", "x.y"]))) == [("logs-1",), ("x.y",)]
    assert one(transforms.glob_filter(names, "n", [])) == []


def test_severity_first_hit(spark):
    schema = "index string, aliases string, policy string, has_write_alias boolean, document_count long"
    a = spark.createDataFrame([(i, "x", "p", w, 5, g) for i, w, g in (("gone", False, False), ("alias", True, True), ("grown", True, True), ("written", True, False), ("other", False, False), ("same", True, True))], schema + ", document_count_delta boolean")
    b = spark.createDataFrame([("alias", "y", "p", True, 9), ("grown", "x", "p", True, 9), ("written", "x", "p", True, 9), ("other", "x", "p", False, 9), ("same", "x", "p", True, 5), ("extra", "x", "p", True, 1)], schema)
    report = reports.compare_snapshots(a, b)
    assert {r["index"]: r.severity for r in report.collect()} == {"gone": 5, "alias": 4, "grown": 1, "written": 2, "other": 3, "same": 0}
    assert one(reports.severity_summary(report)) == [(1, 1, 1, 1, 1, 1, 6, 5)]


def test_offset_sync_golden_totals(spark):
    cells = [(f"{reports.NO_PARTITION} {reports.EMPTY}", "Empty", True, 15640), (f"{reports.NO_PARTITION} {reports.EMPTY}", "Stable", True, 6268), (f"{reports.NO_PARTITION} {reports.EXPECTED}", "Empty", False, 1860), (reports.SYNCED, "Empty", True, 15864), (reports.SYNCED, "Stable", True, 12708)]
    df = spark.createDataFrame(cells, "message string, group_state string, is_ok boolean, n int").select("message", "group_state", "is_ok", F.explode(F.sequence(F.lit(1), F.col("n"))))
    out = {r.message: tuple(r)[1:] for r in reports.offset_sync_summary(df).collect()}
    assert out["Total"] == (1860, 31504, 0, 18976, 52340)
    assert out[reports.SYNCED] == (0, 15864, 0, 12708, 28572)


def test_offset_sync_filters_and_target_only_rows(spark):
    source = spark.createDataFrame([("g1", "Stable", "t", 0, 10, 10), ("g2", "Empty", "t", 0, 5, 0), ("g3", "Stable", "t", 0, 7, 9)], "group string, group_state string, topic string, partition int, source_offset long, source_end long")
    target = spark.createDataFrame([("g1", "t", 0, 8, 1), ("g4", "t", 0, 3, 0), ("g3", "t", 1, 4, 0)], "group string, topic string, partition int, target_offset long, target_lag long")
    shown = reports.offset_sync_report(source, target).collect()
    assert [(r.group, r.message, r.is_ok) for r in shown] == [("g3", f"{reports.NO_PARTITION} {reports.EXPECTED}", False)]
    every = {(r.group, r.partition): (r.group_state, r.target_lag_to_source, r.message, r.is_ok) for r in reports.offset_sync_report(source, target, True, True).collect()}
    assert every == {
        ("g1", 0): ("Stable", 2, reports.SYNCED, True), ("g2", 0): ("Empty", None, reports.NO_GROUP, False), ("g3", 0): ("Stable", None, f"{reports.NO_PARTITION} {reports.EXPECTED}", False),
        ("g4", 0): (None, None, reports.SYNCED, True), ("g3", 1): (None, None, reports.SYNCED, True),
    }


def test_throughput_guards(spark):
    schema = "group string, topic string, partition int, current_offset string"
    a = spark.createDataFrame([("g", "t", 0, "10"), ("g", "t", 1, "-"), ("g", "t", 2, "9"), ("idle", "t", 0, "5")], schema)
    b = spark.createDataFrame([("g", "t", 0, "40"), ("g", "t", 1, "7"), ("g", "t", 2, "3"), ("idle", "t", 0, "5")], schema)
    by_group, total = reports.throughput(a, b, 10)
    assert one(by_group) == [("g", 30, 3.0, None)]
    assert one(total) == [(30, 3.0, None)]


def test_plan_patch_keeps_member(spark):
    schema = "section string, name string, users array<string>, reserved boolean"
    a = spark.createDataFrame([("m", "x", ["u"], False), ("m", "y", None, False), ("m", "z", ["u"], True)], schema)
    b = spark.createDataFrame([("m", "x", ["u", "admin"], False), ("m", "z", ["v"], False)], schema)
    out = {r.name: (r.action, r.users) for r in reports.plan_patch(a, b, ["section", "name"], ["users"], keep_member=("users", "admin")).collect()}
    assert out["x"] == ("skip", ["u", "admin"]) and out["y"] == ("add", ["admin"]) and out["z"][0] == "untouchable"


def test_trig_series(spark):
    total = reports.trig_load(spark.range(1, 3_000_001)).first()[0]
    assert round(total, 6) == 135.242841


def test_scalars(spark):
    df = spark.range(1).select(
        scalars.readable_size(F.lit(249021399)).alias("size"), scalars.lsn_to_long(F.lit("1/A")).alias("lsn"), scalars.time_of_day(F.lit(3_661_999)).alias("t"),
        scalars.trailing_number(F.lit("pg-12")).alias("n"), scalars.ceil_cents(F.lit(1.231)).alias("c"), scalars.parse_iso(F.lit("2024-01-02T03:04:05.678Z")).cast("string").alias("iso"),
    )
    assert tuple(df.first()) == ("237.49 MiB", (1 << 32) + 10, "01:01:01", "12", 1.24, "2024-01-02 03:04:05.678")


def test_canonical_json_of_nested_records(spark):
    df = spark.createDataFrame([(({"z": 1, "a": None}, [(2, "x"), None]),)], "r struct<m: map<string, int>, l: array<struct<n: int, b: string>>>")
    assert df.select(scalars.canonical_json(df, ["r"])).first()[0] == '{"r": {"l": [{"b": "x", "n": 2}, null], "m": {"a": null, "z": 1}}}'


def test_canonical_json(spark):
    df = spark.createDataFrame([(1, "x", None)], "b int, a string, c double")
    assert df.select(scalars.canonical_json(df, ["b", "a", "c"])).first()[0] == '{"a": "x", "b": 1, "c": null}'


def test_parsers(spark):
    lines = spark.createDataFrame([("cpu_load_short,host=testnode value=0.95 1434055562000000000",), ("broken",)], "value string")
    row = parsers.parse_line_protocol(lines).first()
    assert (row.measurement, row.tags, row.fields, row.ts) == ("cpu_load_short", {"host": "testnode"}, {"value": 0.95}, 1434055562000000000)
    text = spark.createDataFrame([('usage_idle{cpu="cpu-total",host="a"} 96.6',), ("up 1",), ("# TYPE up gauge",)], "value string")
    assert {r.name: r.value for r in parsers.parse_exposition(text).collect()} == {"usage_idle": 96.6, "up": 1.0}
    ragged = parsers.parse_ragged(spark.createDataFrame([("# note",), ("a;b;c",), ("a;;",)], "value string"), ["x", "y", "z"])
    assert sorted(one(ragged.select("x", "y", "z")), key=str) == [("a", "b", "c"), ("a", None, None)]


def test_lines_with_escapes_and_quotes(spark):
    lines = ['my\\ disk,path=/a\\,b,k\\=x=v\\ w free=5i,note="a, b=\\"c\\" d",ok=t,free=7u 12', 'm f="",g=1e3', "m,=x f=1", 'm f="open', "m"]
    out = [tuple(r) for r in parsers.parse_line_protocol(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert out == [("my disk", {"path": "/a,b", "k=x": "v w"}, {"free": 7.0, "ok": 1.0}, {"note": 'a, b="c" d'}, 12), ("m", {}, {"g": 1000.0}, {"f": ""}, None)]
    text = ['http{path="/a,b{c}",say="\\"hi\\""} 3 99', 'up{} 1', 'bad{x=1} 2']
    out = [tuple(r) for r in parsers.parse_exposition(spark.createDataFrame([(x,) for x in text], "value string")).collect()]
    assert out == [("http", {"path": "/a,b{c}", "say": '"hi"'}, 3.0), ("up", {}, 1.0)]


def test_log_written_by_a_stream(spark, tmp_path):
    spark.range(20).select(F.col("id").cast("string").alias("value")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("value string").parquet(str(tmp_path / "in"))
    sinks.write_log(stream, "t", str(tmp_path / "log"), checkpoint=str(tmp_path / "check")).awaitTermination()
    back = readers.read_log(spark, ["t"], str(tmp_path / "log"), streaming=False, schema=spark.read.parquet(str(tmp_path / "log")).schema)
    assert back.count() == 20 and readers.read_log(spark, ["u"], str(tmp_path / "log"), streaming=False, schema=back.schema).count() == 0


def test_missing_packages_are_named(spark):
    with pytest.raises(RuntimeError, match="spark-avro"):
        parsers.decode_registry_avro(spark.createDataFrame([(b"\0\0\0\0\1x",)], "value binary"), '"string"')


def test_words_of_marks_and_repeated_words(spark):
    texts = [("d1", "cafe\u0301 in the rain"), ("d2", "the thing"), ("d3", "the the end"), ("d4", "of the and the of")]
    index = search.build_index(spark.createDataFrame(texts, "id string, text string"), "id", ["text"])
    assert search.words_of("Cafe\u0301, rain") == ["cafe\u0301", "rain"]
    assert [r.id for r in search.match(index, "text", "cafe\u0301").collect()] == ["d1"]
    assert sorted(one(search.match_phrase(index, "text", "the the", 1))) == [("d3",), ("d4",)]
    assert sorted(one(search.match_phrase(index, "text", "the the", 0))) == [("d3",)]
    assert sorted(one(search.match_phrase(index, "text", "the and the", 0))) == [("d4",)]
    assert sorted(one(search.match_bool_prefix(index, "text", "teh ra", 1).select("id"))) == [("d1",), ("d2",), ("d3",), ("d4",)]


def test_stored_index_answers_alike(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_partkey", "p_name", "p_type")
    live = search.build_index(df, "p_partkey", ["p_name", "p_type"])
    search.store_index(live, str(tmp_path / "index"))
    back = search.open_index(spark, str(tmp_path / "index"), "p_partkey")
    for run in (lambda i: search.match(i, "p_name", "red bolt", None), lambda i: search.multi_match(i, ["p_name", "p_type"], "red economy", None)):
        a, b = ({r.id: round(r.score, 9) for r in run(i).collect()} for i in (live, back))
        assert a == b and a
    assert sorted(one(search.match_phrase(back, "p_name", "red bolt", 1))) == sorted(one(search.match_phrase(live, "p_name", "red bolt", 1)))
    assert sorted(one(search.suggest(back, "p_name", "widgit"))) == sorted(one(search.suggest(live, "p_name", "widgit")))


def test_relational_source_in_ranges(spark):
    url, driver = "jdbc:derby:memory:shop;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.range(1, 101).select(F.col("id").cast("int").alias("ID"), F.concat(F.lit("n"), "id").alias("NAME"))
    rows.write.jdbc(url, "ITEMS", "overwrite", {"driver": driver})
    back = readers.read_jdbc(spark, url, "ITEMS", "ID", (1, 100), 4, driver=driver)
    assert back.rdd.getNumPartitions() == 4
    assert sorted(one(back.select("ID", "NAME"))) == sorted(one(rows))
    with pytest.raises(RuntimeError, match="driver"):
        readers.read_jdbc(spark, "jdbc:none:x", "t", driver="no.such.Driver")


def test_table_sizes_order(spark):
    names = ("orders", "lineitem", "nation")
    out = reports.table_sizes(readers.parquet_files(spark, {n: f"/root/testdata/sf0.001/{n}.parquet" for n in names})).collect()
    assert [r.table for r in out] == ["lineitem", "orders", "nation"]
    assert all(r.compressed_bytes == os.path.getsize(f"/root/testdata/sf0.001/{r.table}.parquet") and r.ratio > 0 and r.parts == 1 for r in out)


def test_actor_summary_counts_names(spark):
    actors = spark.createDataFrame([(1, "A", "B"), (2, "C", "D"), (3, "E", "F")], "id int, first_name string, last_name string")
    roles = spark.createDataFrame([(1, 10, 1), (1, 10, 5), (1, 11, 2), (2, 12, 3), (2, 99, 4)], "actor_id int, movie_id int, created_at int")
    movies = spark.createDataFrame([(10, 4.0), (11, 7.0), (12, None)], "id int, rank double")
    genres = spark.createDataFrame([(10, "x"), (10, "y"), (11, "x")], "movie_id int, genre string")
    led = spark.createDataFrame([(10, 7), (10, 8), (11, 9), (99, 7)], "movie_id int, director_id int")
    directors = spark.createDataFrame([(7, "same"), (8, "same"), (9, "other")], "id int, name string")
    out = {r.id: tuple(r)[1:] for r in reports.actor_summary(actors, roles, movies, genres, led, directors).collect()}
    # Movie 10 is joined twice two by two times: 8 rows of rank 4, one of rank 7.
    assert out == {1: ("A B", 2, 39 / 9, 2, 2, 5), 2: ("C D", 1, None, 0, 1, 4)}
    plan = reports.actor_summary(actors, roles, movies, genres, led, directors)._jdf.queryExecution().executedPlan().toString()
    assert "kind" in plan and not [x for x in plan.split("\n") if "Exchange" in x and "kind" in x]  # what a row is exploded to isn't shuffled


def test_actor_summary_of_lines_shuffles_no_copies(spark, monkeypatch):
    from millrace.plans import batch, registry

    rows = {tuple(r) for r in batch._actors(spark, "/root/testdata/sf0.001").collect()}
    plan = batch._actors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and not [x for x in plan.split("\n") if "Exchange" in x and "kind" in x]
    # Tasks follow the bytes.
    monkeypatch.setattr(registry, "TASK_BYTES", 1 << 14)
    more = batch._actors(spark, "/root/testdata/sf0.001")
    assert "REPARTITION_BY_NUM" in more._jdf.queryExecution().executedPlan().toString() and {tuple(r) for r in more.collect()} == rows


def test_heartbeats_across_spans(spark):
    beats = [("a", "b", t) for t in (0, 100, 3_599_000, 9_000_000, 9_000_500)] + [("a", "c", 5)]
    out = {r.target: tuple(r)[2:] for r in windows.heartbeat_health(spark.createDataFrame(beats, "source string, target string, ts long"), 5_401_000).collect()}
    assert out == {"b": (5, 5_401_000, 9_000_500, True), "c": (1, 0, 5, True)}


def test_vector_record_defaults(spark):
    df = spark.createDataFrame([('{"message": "m"}',), ('{"id": 5, "timestamp": "t", "data": {"category": "c", "value": 7}}',), ('{"id": "x", "data": {"value": "y"}}',)], "value string")
    a, b = (transforms.to_vector_record(df, F.lit("now")).collect() for _ in range(2))
    assert a == b
    assert [(r.timestamp, r.message, r.category, r.value) for r in a] == [("now", "m", None, None), ("t", "", "c", 7), ("now", "", None, None)]
    assert a[1].id == 5 and len({r.id for r in a}) == 3
    assert transforms.to_vector_record(df).first().timestamp is not None


def test_cast_of_every_kind(spark):
    df = spark.createDataFrame([(1, 3_661_999, 5, 7, "2024-01-02T03:04:05Z", "eA==", "a,b", 9)], "d int, t int, ms long, us long, ts string, b string, s string, other int")
    config = {"date_fields": ["d", "absent"], "time_fields": ["t"], "datetime_milli_fields": ["ms"], "datetime_micro_fields": ["us"], "timestamp_fields": ["ts"], "binary_fields": ["b"], "set_fields": ["s"]}
    r = cdc.cast_cdc(df, config).first()
    assert (r.d, r.t, r.b, r.s, r.other) == (dt.date(1970, 1, 2), "01:01:01", b"x", ["a", "b"], 9)
    at = cdc.cast_cdc(df, config).select(*(F.col(c).cast("string") for c in ("ms", "us", "ts"))).first()
    assert tuple(at) == ("1970-01-01 00:00:00.005", "1970-01-01 00:00:00.000007", "2024-01-02 03:04:05")


def test_buildings_searches(spark):
    df = spark.createDataFrame([("b1", "A modern office building with open spaces", 1999, True), ("b2", "Old tower", 1950, False)], "id string, description string, built_year int, in_use boolean")
    index = search.build_index(df, "id", ["description"])
    assert one(search.prefix(index, "description", "Off").select("id")) == [("b1",)]
    assert [r.id for r in search.match(index, "description", "modern tower").collect()] == ["b2", "b1"]
    assert one(search.match_phrase(index, "description", "modern building", 1)) == [("b1",)]
    assert one(search.match_phrase(index, "description", "modern building", 0)) == []
    assert one(search.match_phrase(index, "description", "building office", 2)) == [("b1",)]
    assert one(search.bool_query(index, "description", "modern tower", F.col("built_year") >= 1990).select("id")) == [("b1",)]
    assert one(search.suggest(index, "description", "oficce").select("suggestion")) == [("office",)]


def test_neighbours_in_groups_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(90, 8)).round(2)
    vectors[40:44] = vectors[3]
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(vectors)] + [(200, None, 0), (201, [], 0), (None, vectors[0].tolist(), 0), (202, [0.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    queries = df.where("vec_id % 9 = 0 or vec_id = 202").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    monkeypatch.setattr(vector, "TASK_BYTES", 64 * 3)
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vector, "BLOCK", 7)
    known = {i: np.array(v) for i, v, _ in rows if i is not None and v}
    unit = lambda v: v / max(np.linalg.norm(v), 1e-300)
    metrics = {"l2": lambda a, b: ((a - b) ** 2).sum(), "dot": lambda a, b: -(a * b).sum(), "cosine": lambda a, b: 1 - (unit(a) * unit(b)).sum()}
    for metric, d in metrics.items():
        for where, keep in ((None, lambda i: True), ("label = 1", lambda i: i % 2 == 1 or i == 202)):
            got = {(r.query_id, r["rank"]): r.distance for r in vector.knn(df, queries, 5, metric, where).collect()}
            want = {}
            for q in (i for i in known if i % 9 == 0 or i == 202):
                for rank, x in enumerate(sorted(d(known[q], v) for i, v in known.items() if keep(i))[:5], 1):
                    want[q, rank] = x
            assert got.keys() == want.keys()
            assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    ties = [r.id for r in vector.knn(df, queries.where("false").unionByName(df.where("vec_id = 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))), 3).orderBy("rank").collect()]
    assert ties == [3, 40, 41]
    with pytest.raises(ValueError):
        vector.knn(df, queries, 5, "manhattan")
    assert vector.knn(df.where("false"), queries, 5).count() == 0
    indexed, centroids = vector.ivf_build(df.where("vec_id < 200"), 6)
    exact = one(vector.knn(df.where("vec_id < 200"), queries, 5).orderBy("query_id", "rank"))
    assert one(vector.ivf_search(indexed, centroids, queries, 5, 1, exact=True).orderBy("query_id", "rank")) == exact


def test_range_query_lookback(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, 1.0), (t + dt.timedelta(seconds=90), 2.0)], "ts timestamp, value double")
    out = timeseries.range_query(df, F.lit(t), F.lit(t + dt.timedelta(seconds=600)), 60, 120)
    assert [(r.step_ts.minute, r.value) for r in out.orderBy("step_ts").collect()] == [(0, 1.0), (1, 1.0), (2, 2.0), (3, 2.0)]


def test_upsert_rewrites_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, v int, x string")
    for _ in range(2):
        out = sinks.upsert_by_key(df, path, ["k"], ["v"])
    assert one(out) == [(1, 2, "b")]
    sinks.upsert_by_key(spark.range(100).select(F.col("id").cast("int").alias("k"), F.lit(5).alias("v"), F.lit("c").alias("x")), path, ["k"], ["v"])
    before = set(os.listdir(f"{path}/v00000002"))
    sinks.upsert_by_key(spark.createDataFrame([(7, 9, "d"), (7, 1, "z")], "k int, v int, x string"), path, ["k"], ["v"])
    assert len([n for n in os.listdir(f"{path}/v00000003") if n.startswith("_bucket=")]) == 1 < len(before)
    table = keyed.read(spark, path)
    assert table.count() == 100 and one(table.where("k = 7")) == [(7, 9, "d")]
    for v in (10, 11, 12):
        sinks.upsert_by_key(spark.createDataFrame([(7, v, "e")], "k int, v int, x string"), path, ["k"], ["v"])
    # Two manifests and what they name are kept.
    assert keyed.versions(spark, path) == [5, 6]
    assert not os.path.exists(f"{path}/v00000003") and os.path.exists(f"{path}/v00000002")
    assert keyed.read(spark, path).count() == 100


def test_index_adds_to_what_is_there(spark, tmp_path):
    path = str(tmp_path / "index")
    schema = "topic string, partition int, offset long, key string, value string"
    sinks.write_index(spark.createDataFrame([("t", 0, 5, "a", "new"), ("t", 0, 6, "b", "x")], schema), path, "key")
    out = sinks.write_index(spark.createDataFrame([("t", 0, 1, "a", "old"), ("t", 0, 9, "c", "y")], schema), path, "key")
    assert sorted(one(out.select("_id", "value"))) == [("a", "new"), ("b", "x"), ("c", "y")]


def test_changes_in_any_order(spark, tmp_path):
    start = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, x string")
    log = [((1, "a"), (1, "A"), 1), ((2, "b"), None, 2), (None, (4, "d"), 3), ((3, "c"), (5, "c"), 4), ((4, "d"), None, 5), (None, (2, "again"), 6), ((2, "again"), (2, "last"), 7)]
    for n, order in enumerate((range(7), reversed(range(7)), (3, 6, 0, 5, 2, 4, 1, 6, 3))):
        write = streams.cdc_batches(str(tmp_path / f"t{n}"), ["id", "x"], ["id"], ["ts_ms"], start)
        for step, i in enumerate(order):
            write(changes(spark, [log[i]]), step)
        assert sorted(one(streams.current_table(spark, str(tmp_path / f"t{n}")))) == [(1, "A"), (2, "last"), (5, "c")]


def _files_in_time_order(folder, names):
    for i, name in enumerate(names):
        os.utime(f"{folder}/{name}", (1_700_000_000 + i * 10,) * 2)


@pytest.mark.parametrize("backwards", [False, True])
def test_breaches_whatever_file_comes_first(spark, tmp_path, backwards):
    t0 = dt.datetime(2024, 1, 1)
    values = [96.6, 45.3, 45.3, 35.8, 70.0, 35.8, 12.0, 59.9, 60.0, 1.0, 2.0, 3.0]
    schema = "ts timestamp, event_id long, user_id long, value double"
    rows = [(t0 + dt.timedelta(minutes=i), i, i % 2, v) for i, v in enumerate(v for v in values for _ in (0, 1))]
    for f in range(4):
        spark.createDataFrame(rows[f * 6 : f * 6 + 6], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    names = [n for n in os.listdir(tmp_path / "in") if n.endswith(".parquet")]
    first = {n: spark.read.parquet(str(tmp_path / "in" / n)).agg(F.min("event_id")).first()[0] for n in names}
    _files_in_time_order(tmp_path / "in", sorted(names, key=first.get, reverse=backwards))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with stateful.rocksdb(spark):
        out = stateful.breach_stream(stream, 60, 3, "1 day")
        streams.drain(out, streams.write_batch(str(tmp_path / "out")), str(tmp_path / "check"))
        spark.createDataFrame([(t0 + dt.timedelta(days=9), None, -1, None)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        streams.drain(out, streams.write_batch(str(tmp_path / "out")), str(tmp_path / "check"))
    got = {r.event_id: (r.counter, r.fires) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want, run = {}, {0: 0, 1: 0}
    for _, i, user, v in rows:
        run[user] = run[user] + 1 if int(v) < 60 else 0
        want[i] = (run[user], run[user] >= 3)
    assert got == want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider") is False


def test_retries_until_it_works():
    calls = []

    def fails_twice(_, batch_id):
        calls.append(batch_id)
        if len(calls) < 3:
            raise OSError

    sinks.with_retry(fails_twice, 3, 0)(None, 5)
    assert calls == [5, 5, 5]
    with pytest.raises(OSError):
        sinks.with_retry(lambda *_: (_ for _ in ()).throw(OSError()), 1, 0)(None, 1)


def test_write_vectors_checks_length(spark, tmp_path):
    with pytest.raises(Exception, match="length"):
        sinks.write_vectors(spark.createDataFrame([([1.0, 2.0],)], "vector array<float>"), str(tmp_path / "v"), 3)


def _runs_by_hand(rows, limit):
    """rows: (key, t, id, value). Counter by (key, t, id)."""
    out, run = {}, {}
    for key, t, i, v in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2])):
        run[key] = run.get(key, 0) + 1 if v is not None and int(v) < limit else 0
        out[key, t, i] = run[key]
    return out


@pytest.mark.parametrize("slices", [1, 5, 16])
def test_breaches_across_slices(spark, slices):
    """One key holds nearly all rows, in runs that reach over slices; a null key, null times and values, and a key that breaches throughout."""
    rng = random.Random(7)
    rows = [(1, t, t, 1.0 if rng.random() < 0.97 else rng.choice([80.0, None])) for t in range(900)] + [(1, 450, i, 5.0) for i in range(1000, 1200)]
    rows += [(2, t, t, 1.0) for t in range(0, 900, 9)] + [(None, t, t, 1.0) for t in range(40)] + [(3, None, 1, 1.0), (3, None, 2, 1.0), (3, 5, 3, 1.0), (3, 6, 4, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "k long, t long, id long, v double, counter int").drop("counter").repartition(7)
    out = windows.consecutive_breach(df, "k", ["t", "id"], "v", 60, 3, slices)
    assert {(r.k, r.t, r.id): r.counter for r in out.collect()} == _runs_by_hand(rows, 60)
    if slices == 16:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert out.where("k = 1").groupBy(F.spark_partition_id()).count().count() > 1  # not one task's
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_breaches_by_time_and_by_text(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t0 + dt.timedelta(hours=h), f"{h:03d}", 1.0 if h % 10 else 99.0) for h in range(200)], "k long, t timestamp, s string, v double")
    want = [h % 10 for h in range(200)]
    assert [r.counter for r in windows.consecutive_breach(df, "k", "t", "v", 60, 3).orderBy("t").collect()] == want
    assert [r.counter for r in windows.consecutive_breach(df, "k", "s", "v", 60, 3).orderBy("s").collect()] == want


def test_a_small_batch_rewrites_few_buckets(spark, tmp_path):
    """Buckets follow the table's bytes: then ten keys of many rewrite ten buckets at most, and the rest stays as it is."""
    path = str(tmp_path / "t")
    newest = lambda old, new: new if old is None else old.join(new.select("k"), "k", "left_anti").unionByName(new)
    every = spark.range(20_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    keyed.merge(every, path, ["k"], newest, bucket_bytes=16_000)
    keyed.merge(every.where("k < 5"), path, ["k"], newest, bucket_bytes=16_000)  # the table is too large for its buckets by now
    before = keyed._manifest(spark, path, keyed.versions(spark, path)[-1])
    assert before["buckets"] >= 64 and sum(before["sizes"].values()) / before["buckets"] <= 2 * 16_000
    keyed.merge(every.where("k between 100 and 109").withColumn("v", F.lit("new")), path, ["k"], newest, bucket_bytes=16_000)
    after = keyed._manifest(spark, path, keyed.versions(spark, path)[-1])
    moved = [b for b, f in after["folders"].items() if before["folders"].get(b) != f]
    assert len(moved) <= 10 < 0.2 * len(after["folders"])
    rows = {r.k: r.v for r in keyed.read(spark, path).collect()}
    assert len(rows) == 20_000 and {rows[k] for k in range(100, 110)} == {"new"} and rows[99] != "new"


def test_a_second_writer_is_told(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    row = lambda v: spark.createDataFrame([(1, v)], "k long, v string")
    keyed.merge(row("a"), path, ["k"], lambda _, new: new)

    def slow(old, new):
        keyed.merge(row("b"), path, ["k"], lambda _, new: new)  # another writer is done first
        return new

    with pytest.raises(RuntimeError, match="another writer"):
        keyed.merge(row("c"), path, ["k"], slow)
    assert one(keyed.read(spark, path)) == [(1, "b")]
