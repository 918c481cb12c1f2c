"""Stateful stream operators on small files: order of arrival, restarts, nulls, retraction."""

import datetime as dt
import itertools

import pytest

from millrace.operators import windows
from millrace.streaming import stateful, streams

T0 = dt.datetime(2024, 1, 1)


class Files:
    """A folder that a stream reads one file at a time, in the order in which they are written."""

    def __init__(self, spark, folder, schema):
        self.spark, self.path, self.schema = spark, str(folder), schema
        spark.createDataFrame([], schema).write.parquet(self.path)

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def run(spark, tmp_path, out, mode="append"):
    with stateful.rocksdb(spark):
        streams.drain(out, streams.write_batch(str(tmp_path / "out")), str(tmp_path / "check"), mode)


def read(spark, tmp_path):
    return spark.read.parquet(str(tmp_path / "out"))


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_breaches_with_nulls_and_late_rows(spark, tmp_path, order):
    files = Files(spark, tmp_path / "in", "ts timestamp, event_id long, user_id long, value double")
    values = [10.0, None, 20.0, float("nan"), float("-inf"), 30.0, float("inf"), 59.9, 60.0, 1.0, -0.5, None]
    rows = [(at(i), i, 1, v) for i, v in enumerate(values)]
    for part in order:
        files.add(rows[part::3])
    files.add([(None, 99, 1, 1.0)])
    out = stateful.breach_stream(files.stream(), 60, 2, "20 minutes", span_ms=60_000)
    run(spark, tmp_path, out)
    files.add([(at(100), 200, 2, 1.0)])
    run(spark, tmp_path, out)
    files.add([(at(3), 201, 1, 1.0)])  # behind the watermark
    files.add([(at(1000), 202, 2, 1.0)])
    run(spark, tmp_path, out)
    got = {r["event_id"]: (r["counter"], r["fires"]) for r in read(spark, tmp_path).collect()}
    counters = [1, 0, 1, 0, 1, 2, 0, 1, 0, 1, 2, 0]
    assert {i: got[i] for i in range(12)} == {i: (c, c >= 2) for i, c in enumerate(counters)}
    assert set(got) - set(range(12)) <= {200}


def test_breaches_are_released_in_the_middle(spark, tmp_path):
    files = Files(spark, tmp_path / "in", "ts timestamp, event_id long, user_id long, value double")
    out = stateful.breach_stream(files.stream(), 60, 2, "1 minute", span_ms=60_000)
    for i in range(3):
        files.add([(at(10 * i + j), 10 * i + j, 1, 1.0) for j in range(10)])
    run(spark, tmp_path, out)
    got = {r["event_id"]: r["counter"] for r in read(spark, tmp_path).collect()}
    assert got and max(got) >= 18 and all(c == i + 1 for i, c in got.items()) and 29 not in got


@pytest.mark.parametrize("table_first", [True, False])
def test_changelog_join(spark, tmp_path, table_first):
    plays = Files(spark, tmp_path / "plays", "ts timestamp, key long, name string, id long")
    table = Files(spark, tmp_path / "table", "ts timestamp, key long, offset long, deleted boolean, name string, day timestamp")
    day = dt.datetime(2020, 5, 6, 7, 8, 9, 123456)
    changes = [(at(1), 1, 0, False, "a", day), (at(5), 1, 1, False, "b", day), (at(5), 1, 2, None, "c", None), (at(8), 1, 3, True, None, None), (at(9), 2, 4, False, "x", day), (at(3), None, 5, False, "nobody", day), (at(12), 1, 6, False, None, day)]
    events = [(at(m), k, "play", 100 * (k or 0) + m) for m, k in itertools.product((0, 1, 4, 5, 7, 8, 9, 13), (1, 2, None))]
    parts = [changes[3:], changes[:3]]
    for i in range(2):
        first = [lambda i=i: table.add(parts[i]), lambda i=i: plays.add(events[i::2])]
        for f in first if table_first else first[::-1]:
            f()
    joined = stateful.changelog_join(plays.stream(), table.stream(), "key", "1 hour", shards=3, span_ms=60_000)
    run(spark, tmp_path, joined)
    # Later changes reach later plays, after a restart too.
    plays.add([(at(500), 1, "play", 1000), (at(700), 9, "end", -1)])
    table.add([(at(400), 1, 7, False, "late", day), (at(700), 9, 8, False, "end", day)])
    run(spark, tmp_path, joined)
    plays.add([(at(9000), 9, "end", -2)])
    table.add([(at(9000), 9, 9, False, "end", day)])
    run(spark, tmp_path, joined)
    got = {r["id"]: (r["name_table"], r["day"]) for r in read(spark, tmp_path).collect() if r["id"] >= 0}

    def state(key, time):
        now = (None, None)
        for ts, k, offset, deleted, name, d in sorted(changes, key=lambda c: (c[0], c[2])):
            if k == key and k is not None and ts <= time:
                now = (None, None) if deleted else (name, d)
        return now

    want = {i: state(k, ts) for ts, k, _, i in events}
    assert got == want | {1000: ("late", day)}


def test_charts_retract(spark, tmp_path):
    files = Files(spark, tmp_path / "in", "song_id long, genre string, version long, play boolean")
    rows = files.stream()
    out = stateful.retracting_charts(rows.where("play").select("song_id"), rows.where("not play").select("song_id", "genre", "version"), 2, 2)

    def step(*rows):
        files.add(list(rows))
        with stateful.rocksdb(spark):
            streams.drain(out, streams.retracting_chart_batches(str(tmp_path / "charts")), str(tmp_path / "check"))
        found = {}
        for r in sorted(streams.retracting_chart(spark, str(tmp_path / "charts"), 2).collect(), key=lambda r: (r["chart"], r["rank"])):
            found.setdefault(r["chart"], []).append((r["song_id"], r["plays"]))
        return found

    play = lambda s, n=1: [(s, None, None, True)] * n
    assert step((1, "pop", 1, False), (2, "pop", 1, False), (3, "pop", 1, False), *play(1, 5), *play(2, 3), *play(3, 2), *play(4, 9)) == {"": [(1, 5), (2, 3)], "pop": [(1, 5), (2, 3)]}
    # A song changes its genre: it leaves the one chart, another moves up, and it enters the other.
    assert step((1, "rock", 2, False)) == {"": [(1, 5), (2, 3)], "pop": [(2, 3), (3, 2)], "rock": [(1, 5)]}
    # An older change comes too late; plays of a song that had no genre count once it has one.
    assert step((1, "folk", 1, False), (4, "rock", 1, False), *play(3, 2)) == {"": [(4, 9), (1, 5)], "pop": [(3, 4), (2, 3)], "rock": [(4, 9), (1, 5)]}
    # A deleted song leaves both charts.
    assert step((4, None, 2, False), (None, "pop", 1, False), *play(None)) == {"": [(1, 5), (3, 4)], "pop": [(3, 4), (2, 3)], "rock": [(1, 5)]}
    assert step((4, "pop", 3, False), *play(4)) == {"": [(4, 10), (1, 5)], "pop": [(4, 10), (3, 4)], "rock": [(1, 5)]}


def test_absence_alarms(spark, tmp_path):
    files = Files(spark, tmp_path / "in", "ts timestamp, source string, target string")
    out = stateful.absence_alarms(files.stream(), 10 * 60_000, "5 minutes", span_ms=60_000)
    ms = lambda m: int((at(m) - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    files.add([(at(m), "a", "b") for m in (4, 0, 8)] + [(at(1), "c", "d"), (None, "a", "b")])
    files.add([(at(m), "a", "b") for m in (16, 60, 62)])
    run(spark, tmp_path, out)
    got = {(r["source"], r["kind"], r["last_ts"], r["at"]) for r in read(spark, tmp_path).collect()}
    # Nobody came back, but the watermark went on: the alarms are out before any further beat.
    assert got == {("a", "alarm", ms(16), ms(26)), ("c", "alarm", ms(1), ms(11))}
    files.add([(at(64), "c", "d"), (at(300), "z", "z")])
    run(spark, tmp_path, out)
    files.add([(at(300), "z", "z")])
    run(spark, tmp_path, out)
    rows = [(r["source"], r["kind"], r["last_ts"], r["at"]) for r in read(spark, tmp_path).collect()]
    assert sorted(rows) == sorted(got | {("a", "back", ms(16), ms(60)), ("a", "alarm", ms(62), ms(72)), ("c", "back", ms(1), ms(64)), ("c", "alarm", ms(64), ms(74))})


def test_batches_by_count_or_time(spark, tmp_path):
    files = Files(spark, tmp_path / "in", "ts timestamp, key string, id long, batch string")
    out = stateful.buffered(files.stream(), "key", 3, 60 * 60_000, "1 minute")
    files.add([(at(i), "a", i, "x") for i in range(4)] + [(at(0), "b", 10, "x"), (at(0), None, 20, "x"), (None, "a", 99, "x")])
    run(spark, tmp_path, out)
    files.add([(at(5 + i), "a", 5 + i, "x") for i in range(3)] + [(at(5), "b", 11, "x")])
    run(spark, tmp_path, out)
    files.add([(at(200), "end", 1000, "x")])
    run(spark, tmp_path, out)
    files.add([(at(201), "end", 1001, "x"), (at(201), "b", 12, "x")])
    run(spark, tmp_path, out)
    got = {}
    for r in read(spark, tmp_path).collect():
        got.setdefault((r["key"], r["sent_batch"]), []).append(r["id"])
    assert {k: sorted(v) for k, v in got.items()} == {("a", 0): [0, 1, 2], ("a", 1): [3, 5, 6], ("a", 2): [7], ("b", 0): [10, 11], (None, 0): [20]}


def test_audit_counts_addresses_in_two_steps(spark, tmp_path):
    files = Files(spark, tmp_path / "in", "ts timestamp, user_id long, action string, source_ip string")
    rows = [(at(m), u, "login", ip) for m, u, ip in [(0, 1, "x"), (0, 1, "x"), (1, 1, "y"), (1, 1, None), (2, 2, None), (30, 1, "x"), (31, 2, "z")]] + [(at(1), 1, "other", "q")]
    files.add(rows[::2])
    files.add(rows[1::2])
    audit = windows.login_audit(files.stream().withWatermark("ts", "1 hour"), "10 minutes")
    run(spark, tmp_path, audit)
    files.add([(at(900), 3, "login", "x")])
    run(spark, tmp_path, audit)
    batch = windows.login_audit(spark.createDataFrame(rows, files.schema), "10 minutes")
    assert sorted(tuple(r) for r in read(spark, tmp_path).drop("batch").collect()) == sorted(tuple(r) for r in batch.collect())


def test_restored_records_stay_apart(spark, tmp_path):
    spark.createDataFrame([("k", "v", 1)] * 3 + [("k", "w", 1)], "key string, value string, n int").coalesce(1).write.json(str(tmp_path / "archive" / "topic=t"))
    for _ in range(2):
        back = streams.restore_logs(spark, str(tmp_path / "archive"), str(tmp_path / "index"), "key string, value string, n int")
    assert sorted(r["value"] for r in back.collect()) == ["v", "v", "v", "w"]
