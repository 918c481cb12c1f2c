"""Stateful stream operators: aggregates that can take a value back, charts, and threshold alerts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: transformWithState needs this state store.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here keep their state in RocksDB; afterwards the session is as before."""
    name, store = ROCKSDB
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class RetractableAgg(Protocol):
    """An aggregate that rows can enter and leave."""

    def add(self, item: Any, value: Any) -> None: ...

    def remove(self, item: Any) -> None: ...

    def result(self) -> list[tuple[Any, Any]]: ...


class TopNAgg:
    """The n largest values, ties by the smaller item. It keeps all items, so that one which falls can be overtaken."""

    def __init__(self, n: int, items: dict | None = None):
        self.n, self.items = n, dict(items or {})

    def add(self, item, value) -> None:
        self.items[item] = value

    def remove(self, item) -> None:
        self.items.pop(item, None)

    def result(self) -> list[tuple[Any, Any]]:
        return sorted(self.items.items(), key=lambda x: (-x[1], x[0]))[: self.n]


def _bytes(frame: pd.DataFrame, schema: pa.Schema) -> bytes:
    """A frame as one value of a state."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(pa.Table.from_pandas(frame, schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _frame(value: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(value)).read_all().to_pandas()


class Pieces:
    """Numbers of a shard's songs in a map state: songs are dealt into pieces, a value for each, so that a batch calls the store for a piece and not for a song, and rewrites the
    pieces of its songs alone."""

    COUNT = 64
    SCHEMA = pa.schema([("song_id", pa.int64()), ("plays", pa.int64())])

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.state = handle.getMapState(name, "piece int", "songs binary")

    def _read(self, piece: int) -> pd.Series:
        value = self.state.getValue((piece,))
        return pd.Series(dtype="int64") if value is None else _frame(value[0]).set_index("song_id")["plays"]

    def change(self, new: pd.Series, combine: Callable[[pd.Series, pd.Series], pd.Series]) -> pd.Series:
        """combine(numbers so far of the songs, theirs in new) become the numbers of the songs in new, null for none; returns them."""
        # The six highest bits of a product, which have nothing to do with the hash that dealt the songs into shards.
        piece = (new.index.to_numpy(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58)).astype(int)
        out = []
        for p in np.unique(piece).tolist():
            mine, held = new[piece == p], self._read(p)
            now = combine(held.reindex(mine.index), mine)
            kept = pd.concat([held[~held.index.isin(mine.index)], now.dropna()]).astype("int64")
            if len(kept):
                self.state.updateValue((p,), (_bytes(pd.DataFrame({"song_id": kept.index.astype("int64"), "plays": kept.to_numpy()}), self.SCHEMA),))
            elif len(held):
                self.state.removeKey((p,))
            out.append(now)
        return pd.concat(out) if out else new

    def all(self) -> Iterator[pd.Series]:
        for p in range(self.COUNT):
            held = self._read(p)
            if len(held):
                yield held


def _first(plays: pd.Series, n: int) -> dict[int, int]:
    """The n largest values, ties by the smaller song."""
    ids, values = plays.index.to_numpy(np.int64), plays.to_numpy(np.int64)
    if len(ids) > n:
        large = values >= np.partition(values, -n)[-n]
        ids, values = ids[large], values[large]
    order = np.lexsort((ids, -values))[:n]
    return dict(zip(ids[order].tolist(), values[order].tolist(), strict=True))


class ChartProcessor(StatefulProcessor):
    """State of a genre's shard: plays of each song, and its chart. A batch's plays move songs from their old count to the new one;
    only these can enter the chart, so the other songs aren't looked at."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = Pieces(handle, "counts")
        self.chart = handle.getListState("chart", "song_id long, plays long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        agg = TopNAgg(self.n, dict(self.chart.get()) if self.chart.exists() else {})
        more = _summed(part.groupby("song_id").size() for part in rows)
        for song, plays in _first(self.counts.change(more, lambda old, new: old.fillna(0).astype("int64") + new), self.n + len(agg.items)).items():
            agg.add(song, plays)
        best = agg.result()
        self.chart.put([(s, p) for s, p in best])
        yield pd.DataFrame({"genre": [key[0]] * len(best), "shard": [key[1]] * len(best), "rank": range(1, len(best) + 1), "song_id": [s for s, _ in best], "plays": [p for _, p in best]})

    def close(self) -> None:
        pass


def _summed(parts: Iterator[pd.Series]) -> pd.Series:
    """Sums by index of series that come one after another."""
    total = pd.Series(dtype="int64", index=pd.Index([], dtype="int64"))
    for part in parts:
        part.index = part.index.astype("int64")
        total = pd.concat([total, part]).groupby(level=0).sum().astype("int64")
    return total


def top_n_stream(plays: DataFrame, n: int = 5, shards: int = 8) -> DataFrame:
    """(genre, shard, rank, song_id, plays): the chart of each genre's shard that a batch has plays of, in update mode. plays: genre, song_id.
    Songs are dealt into shards, so that a genre isn't one task's; streams.chart ranks the shards' charts together."""
    schema = "genre string, shard int, rank int, song_id long, plays long"
    dealt = plays.select("genre", F.pmod(F.xxhash64("song_id"), F.lit(shards)).cast("int").alias("shard"), "song_id")
    return dealt.groupBy("genre", "shard").transformWithStateInPandas(statefulProcessor=ChartProcessor(n), outputStructType=schema, outputMode="Update", timeMode="None")


class Ordered(StatefulProcessor):
    """Base of operators that need a key's rows in order of time. A state is a slot of many keys, so that the store, which takes a millisecond for a call, is called for a
    slot's rows and not for each of them. Rows (columns us, microseconds, and state_key; names with a line in front get lost on the way) wait in chunks, some for each micro-batch; a
    timer reads the chunks with a span of time that the watermark has passed, and what isn't due yet is written back. So the order of arrival doesn't matter within the watermark's
    delay. A slot's rows that become due at once are in memory; what its keys hold is one value.
    Subclasses name their columns and what a key holds and implement due(), and passed() and wakes() for what they do without rows."""

    #: Rows of a chunk, but for what comes in one piece.
    CHUNK = 1 << 16

    def __init__(self, columns: pa.Schema, held: pa.Schema, span_ms: int):
        self.columns, self.held, self.span = columns, held, span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "n long", "rows binary")
        self.waits = handle.getValueState("waits", "spans string, timer long")
        self.keys = handle.getValueState("keys", "rows binary")

    def _waiting(self) -> tuple[dict[int, list[int]], int | None]:
        """({chunk: its first and last span}, the timer that is set)."""
        found = self.waits.get()
        spans, timer = found if found is not None else ("{}", None)
        return {int(n): x for n, x in json.loads(spans).items()}, timer

    def _wait(self, spans: dict[int, list[int]], timer: int | None, wakes: int | None) -> None:
        times = [(first + 1) * self.span for first, _ in spans.values()] + ([] if wakes is None else [wakes])
        if times and (timer is None or min(times) < timer):
            timer = min(times)
            self.handle.registerTimer(timer)
        self.waits.update((json.dumps(spans), timer))

    def _write(self, n: int, rows: pd.DataFrame, spans: dict[int, list[int]]) -> None:
        self.chunks.updateValue((n,), (_bytes(rows[self.columns.names], self.columns),))
        spans[n] = [int(rows["us"].min()) // (1000 * self.span), int(rows["us"].max()) // (1000 * self.span)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        spans, timer = self._waiting()
        parts, count = [], 0
        for part in rows:
            parts.append(part)
            count += len(part)
            if count >= self.CHUNK:
                self._write(max(spans, default=-1) + 1, pd.concat(parts), spans)
                parts, count = [], 0
        if count:
            self._write(max(spans, default=-1) + 1, pd.concat(parts), spans)
        self._wait(spans, timer, None)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        spans, timer = self._waiting()
        if timer is not None and timer > watermark:
            return
        found = self.keys.get()
        held = (_frame(found[0]) if found is not None else self.held.empty_table().to_pandas()).set_index("state_key")
        end = watermark // self.span
        parts = []
        for n, (first, last) in list(spans.items()):
            if first < end:
                rows = _frame(self.chunks.getValue((n,))[0])
                late = rows["us"] // (1000 * self.span) >= end
                parts.append(rows[~late])
                if last < end:
                    self.chunks.removeKey((n,))
                    del spans[n]
                else:
                    self._write(n, rows[late], spans)
        if parts:
            rows = pd.concat(parts, ignore_index=True).sort_values(["state_key", *(c for c in self.columns.names if c != "state_key")], na_position="first", ignore_index=True)
            out, new = self.due(rows, held)
            held = pd.concat([held[~held.index.isin(rows["state_key"])], new])
            if len(out):
                yield out
        out, held = self.passed(held, watermark)
        if len(out):
            yield out
        self.keys.update((_bytes(held.rename_axis("state_key").reset_index(), self.held),))
        self._wait(spans, None, self.wakes(held))

    def due(self, rows: pd.DataFrame, held: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """(rows that go out, what the keys of these rows hold then) for the next rows by key, time and the other columns; held is by key."""
        raise NotImplementedError

    def passed(self, held: pd.DataFrame, watermark: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        """(rows that go out, what the keys hold then) when all rows before the watermark's span are in."""
        return pd.DataFrame(), held

    def wakes(self, held: pd.DataFrame) -> int | None:
        """When passed() is needed next, if no row comes."""
        return None

    def close(self) -> None:
        pass


def _starts(keys: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first row of each row's key, which rows are the last of their key) of rows by key."""
    values = keys.to_numpy()
    new = np.r_[True, values[1:] != values[:-1]]
    return np.maximum.accumulate(np.where(new, np.arange(len(values)), 0)), np.r_[new[1:], True]


def _timed(df: DataFrame, ts: str, delay: str, *columns: Any) -> DataFrame:
    """ts, us and the columns of a stream; rows without a time can't be ordered and take no part."""
    return df.where(F.col(ts).isNotNull()).withWatermark(ts, delay).select(ts, F.unix_micros(ts).alias("us"), *columns)


def _key(*columns: str) -> Column:
    """The key of a state as text: null keys, which Spark's Python workers may mix with others, become text too."""
    return F.to_json(F.struct(*columns)).alias("state_key")


def _by_time(rows: DataFrame, slots: int, processor: StatefulProcessor, schema: str) -> DataFrame:
    dealt = rows.withColumn("slot", F.pmod(F.xxhash64("state_key"), F.lit(slots)).cast("int"))
    return dealt.groupBy("slot").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


#: States that the keys of a stream are dealt into; a stream's number stays as it was when it began.
SLOTS = 64


class BreachCounter(Ordered):
    """A key holds its breaches in a row; keys without any are left out."""

    def __init__(self, limit: int, threshold: int, span_ms: int):
        columns = pa.schema([("us", pa.int64()), ("event_id", pa.int64()), ("value", pa.float64()), ("state_key", pa.string())])
        super().__init__(columns, pa.schema([("state_key", pa.string()), ("n", pa.int64())]), span_ms)
        self.limit, self.threshold = limit, threshold

    def due(self, rows: pd.DataFrame, held: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        breach = np.trunc(rows["value"].to_numpy(np.float64)) < self.limit
        start, last = _starts(rows["state_key"])
        at = np.arange(len(rows))
        reset = np.maximum.accumulate(np.where(breach, -1, at))
        before = held["n"].reindex(rows["state_key"]).fillna(0).to_numpy(np.int64)
        counters = np.where(reset >= start, at - reset, at - start + 1 + before)
        new = pd.DataFrame({"n": counters[last]}, index=rows["state_key"][last])
        return pd.DataFrame({"state_key": rows["state_key"], "event_id": rows["event_id"], "counter": counters, "fires": counters >= self.threshold}), new[new["n"] > 0]


def breach_stream(df: DataFrame, limit: int, threshold: int, delay: str, span_ms: int = 3_600_000, slots: int = SLOTS) -> DataFrame:
    """(event_id, user_id, counter, fires) for every row of a stream of (ts, event_id, user_id, value), in order of ts and event_id of each
    user. A breach is a truncated value below the limit. A row comes out when the watermark, which stays delay behind the newest row, has passed its span of time. A value that is null or no number is no breach. Rows
    without a time, and rows that come when the watermark has passed them, take no part."""
    rows = _timed(df, "ts", delay, "event_id", _key("user_id"), F.col("value").cast("double").alias("value"))
    out = _by_time(rows, slots, BreachCounter(limit, threshold, span_ms), "state_key string, event_id long, counter int, fires boolean")
    return out.select("event_id", F.from_json("state_key", "user_id long")["user_id"].alias("user_id"), "counter", "fires")


class ChangelogJoin(Ordered):
    """A key holds its table row; keys without one are left out."""

    def __init__(self, span_ms: int):
        columns = pa.schema([("us", pa.int64()), ("side", pa.int32()), ("place", pa.int64()), ("payload", pa.string()), ("state_key", pa.string())])
        super().__init__(columns, pa.schema([("state_key", pa.string()), ("payload", pa.string())]), span_ms)

    def due(self, rows: pd.DataFrame, held: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        event = rows["side"].to_numpy() == 1
        start, last = _starts(rows["state_key"])
        change = np.maximum.accumulate(np.where(event, -1, np.arange(len(rows))))
        payload = rows["payload"].to_numpy(object)
        now = np.where(change >= start, payload[change], held["payload"].reindex(rows["state_key"]).to_numpy(object))
        now = np.where(pd.isna(now), None, now)
        new = pd.DataFrame({"payload": now[last]}, index=rows["state_key"][last])
        return pd.DataFrame({"event": payload[event], "row": now[event]}), new[new["payload"].notna()]


#: Whole microseconds survive the way through JSON.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


def changelog_join(events: DataFrame, changes: DataFrame, key: str, delay: str, order: str = "offset", ts: str = "ts", deleted: str = "deleted", shards: int = 1, span_ms: int = 3_600_000, slots: int = SLOTS) -> DataFrame:
    """Each event of a stream with the columns that its key had in a table at the event's time; the table is a stream of changes.

    changes: ts, key, order, deleted (the key leaves the table) and the table's columns. A change counts for events of its time and later; of
    changes of one time the one of the larger order counts. Events without a row in the table have nulls. Both sides wait until the
    watermark, the earlier one of both streams, has passed them, so they may come in any order within the delay. shards deals the
    events of a key to several states, each with a copy of the key's changes. Columns of the table that events have too get the suffix _table. A null key
    meets nothing; rows without a time, or later than the watermark, take no part.
    """
    columns = [c for c in changes.columns if c not in (ts, key, order, deleted)]
    named = {c: f"{c}_table" if c in events.columns else c for c in columns}
    left = _timed(events.select(F.col(ts), F.struct(*events.columns).alias("e")), ts, delay, _key(f"e.{key}"), F.to_json("e", JSON).alias("payload"))
    left = left.select("us", ts, "state_key", F.pmod(F.xxhash64("payload"), F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("place"), "payload")
    row = F.when(~F.coalesce(F.col(deleted), F.lit(False)), F.to_json(F.struct(*(F.col(c) for c in columns)), JSON))
    right = _timed(changes.where(F.col(key).isNotNull()), ts, delay, _key(key), F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 63))).alias("place"), row.alias("payload"))
    right = right.select("us", ts, "state_key", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(0).alias("side"), "place", "payload")
    both = left.unionByName(right).withColumn("state_key", F.concat("shard", F.lit(" "), "state_key")).drop("shard")
    joined = _by_time(both, slots, ChangelogJoin(span_ms), "event string, row string")
    event, held = F.from_json("event", events.schema, JSON), F.from_json("row", changes.select(*columns).schema, JSON)
    return joined.select(event.alias("e"), held.alias("t")).select("e.*", *(F.col(f"t.{c}").alias(n) for c, n in named.items()))


class SongCounts(StatefulProcessor):
    """State of a slot of songs: the genre of each by its newest change, and its plays. Emits what a chart loses and gains: (chart, song_id, old, new), null for not in it."""

    HELD = pa.schema([("song_id", pa.int64()), ("genre", pa.string()), ("version", pa.int64()), ("plays", pa.int64())])
    PAIRS = ["chart", "song_id", "old", "new"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.songs = handle.getValueState("songs", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        plays, newest = [], self.HELD.empty_table().to_pandas()[["song_id", "genre", "version"]]
        for part in rows:
            plays.append(part[part["play"]].groupby("song_id").size())
            newest = pd.concat([newest, part[~part["play"]][["song_id", "genre", "version"]]]).sort_values("version", kind="stable").drop_duplicates("song_id", keep="last")
        more, newest = _summed(iter(plays)), newest.set_index("song_id")
        held = (_frame(self.songs.get()[0]) if self.songs.exists() else self.HELD.empty_table().to_pandas()).set_index("song_id")
        touched = more.index.union(newest.index.astype("int64"))
        was = held.reindex(touched)
        old = was["plays"].fillna(0).astype("int64")
        # No song has a version before its first change.
        least = np.iinfo(np.int64).min
        change = newest.reindex(touched)
        changed = pd.Series(touched.isin(newest.index), touched)
        newer = changed & (was["version"].isna() | (_whole(change["version"], least) >= _whole(was["version"], least)))
        genre = change["genre"].where(newer, was["genre"])
        new = old + more.reindex(touched).fillna(0).astype("int64")
        now = pd.DataFrame({"genre": genre, "version": _whole(change["version"], least).where(newer, _whole(was["version"], least)), "plays": new}, index=touched)
        kept = pd.concat([held[~held.index.isin(touched)], now]).rename_axis("song_id").reset_index()
        self.songs.update((_bytes(kept, self.HELD),))
        before, after = was["genre"].where(old > 0), genre.where(new > 0)
        out = pd.DataFrame({"song_id": touched, "was": before.to_numpy(object), "now": after.to_numpy(object), "old": pd.array(old, "Int64"), "new": pd.array(new, "Int64")})
        had, has = out["was"].notna(), out["now"].notna()
        same = had & has & (out["was"] == out["now"])
        risen = out[same & (out["old"] != out["new"])]
        left, entered = out[had & ~same], out[has & ~same]
        whole = out[(had | has) & ~(had & has & (out["old"] == out["new"]))]
        pairs = [
            risen.assign(chart=risen["now"]), left.assign(chart=left["was"], new=pd.array([None] * len(left), "Int64")), entered.assign(chart=entered["now"], old=pd.array([None] * len(entered), "Int64")),
            whole.assign(chart=ALL, old=whole["old"].where(had[whole.index]), new=whole["new"].where(has[whole.index])),
        ]
        sent = pd.concat(pairs, ignore_index=True)[self.PAIRS]
        if len(sent):
            yield sent

    def close(self) -> None:
        pass


def _whole(values: pd.Series, missing: int) -> pd.Series:
    return values.fillna(missing).astype("int64")


#: Name of the chart of all songs.
ALL = ""


class RetractingChart(StatefulProcessor):
    """State of a chart's shard: the plays of its songs, and its first n. A song that rises or enters is compared with these alone; only where one of them falls or
    leaves are the shard's songs looked at again."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = Pieces(handle, "counts")
        self.best = handle.getListState("best", "song_id long, plays long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        agg = TopNAgg(self.n, dict(self.best.get()) if self.best.exists() else {})
        again = False
        for part in rows:
            old, new = (pd.Series(pd.to_numeric(part[c]).to_numpy(np.float64, na_value=np.nan), part["song_id"].astype("int64")) for c in ("old", "new"))
            fallen = new.isna() | (new < old)
            again |= bool(fallen.index[fallen].isin(agg.items.keys()).any())
            now = self.counts.change(new, lambda _, x: x)
            for song in now.index.intersection(list(agg.items)):
                agg.remove(song)
            for song, plays in _first(now.dropna(), 2 * self.n).items():
                agg.add(song, plays)
            agg = TopNAgg(self.n, dict(agg.result()))
        if again:
            for held in self.counts.all():
                for song, plays in _first(held, self.n).items():
                    agg.add(song, plays)
            agg = TopNAgg(self.n, dict(agg.result()))
        best = agg.result()
        self.best.put([(s, p) for s, p in best]) if best else self.best.clear()
        rest = [(None, None)] * (self.n - len(best))
        songs, plays = zip(*best, *rest, strict=True)
        yield pd.DataFrame({"chart": key[0], "shard": key[1], "rank": range(1, self.n + 1), "song_id": pd.array(songs, "Int64"), "plays": pd.array(plays, "Int64")})

    def close(self) -> None:
        pass


def retracting_charts(plays: DataFrame, songs: DataFrame, n: int = 5, shards: int = 8, slots: int = SLOTS) -> DataFrame:
    """(chart, shard, rank, song_id, plays): the first n of each shard of a chart that changed; ranks without a song have nulls. A chart is a genre, or ALL.

    Two stateful operators: the first counts a song's plays, knows its genre and sends what changes as a pair of old and new; the second takes old
    counts out and new ones in, so that a song which changes its genre leaves the one chart and enters the other. plays: song_id. songs: song_id,
    genre (null where the song is deleted), version; the largest version counts, whatever comes first. Plays of a song without a genre are counted
    and show as soon as it has one. Null songs and changes without a version take no part.
    """
    changes = songs.select("song_id", "genre", F.col("version").cast("long").alias("version"), F.lit(False).alias("play")).where(F.col("version").isNotNull())
    both = plays.select("song_id", F.lit(None).cast("string").alias("genre"), F.lit(0).cast("long").alias("version"), F.lit(True).alias("play")).unionByName(changes)
    slotted = both.where(F.col("song_id").isNotNull()).withColumn("slot", F.pmod(F.xxhash64("song_id"), F.lit(slots)).cast("int"))
    pairs = slotted.groupBy("slot").transformWithStateInPandas(statefulProcessor=SongCounts(), outputStructType="chart string, song_id long, old long, new long", outputMode="Append", timeMode="None")
    dealt = pairs.withColumn("shard", F.pmod(F.xxhash64("song_id"), F.lit(shards)).cast("int"))
    schema = "chart string, shard int, rank int, song_id long, plays long"
    return dealt.groupBy("chart", "shard").transformWithStateInPandas(statefulProcessor=RetractingChart(n), outputStructType=schema, outputMode="Append", timeMode="None")


class AbsenceAlarm(Ordered):
    """A key, a pair, holds its last beat and whether its absence was told."""

    def __init__(self, gap_ms: int, span_ms: int):
        super().__init__(pa.schema([("us", pa.int64()), ("state_key", pa.string())]), pa.schema([("state_key", pa.string()), ("ms", pa.int64()), ("told", pa.bool_())]), span_ms)
        self.gap = gap_ms

    def _told(self, kind: str, key: np.ndarray, last: np.ndarray, at: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"state_key": key, "kind": kind, "last_ts": last, "at": at})

    def due(self, rows: pd.DataFrame, held: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        key, ms = rows["state_key"].to_numpy(object), rows["us"].to_numpy(np.int64) // 1000
        start, last = _starts(rows["state_key"])
        first = start == np.arange(len(rows))
        known = held.reindex(rows["state_key"])
        some = ~first | known["ms"].notna().to_numpy()
        before = np.where(first, known["ms"].fillna(0).to_numpy(np.int64), np.r_[0, ms[:-1]])
        told = first & (known["told"].to_numpy(object) == True)  # noqa: E712
        back = some & (ms - before > self.gap)
        alarm = back & ~told
        out = pd.concat([self._told("alarm", key[alarm], before[alarm], before[alarm] + self.gap), self._told("back", key[back], before[back], ms[back])])
        return out, pd.DataFrame({"ms": ms[last], "told": False}, index=rows["state_key"][last])

    def _time(self, held: pd.DataFrame) -> pd.Series:
        """The end of the span in which a pair's absence is certain: all beats before it are in."""
        return -(-(held["ms"].astype("int64") + self.gap + 1) // self.span) * self.span

    def passed(self, held: pd.DataFrame, watermark: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        absent = ~held["told"].astype(bool) & (self._time(held) <= watermark)
        last = held["ms"][absent].to_numpy(np.int64)
        return self._told("alarm", held.index[absent].to_numpy(object), last, last + self.gap), held.assign(told=held["told"].astype(bool) | absent)

    def wakes(self, held: pd.DataFrame) -> int | None:
        times = self._time(held[~held["told"].astype(bool)])
        return int(times.min()) if len(times) else None


def absence_alarms(beats: DataFrame, gap_ms: int, delay: str, ts: str = "ts", span_ms: int = 60_000, slots: int = SLOTS) -> DataFrame:
    """(source, target, kind, last_ts, at) of a stream of (ts, source, target): an alarm where no beat follows within gap_ms of the last one, told once the
    watermark has passed that time's span, whether or not another beat comes; and 'back' with the beat that ends it. Times are in milliseconds."""
    out = _by_time(_timed(beats, ts, delay, _key("source", "target")), slots, AbsenceAlarm(gap_ms, span_ms), "state_key string, kind string, last_ts long, at long")
    pair = F.from_json("state_key", "source string, target string")
    return out.select(pair["source"].alias("source"), pair["target"].alias("target"), "kind", "last_ts", "at")


class CountOrTime(StatefulProcessor):
    """State of a slot of keys: rows that wait for their batch to fill, in the order of their arrival, and the number of each key's next batch."""

    ROWS = pa.schema([("state_key", pa.string()), ("ms", pa.int64()), ("payload", pa.string())])
    NEXT = pa.schema([("state_key", pa.string()), ("batch", pa.int64())])

    def __init__(self, n: int, wait_ms: int):
        self.n, self.wait = n, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getValueState("rows", "rows binary, timer long")
        self.next = handle.getValueState("next", "rows binary")

    def _held(self) -> tuple[pd.DataFrame, pd.Series, int | None]:
        rows, timer = self.rows.get() if self.rows.exists() else (None, None)
        batches = _frame(self.next.get()[0]) if self.next.exists() else self.NEXT.empty_table().to_pandas()
        return self.ROWS.empty_table().to_pandas() if rows is None else _frame(rows), batches.set_index("state_key")["batch"], timer

    def _keep(self, waiting: pd.DataFrame, batches: pd.Series, timer: int | None) -> None:
        deadline = int(waiting.groupby("state_key")["ms"].first().min()) + self.wait if len(waiting) else None
        if deadline is not None and (timer is None or deadline < timer):
            self.handle.registerTimer(deadline)
            timer = deadline
        self.rows.update((_bytes(waiting, self.ROWS), timer))
        self.next.update((_bytes(batches.rename("batch").rename_axis("state_key").reset_index(), self.NEXT),))

    def _sent(self, rows: pd.DataFrame, batches: pd.Series, place: np.ndarray | int) -> tuple[pd.DataFrame, pd.Series]:
        """(rows with their batch, the next batches of all keys)."""
        batch = batches.reindex(rows["state_key"]).fillna(0).to_numpy(np.int64) + place
        after = pd.Series(batch + 1, rows["state_key"]).groupby(level=0).max()
        return pd.DataFrame({"batch": batch, "payload": rows["payload"].to_numpy(object)}), pd.concat([batches[~batches.index.isin(after.index)], after])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting, batches, timer = self._held()
        for part in rows:
            part = pd.DataFrame({"state_key": part["state_key"], "ms": part["us"] // 1000, "payload": part["payload"]})
            waiting = pd.concat([waiting, part], ignore_index=True)
            keys = waiting.groupby("state_key")["ms"]
            place = keys.cumcount() // self.n
            full = place < keys.transform("size") // self.n
            if full.any():
                out, batches = self._sent(waiting[full], batches, place[full].to_numpy())
                yield out
                waiting = waiting[~full]
        self._keep(waiting, batches, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting, batches, timer = self._held()
        if timer is not None and timer > timerValues.getCurrentWatermarkInMs():
            return
        over = waiting.groupby("state_key")["ms"].transform("first") + self.wait <= timerValues.getCurrentWatermarkInMs()
        if over.any():
            out, batches = self._sent(waiting[over], batches, 0)
            yield out
        self._keep(waiting[~over], batches, None)

    def close(self) -> None:
        pass


def buffered(df: DataFrame, key: str, n: int, wait_ms: int, delay: str, ts: str = "ts", slots: int = SLOTS) -> DataFrame:
    """The rows of a stream with sent_batch, the number of the batch in which they go out: n rows of a key, in the order of their arrival and across micro-batches and restarts, or
    fewer when the watermark is wait_ms past the batch's first row. Fewer than n rows of a key wait in state. Rows without a time take no part."""
    rows = _timed(df.select(F.col(ts), F.struct(*df.columns).alias("e")), ts, delay, _key(f"e.{key}"), F.to_json("e", JSON).alias("payload"))
    out = _by_time(rows, slots, CountOrTime(n, wait_ms), "batch long, payload string")
    return out.select("batch", F.from_json("payload", df.schema, JSON).alias("e")).select("e.*", F.col("batch").alias("sent_batch"))
