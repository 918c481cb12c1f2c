"""Calls of a state store, which take a millisecond each, don't grow with a batch's keys and hours."""

import collections

import pandas as pd

from millrace.streaming import stateful, streams


class Store:
    """A handle whose states are dictionaries; it counts calls."""

    def __init__(self):
        self.calls, self.timers = 0, []

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.append(at)

    def __getattr__(self, name):
        if not name.startswith("get"):
            raise AttributeError(name)
        return lambda *_: State(self)


class State:
    def __init__(self, store):
        self.store, self.held = store, {}

    def _called(self):
        self.store.calls += 1

    def getValue(self, key):  # noqa: N802
        self._called()
        return self.held.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self._called()
        self.held[key] = value

    def removeKey(self, key):  # noqa: N802
        self._called()
        self.held.pop(key, None)

    def containsKey(self, key):  # noqa: N802
        self._called()
        return key in self.held

    def exists(self):
        self._called()
        return None in self.held

    def get(self):
        self._called()
        return self.held.get(None)

    def update(self, value):
        self._called()
        self.held[None] = value

    put = update


Times = collections.namedtuple("Times", "at")
Times.getCurrentWatermarkInMs = lambda self: self.at
Times.getExpiryTimeInMs = lambda self: self.at
HOUR = 3_600_000


def test_calls_of_rows_that_wait():
    rows = pd.DataFrame({"us": [h * HOUR * 1000 + k for h in range(400) for k in range(5)], "event_id": range(2000), "state_key": [f'{{"user_id":{k}}}' for _ in range(400) for k in range(5)], "value": 1.0, "slot": 0})
    store = Store()
    counter = stateful.BreachCounter(60, 3, HOUR)
    counter.init(store)
    list(counter.handleInputRows((0,), iter([rows]), Times(0)))
    assert store.calls < 10
    out = pd.concat(counter.handleExpiredTimer((0,), Times(300 * HOUR), Times(300 * HOUR)))
    assert store.calls < 30 and len(out) == 1500
    out = pd.concat([out, *counter.handleExpiredTimer((0,), Times(900 * HOUR), Times(900 * HOUR))])
    assert store.calls < 50 and sorted(out["counter"]) == sorted([*range(1, 401)] * 5)


def test_calls_of_a_chart():
    store = Store()
    chart = stateful.ChartProcessor(2)
    chart.init(store)
    plays = pd.DataFrame({"genre": "g", "shard": 0, "song_id": [s for s in range(3000) for _ in range(2)]})
    list(chart.handleInputRows(("g", 0), iter([plays]), None))
    assert store.calls < 200


def test_calls_of_batches():
    store = Store()
    batches = stateful.CountOrTime(5, 10 * HOUR)
    batches.init(store)
    rows = pd.DataFrame({"us": range(3000), "state_key": [str(i % 700) for i in range(3000)], "payload": [str(i) for i in range(3000)]})
    out = pd.concat(batches.handleInputRows((0,), iter([rows]), Times(0)))
    assert len(out) == 200 * 5 and store.calls < 10
    out = pd.concat(batches.handleExpiredTimer((0,), Times(11 * HOUR), Times(11 * HOUR)))
    assert len(out) == 2000 and store.calls < 20


def test_rows_of_a_null_key_go_out_together(spark):
    rows = spark.createDataFrame([(k, i) for k in (1, None, 2) for i in range(12)], "key long, i long")

    def one(part):
        return pd.DataFrame({"key": [part["key"].iloc[0]], "n": [len(part)], "first": [part["i"].iloc[0]]})

    out = streams.process_by_key(rows, "key", ["i"], one, "key long, n long, first long", 5, 2)
    assert sorted(tuple(r) for r in out.fillna(0).collect()) == [(k, n, f) for k in (0, 1, 2) for n, f in ((2, 10), (5, 0), (5, 5))]
