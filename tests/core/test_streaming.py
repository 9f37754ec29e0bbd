"""Streams that get their readings in several runs, out of order and late."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluice.operators import events
from sluice.streaming import live, online
from sluice.streaming.online import Tracker

T0 = datetime(2024, 5, 1)
SCHEMA = "station_code string, ts timestamp_ntz, flood double"


def readings(n=300):
    """Readings of three stations: wet stretches, holes, missing values."""
    rng = random.Random(3)
    rows = []
    for s in range(3):
        depth = 0.0
        for k in range(n):
            depth = max(0.0, depth + rng.choice([-12, -4, 0, 5, 11]))
            if rng.random() > 0.08:
                rows.append((f"S{s}", T0 + timedelta(minutes=5 * k), None if rng.random() < 0.05 else depth))
    return rows


@pytest.mark.parametrize(("persistence", "gap", "least"), [(2, 60, 10), (1, 20, 0)])
def test_online_events_are_the_batch_events(spark, persistence, gap, least):
    rows = readings()
    rules = {"persistence": persistence, "merge_gap": gap, "min_minutes": least}
    rng = random.Random(5)
    order = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rng.uniform(0, 300)))  # up to five hours late
    feed = live.Feed(spark, SCHEMA)
    make = lambda stream: online.events(stream, (5, 15, 30), late="6 hours", **rules)
    for k in range(3):
        feed.add(spark.createDataFrame(order[k * len(order) // 3 : (k + 1) * len(order) // 3], SCHEMA))
        feed.run(make(feed.source()))
    early = feed.out().count()
    got = feed.closed(make, "2030-01-01")
    want = events.detect(spark.createDataFrame(rows, SCHEMA), (5, 15, 30), **rules)
    key = lambda df: sorted(map(str, df.select(*sorted(want.columns)).collect()))
    assert feed.dropped == 0
    assert 0 < early < want.count()
    assert key(got) == key(want)


def test_a_tracker_closes_what_cannot_grow():
    t = Tracker((10.0,), cadence=5, persistence=2, merge_gap=60)
    assert [e for m, d in ((0, 20.0), (5, 30.0), (10, 0.0)) for e in t.step(m, d)] == []
    assert list(t.settle(65)) == []
    assert t.next_change() == 66
    assert list(t.settle(66)) == [(10.0, 0, 5, 2, 30.0, 1)]
    assert t.next_change() is None


def windows(spark, minutes):
    schema = live.EVENTS
    feed = live.Feed(spark, schema)
    rows = lambda stamps: spark.createDataFrame([(k, T0 + timedelta(minutes=m), 1, "a", float(m), "") for k, m in enumerate(stamps)], schema)
    for stamps in minutes:
        feed.add(rows(stamps))
        feed.run(live.tumbling(feed.source()))
    return feed


def test_a_late_row_is_dropped_counted_and_windows_leave_the_state(spark):
    hour = 60
    feed = windows(spark, [[0, 10, 20, 40], [40 * hour, 1], [80 * hour, 80 * hour - 25 * hour, 80 * hour - 23 * hour], [200 * hour]])
    # the second run's minute 1 is behind the newest reading but not behind the watermark of its batch; 25 hours are
    out = {(r.window_start, r.n) for r in feed.out().collect()}
    assert (T0, 3) in out
    assert feed.dropped == 0
    feed.add(spark.createDataFrame([(9, T0 + timedelta(hours=200 - 25), 1, "a", 1.0, "")], live.EVENTS))
    feed.run(live.tumbling(feed.source()))
    assert feed.dropped == 1
    assert not any(r.window_start == T0 + timedelta(hours=175) for r in feed.out().collect())
    assert max(feed.state) > feed.state[-1]


def test_sliding_windows_end_once(spark):
    feed = live.Feed(spark, live.EVENTS)
    feed.add(spark.createDataFrame([(k, T0 + timedelta(minutes=20 * k), 1, "a", float(k), "") for k in range(9)], live.EVENTS))
    feed.run(live.sliding(feed.source(), 1, 30))
    got = feed.closed(lambda s: live.sliding(s, 1, 30), "2030-01-01").where(F.col("event_type") == "a").collect()
    want = {}
    for k in range(9):
        for end in range(0, 300, 30):
            if end - 60 <= 20 * k < end:
                n, top = want.get(end, (0, 0.0))
                want[end] = (n + 1, max(top, float(k)))
    assert {((r.ts - T0).total_seconds() / 60, r.n, r.max_value) for r in got} == {(e, *v) for e, v in want.items()}


def test_state_calls_of_a_slot_do_not_grow_with_its_readings():
    class Held(dict):
        calls = 0

        def iterator(self):
            return iter(list(self.items()))

        def containsKey(self, key):  # noqa: N802
            self.calls += 1
            return key in self

        def getValue(self, key):  # noqa: N802
            self.calls += 1
            return self[key]

        def updateValue(self, key, value):  # noqa: N802
            self.calls += 1
            self[key] = value

    class Handle:
        def __init__(self):
            self.waiting, self.timers = Held(), []

        def getMapState(self, name, *_):  # noqa: N802
            return self.waiting if name == "waiting" else Held()

        def getValueState(self, *_):  # noqa: N802
            return type("Value", (), {"exists": lambda self: False})()

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

    handle = Handle()
    made = online._Events(((10.0,), 5, 1, 20), 5)
    made.init(handle)
    batches = [pd.DataFrame({"minute": [0, 5, 10, 5], "depth": [float(k), None, 3.0, k + 1.0]}) for k in range(50)]
    (out,) = made.handleInputRows(("S",), iter(batches), type("Times", (), {"getCurrentWatermarkInMs": lambda self: 0})())
    assert not len(out) and handle.waiting == {(0,): (49.0,), (5,): (50.0,), (10,): (3.0,)}
    assert handle.waiting.calls == 3
