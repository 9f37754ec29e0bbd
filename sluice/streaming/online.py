"""Threshold events while readings come in: runs and merges as state of a station, closed by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sluice.functions import constants as C
from sluice.session import state_in_rocksdb

#: Fields of a tier's state: the open run and the event it may join, minutes since the epoch; n = 0 for none.
_RUN = "run_start long, run_end long, run_n long, run_peak double"
_EVENT = "start long, end long, n long, peak double, merged long"
_OUT = "station_code string, tier_cm double, start long, end long, n_readings long, peak_depth_cm double, n_excursions_merged long"
_NONE = (0, 0, 0, 0.0, 0, 0, 0, 0.0, 0)

Event = tuple[float, int, int, int, float, int]


class Tracker:
    """The rules of one station: feed slots in order, then say up to which minute all are known."""

    def __init__(self, tiers: tuple[float, ...], cadence: int, persistence: int, merge_gap: int):
        self.tiers, self.cadence, self.persistence, self.merge_gap = tiers, cadence, persistence, merge_gap
        self.state = {t: _NONE for t in tiers}
        self.before: int | None = None

    def _close(self, tier: float) -> Iterator[Event]:
        """End the open run: it joins the event before it, or that one is over."""
        start, end, n, peak, *event = self.state[tier]
        e_start, e_end, e_n, e_peak, merged = event
        if n >= self.persistence:
            if merged and start - e_end <= self.merge_gap:
                event = [e_start, end, e_n + n, max(e_peak, peak), merged + 1]
            else:
                if merged:
                    yield tier, e_start, e_end, e_n, e_peak, merged
                event = [start, end, n, peak, 1]
        self.state[tier] = (0, 0, 0, 0.0, *event)

    def step(self, minute: int, depth: float) -> Iterator[Event]:
        hole = self.before is not None and minute - self.before > self.cadence
        self.before = minute
        for tier in self.tiers:
            if self.state[tier][2] and (hole or depth < tier):
                yield from self._close(tier)
            if depth >= tier:
                start, _, n, peak, *event = self.state[tier]
                self.state[tier] = (start if n else minute, minute, n + 1, max(peak, depth) if n else depth, *event)

    def settle(self, now: int) -> Iterator[Event]:
        """Close what no reading from ``now`` on can lengthen or join."""
        for tier in self.tiers:
            if self.state[tier][2] and now - self.state[tier][1] > self.cadence:
                yield from self._close(tier)
            _, _, n, _, e_start, e_end, e_n, e_peak, merged = self.state[tier]
            if merged and not n and now - e_end > self.merge_gap:
                yield tier, e_start, e_end, e_n, e_peak, merged
                self.state[tier] = _NONE

    def next_change(self) -> int | None:
        """The first minute at which ``settle`` would close something."""
        ends = [s[1] + self.cadence + 1 if s[2] else s[5] + self.merge_gap + 1 for s in self.state.values() if s[2] or s[8]]
        return min(ends, default=None)


class _Events(StatefulProcessor):
    """Readings wait until the watermark has passed their slot; then they are taken in order."""

    def __init__(self, rules: tuple, slot: int):
        self.rules, self.slot = rules, slot

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "minute long", "depth double")
        self.tiers = handle.getMapState("tiers", "tier double", f"{_RUN}, {_EVENT}")
        self.last = handle.getValueState("last", "minute long")

    def _advance(self, key: tuple, watermark: int, new: dict[int, float]) -> pd.DataFrame:
        now = watermark // 60_000
        tracker = Tracker(*self.rules)
        if self.last.exists():
            tracker.before = self.last.get()[0]
        for k, v in self.tiers.iterator():
            tracker.state[k[0]] = tuple(v)
        slots = {k[0]: v[0] for k, v in self.waiting.iterator()}
        held = set(slots)
        for minute, depth in new.items():
            if minute not in held or depth > slots[minute]:
                slots[minute] = depth
                if minute + self.slot > now:
                    self.waiting.updateValue((minute,), (depth,))
        found, later = [], None
        for minute in sorted(slots):
            if minute + self.slot > now:
                later = minute + self.slot
                break
            if minute in held:
                self.waiting.removeKey((minute,))
            found += tracker.step(minute, slots[minute])
        found += tracker.settle(now // self.slot * self.slot)
        if tracker.before is not None:
            self.last.update((tracker.before,))
        for tier, s in tracker.state.items():
            if s != _NONE:
                self.tiers.updateValue((tier,), s)
            elif self.tiers.containsKey((tier,)):
                self.tiers.removeKey((tier,))
        due = [m for m in (later, tracker.next_change()) if m is not None]
        if due:  # the watermark must be past a whole slot for time to have moved on
            at = -(-min(due) // self.slot) * self.slot
            self.handle.registerTimer(max(at * 60_000, watermark + 1))
        names = [f.split()[0] for f in _OUT.split(", ")]
        return pd.DataFrame([(key[0], *e) for e in found], columns=names)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        deepest: dict[int, float] = {}  # of each slot over all batches, so that a state call is a slot's, not a reading's
        for batch in rows:
            known = batch[batch["depth"].notna() & ((batch["minute"] + self.slot) * 60_000 > watermark)]  # other slots were closed before
            for minute, depth in known.groupby("minute")["depth"].max().items():
                deepest[int(minute)] = max(float(depth), deepest.get(int(minute), float("-inf")))
        yield self._advance(key, watermark, deepest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._advance(key, timerValues.getCurrentWatermarkInMs(), {})

    def close(self) -> None:
        pass


def events(
    readings: DataFrame, tiers=C.TIERS_CM, value: str = "flood", slot: int = C.CADENCE_MINUTES, cadence: int = C.CADENCE_MINUTES,
    persistence: int = C.PERSISTENCE_READINGS, merge_gap: int = C.MERGE_GAP_MINUTES, min_minutes: int = C.MIN_EVENT_MINUTES, late: str = "24 hours",
) -> DataFrame:
    """The events of ``operators.events.detect`` over a stream ``(station_code, ts, value)``, each put out once it is over.

    Readings may come in any order, up to ``late`` behind the newest; of a
    slot of ``slot`` minutes the deepest counts.  A station keeps the
    readings that the watermark hasn't passed and, per tier, its open run
    and the event that run may join.  An event is over when no reading that
    may still come can lengthen it; a timer tells, so a station that falls
    silent is closed too.
    """
    state_in_rocksdb(readings.sparkSession)
    rules = (tuple(float(t) for t in tiers), cadence, persistence, merge_gap)
    minute = F.floor(F.unix_micros("ts") / 60_000_000).cast("long")
    rows = readings.withWatermark("ts", late).select("station_code", "ts", (minute - F.pmod(minute, F.lit(slot))).alias("minute"), F.col(value).alias("depth"))
    found = rows.groupBy("station_code").transformWithStateInPandas(_Events(rules, slot), _OUT, "Append", "EventTime")
    stamp = lambda c: F.timestamp_seconds(F.col(c) * 60).cast("timestamp_ntz")
    timed = found.withColumns({"started_at": stamp("start"), "ended_at": stamp("end"), "duration_minutes": F.col("end") - F.col("start") + cadence})
    return timed.where(F.col("duration_minutes") >= min_minutes).withColumn("year", F.year("started_at")).drop("start", "end")
