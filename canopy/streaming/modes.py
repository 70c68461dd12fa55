"""Operating modes as a stream: a state machine a device, driven by signals and timers.

Signals are reduced by (device, minute) in a watermarked aggregation: of a
minute's readings only the first and the last, besides faults, acknowledgements
and manual actions.  A minute is handed on when the watermark has passed it, so
the machine sees minutes in order whatever the order of arrival; silence is
found by a timer.  The result equals :func:`canopy.plans.modes.transitions`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from canopy.operators.sequence import from_epoch_us
from canopy.plans.modes import ACK, FAULT, SILENCE_S, START, STOP

MINUTE_US = 60_000_000     # shorter than a silence: there is none within a minute that has readings
LIMIT_US = SILENCE_S * 1_000_000
OUT = "device_id string, t_us long, mode string, previous string"
STATE = "last_us long, silent boolean, latch string, upkeep string, mode string"


def mode_minutes(sig: DataFrame, delay: str) -> DataFrame:
    """One row per (device, minute): first and last reading, and the other signals in order."""
    rows = sig.withColumn("at", F.timestamp_micros("t_us")).withWatermark("at", delay)
    what = F.when(F.col("what").isNotNull(), F.struct("t_us", "what"))
    agg = rows.groupBy(F.window("at", f"{MINUTE_US} microseconds").alias("w"), "device_id").agg(
        F.min(F.when(F.col("seen"), F.col("t_us"))).alias("first"), F.max(F.when(F.col("seen"), F.col("t_us"))).alias("last"),
        F.sort_array(F.collect_set(what)).alias("signals"))
    return agg.select("device_id", F.window_time("w").alias("minute"), F.unix_micros("w.start").alias("start"), "first", "last",
                      F.transform("signals", lambda s: s["t_us"]).alias("times"), F.transform("signals", lambda s: s["what"]).alias("kinds"))


class ModeMachine(StatefulProcessor):
    """Mode changes of one device."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("mode", STATE)

    def _load(self):
        self.last, self.silent, self.latch, self.upkeep, self.mode = self.state.get() if self.state.exists() else (None, False, None, None, None)
        self.out = []

    def _settle(self, t: int) -> None:
        mode = "SAFETY" if self.latch == FAULT else "MAINTENANCE" if self.upkeep == START else "DEGRADED" if self.silent else "NORMAL"
        if mode != self.mode:
            self.out.append((t, mode, self.mode))
            self.mode = mode

    def _silence(self, before: int) -> None:
        """Begin the silence that is due before the instant."""
        if self.last is not None and not self.silent and self.last + LIMIT_US < before:
            self.silent = True
            self._settle(self.last + LIMIT_US)

    def _minute(self, first: int | None, last: int | None, marks: list[tuple[int, str]]) -> None:
        points: dict[int, set[str]] = {}
        for t, kind in marks:
            points.setdefault(t, set()).add(kind)
        if first is not None:
            points.setdefault(first, set())
        for t in sorted(points):
            self._silence(t)
            if first is not None and t >= first:
                self.last, self.silent = max(t if t <= last else last, first), False
            elif self.last is not None and self.last + LIMIT_US == t:
                self.silent = True  # silence begins at this very instant
            kinds = points[t]
            self.latch = FAULT if FAULT in kinds else ACK if ACK in kinds else self.latch
            self.upkeep = START if START in kinds else STOP if STOP in kinds else self.upkeep
            self._settle(t)
        if last is not None:
            self.last = last

    def _finish(self, key, timers) -> Iterator[pd.DataFrame]:
        passed = timers.getCurrentWatermarkInMs() * 1000
        if self.last is not None and not self.silent:
            # the minute in which the silence would begin must have passed, or a reading in it may be still to come
            closed = ((self.last + LIMIT_US) // MINUTE_US + 1) * MINUTE_US
            if closed <= passed:
                self._silence(closed)
            else:
                self.handle.registerTimer(closed // 1000)
        self.state.update((self.last, self.silent, self.latch, self.upkeep, self.mode))
        if self.out:
            yield pd.DataFrame([(key[0], *o) for o in self.out], columns=["device_id", "t_us", "mode", "previous"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        minutes = pd.concat(list(rows)).sort_values("start")
        for first, last, times, kinds in zip(minutes["first"], minutes["last"], minutes["times"], minutes["kinds"]):
            self._minute(*(None if pd.isna(x) else int(x) for x in (first, last)), [(int(t), k) for t, k in zip(times, kinds)])
        yield from self._finish(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        yield from self._finish(key, timerValues)

    def close(self) -> None:
        pass


def mode_stream(sig: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(device_id, time, mode, previous) whenever a device's mode changes; signals may come ``delay`` late."""
    rows = mode_minutes(sig, delay).groupBy("device_id").transformWithStateInPandas(ModeMachine(), OUT, "Append", "EventTime")
    return rows.select("device_id", from_epoch_us(F.col("t_us")).alias("time"), "mode", "previous")
