"""Keyed streaming state: live control per device, heartbeat timeouts.

Rows are reduced by (device, time slot) in a watermarked window aggregation
first, so a device with many rows reaches its state function as one row a
slot.  The functions keep one small state row per device in the state store
(checkpointed to the shared folder) and act on event time only.
"""

from __future__ import annotations

import datetime as _dt
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from canopy.functions.numeric import SCALE, micros
from canopy.operators.sequence import epoch_us, from_epoch_us
from canopy.plans.control import ControlParams, decision, status_to_pump
from canopy import constants as C

# ---------------------------------------------------------------------------
# live control
# ---------------------------------------------------------------------------

SUMS = ["s_ph", "c_ph", "s_ec", "c_ec"]          # of a slot; the same of readings exactly at its end: e_...
CONTROL_OUT = ("device_id string, j long, tick_us long, avg_ph double, avg_ec double, "
               "last_pump string, elapsed_s double")
# next tick; slots in order (number, 8 sums each); slots with a completed action (number, its time and pump)
CONTROL_STATE = "j_next long, slots array<long>, sums array<long>, act_slots array<long>, act_us array<long>, act_pumps array<string>"


def control_inputs(telemetry: DataFrame, actions: DataFrame) -> DataFrame:
    """One stream of readings (ph, ec) and completed actions, keyed by device."""
    r = telemetry.filter(F.col("metric").isin("ph", "ec")).select(
        "device_id", F.lit("r").alias("kind"), epoch_us("time").alias("t_us"), "metric", "value",
        F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("actuator_id"))
    a = actions.filter(F.col("action") == "COMPLETED").select(
        "device_id", F.lit("a").alias("kind"), epoch_us("time").alias("t_us"),
        F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value"), "id", "actuator_id")
    return r.unionByName(a)


def _slots(p: ControlParams) -> tuple[int, int]:
    """Origin and slot width in microseconds; ticks and lookback are whole numbers of slots."""
    origin = p.origin.replace(tzinfo=_dt.timezone.utc)
    return int(origin.timestamp()) * 1_000_000 + origin.microsecond, math.gcd(int(p.tick_s), int(p.lookback_s)) * 1_000_000


def control_slots(inputs: DataFrame, p: ControlParams, delay: str) -> DataFrame:
    """One row per (device, slot): sums of the readings, and the last completed action.

    Slot s holds the times in (origin + (s - 1) * width, origin + s * width];
    it is emitted once the watermark has passed its end.
    """
    o_us, g_us = _slots(p)
    # a microsecond earlier, so that a slot's end belongs to it (windows are closed at their start)
    rows = inputs.withColumn("at", F.timestamp_micros(F.col("t_us") - 1)).withWatermark("at", delay)
    at_end = (F.col("t_us") - F.lit(o_us)) % F.lit(g_us) == 0
    v = micros(F.col("value"))  # null, NaN and infinite readings count as missing
    sums = []
    for prefix, when in (("", F.lit(True)), ("e_", at_end)):
        for m in ("ph", "ec"):
            x = F.when((F.col("metric") == m) & when, v)
            sums += [F.coalesce(F.sum(x), F.lit(0)).alias(f"{prefix}s_{m}"), F.count(x).alias(f"{prefix}c_{m}")]
    act = F.max(F.when(F.col("kind") == "a", F.struct("t_us", "id", "actuator_id")))
    slot = F.window("at", f"{g_us} microseconds", startTime=f"{o_us % g_us} microseconds")
    agg = rows.groupBy(slot.alias("w"), "device_id").agg(*sums, act.alias("act"))
    return agg.select("device_id", F.window_time("w").alias("slot_time"),
                      ((F.unix_micros("w.end") - F.lit(o_us)) / F.lit(g_us)).cast("long").alias("slot"),
                      *SUMS, *[f"e_{c}" for c in SUMS], F.col("act.t_us").alias("act_us"), F.col("act.actuator_id").alias("act_pump"))


class LiveControl(StatefulProcessor):
    """Averages and last action of one device at every tick that the watermark has passed."""

    def __init__(self, p: ControlParams):
        self.o_us, self.g_us = _slots(p)
        self.tick_us = p.tick_s * 1_000_000
        self.per_tick, self.look = self.tick_us // self.g_us, p.lookback_s * 1_000_000 // self.g_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("control", CONTROL_STATE)

    def _load(self):
        if not self.state.exists():
            return 0, np.zeros(0, np.int64), np.zeros((0, 8), np.int64), [], [], []
        j, slots, sums, act_slots, act_us, pumps = self.state.get()
        return j, np.array(slots, np.int64), np.array(sums, np.int64).reshape(-1, 8), list(act_slots), list(act_us), list(pumps)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        j, slots, sums, act_slots, act_us, pumps = self._load()
        new = pd.concat(list(rows)).sort_values("slot")   # a device's closed slots of this batch
        slots = np.concatenate([slots, new["slot"].to_numpy(np.int64)])
        sums = np.concatenate([sums, new[[*SUMS, *[f"e_{c}" for c in SUMS]]].to_numpy(np.int64)])
        acts = new[new["act_us"].notna()]
        act_slots += acts["slot"].tolist()
        act_us += acts["act_us"].astype("int64").tolist()
        pumps += acts["act_pump"].tolist()
        yield from self._ticks(key, j, slots, sums, act_slots, act_us, pumps, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            yield from self._ticks(key, *self._load(), timerValues)

    def _ticks(self, key, j, slots, sums, act_slots, act_us, pumps, timers):
        passed = timers.getCurrentWatermarkInMs() * 1000
        ticks = np.arange(j, max(j, (passed - self.o_us) // self.tick_us + 1), dtype=np.int64)
        if len(ticks):
            at = ticks * self.per_tick
            total = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(sums[:, :4], axis=0)])
            upto, before = np.searchsorted(slots, at, "right"), np.searchsorted(slots, at - self.look, "right")
            got = total[upto] - total[before]
            # a lookback is closed at both ends: readings exactly at its begin are in the slot before
            edge = (before > 0) & (slots[before - 1] == at - self.look) if len(slots) else np.zeros(len(at), bool)
            got[edge] += sums[before[edge] - 1, 4:]
            last = np.searchsorted(np.array(act_slots, np.int64), at, "right") - 1
            t_us = self.o_us + ticks * self.tick_us

            def mean(s, c):
                return [a / b / float(SCALE) if b else None for a, b in zip(s.tolist(), c.tolist())]
            out = pd.DataFrame({"device_id": key[0], "j": ticks, "tick_us": t_us, "avg_ph": mean(got[:, 0], got[:, 1]),
                                "avg_ec": mean(got[:, 2], got[:, 3]), "last_pump": [pumps[i] if i >= 0 else None for i in last.tolist()],
                                "elapsed_s": [(t - act_us[i]) / 1e6 if i >= 0 else None for t, i in zip(t_us.tolist(), last.tolist())]})
            yield out.astype({"avg_ph": "float64", "avg_ec": "float64", "elapsed_s": "float64"})
            j = int(ticks[-1]) + 1
        # what later ticks can still use: their lookback, and the last action before the next tick
        keep = slots >= j * self.per_tick - self.look
        old = max(0, int(np.searchsorted(np.array(act_slots, np.int64), j * self.per_tick, "right")) - 1)
        self.state.update((j, slots[keep].tolist(), sums[keep].ravel().tolist(), act_slots[old:], act_us[old:], pumps[old:]))
        self.handle.registerTimer((self.o_us + j * self.tick_us) // 1000)

    def close(self) -> None:
        pass


def control_state_stream(inputs: DataFrame, p: ControlParams, delay: str = "1 hour") -> DataFrame:
    """Live dosing decisions per device and tick from a stream of readings and actions.

    Rows may come in any order up to ``delay`` behind the newest one; a tick is
    emitted once the watermark has passed it, by a timer where the device is
    silent, and never changes.  The keyed form evaluates the lock per device (a
    global lock would put every device in one group).  The decision is the same
    column expression as the batch replay.  Needs the RocksDB state store.
    """
    if p.origin is None:
        raise ValueError("streaming control needs ControlParams.origin (the tick grid)")
    rows = control_slots(inputs, p, delay).groupBy("device_id").transformWithStateInPandas(
        LiveControl(p), CONTROL_OUT, "Append", "EventTime")
    tick = from_epoch_us(F.col("tick_us"))
    status = decision(F.col("avg_ph"), F.col("avg_ec"), F.col("elapsed_s"), F.col("last_pump"),
                      p.mixing_delay_s, p.target_ph, p.target_ec)
    out = rows.withColumn("tick", tick).withColumn("status", status)
    target = status_to_pump(F.col("status"))
    return out.select("device_id", "tick", "status", "avg_ph", "avg_ec", "last_pump",
                      F.round("elapsed_s", 3).alias("elapsed_s"), target.alias("command_target"),
                      F.when(target.isNotNull(), F.lit(C.BASE_PULSE_MS)).alias("duration_ms"))


# ---------------------------------------------------------------------------
# heartbeat timeout
# ---------------------------------------------------------------------------

HEARTBEAT_OUT = "device_id string, last_us long, silent_us long"


def _heartbeat_fn(gap_s: float):
    gap_ms = int(gap_s * 1000)

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last_us,) = state.get
            state.remove()
            wm_us = state.getCurrentWatermarkMs() * 1000
            yield pd.DataFrame({"device_id": [key[0]], "last_us": [last_us], "silent_us": [wm_us - last_us]})
            return
        last_us = state.get[0] if state.exists else None
        for pdf in pdfs:
            if not pdf.empty:
                mx = int(pdf["t_us"].max())  # epoch micros: no time zone involved
                last_us = mx if last_us is None else max(last_us, mx)
        if last_us is not None:
            state.update((last_us,))
            state.setTimeoutTimestamp(last_us // 1000 + gap_ms)
    return fn


def heartbeat_timeout_stream(telemetry: DataFrame, gap_s: float = 300.0, delay: str = "1 minute") -> DataFrame:
    """One alert per device that stays silent longer than ``gap_s`` (event time):
    ``(device_id, last_seen, silent_s)``, emitted when the watermark passes the timeout."""
    t = (telemetry.select("device_id", F.timestamp_micros(epoch_us("time")).alias("time"),
                          epoch_us("time").alias("t_us"))
         .withWatermark("time", delay))
    out = t.groupBy("device_id").applyInPandasWithState(
        _heartbeat_fn(gap_s), HEARTBEAT_OUT, "last_us long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("device_id", from_epoch_us(F.col("last_us")).alias("last_seen"),
                      (F.col("silent_us") / F.lit(1e6)).alias("silent_s"))
