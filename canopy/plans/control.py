"""The dosing decision, evaluated set-based for any number of devices and ticks.

The original evaluates one device at wall-clock ``now``:

1. WAITING         seconds since the newest COMPLETED action < mixing delay
                   (the lookup has no device filter: the lock is global)
2. NO_DATA         no ph or no ec average over the lookback
3. EMERGENCY_STOP  ec > target_ec + 0.3, ph < 4.5 or ph > 8.0
4. DOSE_NUTRI_A/B  target_ec - ec > 0.05; B only if the last pump was nutri_1
5. DOSE_PH_MINUS/PLUS  |ph - target_ph| > 0.15
6. STABLE

:func:`control_replay` evaluates that rule at every tick of a regular grid
for every device -- live control is the one-tick case, a backtest is the
many-tick case.  Plan:

* telemetry (ph, ec only) -> partial sums per (device, slot); ``slot`` is the
  gcd of tick period and lookback, so a tick's window is a whole number of
  slots plus the readings exactly at the tick.  Map-side partial aggregation
  shrinks any hot device to one row per slot before the shuffle.
* window over slots per device (rows per device = number of slots, bounded by
  the time span, not by data volume) -> trailing sums at each tick.
* COMPLETED actions -> last action per tick slot (partial aggregation) ->
  bucketed as-of over the tick grid -> joined on the tick index, by the join
  that adaptive execution picks for the grid's size.
* one CASE expression.
"""

from __future__ import annotations

import datetime as _dt
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy import constants as C
from canopy.functions.numeric import from_micros, micros, sql_avg
from canopy.operators.sequence import asof_join, epoch_us, from_epoch_us
from canopy.sources import bindings
from canopy.sources.tables import event_bounds, ntz


@dataclass
class ControlParams:
    tick_s: int = 3600
    lookback_s: int = 86400
    mixing_delay_s: float = 600.0
    target_ph: float = C.TARGET_PH
    target_ec: float = C.TARGET_EC
    per_device_lock: bool = False
    origin: _dt.datetime | None = None   # first tick; default: hour of the first event
    end: _dt.datetime | None = None      # last tick <= end; default: as_of

    @classmethod
    def from_speed(cls, speed: float = 1.0, **kw) -> "ControlParams":
        """Timing of the original loop for a simulation speed."""
        return cls(tick_s=max(1, int(round(C.CONTROL_PERIOD_REAL_SEC / speed))),
                   lookback_s=int(max(C.LOOKBACK_FLOOR_SEC, C.LOOKBACK_REAL_SEC / speed)),
                   mixing_delay_s=C.MIXING_DELAY_REAL_SEC / speed, **kw)


def decision(avg_ph: Column, avg_ec: Column, elapsed_s: Column, last_pump: Column,
             mixing_delay_s: float | Column, target_ph: float | Column = C.TARGET_PH,
             target_ec: float | Column = C.TARGET_EC) -> Column:
    """The decision rule as one column expression.

    NaN averages count as missing data (the original compares NaN and falls
    through to STABLE; Spark orders NaN above every number, which would give
    EMERGENCY_STOP -- neither is meaningful, so NO_DATA it is).
    """
    tph = target_ph if isinstance(target_ph, Column) else F.lit(float(target_ph))
    tec = target_ec if isinstance(target_ec, Column) else F.lit(float(target_ec))
    delay = mixing_delay_s if isinstance(mixing_delay_s, Column) else F.lit(float(mixing_delay_s))
    missing = (avg_ph.isNull() | avg_ec.isNull() | F.isnan(avg_ph) | F.isnan(avg_ec))
    return (F.when(elapsed_s.isNotNull() & (elapsed_s < delay), C.STATUS_WAITING)
            .when(missing, C.STATUS_NO_DATA)
            .when((avg_ec > tec + F.lit(C.EC_EMERGENCY_MARGIN))
                  | (avg_ph < F.lit(C.PH_EMERGENCY_LOW)) | (avg_ph > F.lit(C.PH_EMERGENCY_HIGH)),
                  C.STATUS_EMERGENCY)
            .when(tec - avg_ec > F.lit(C.EC_DOSE_DEADBAND),
                  F.when(~last_pump.eqNullSafe(C.PUMP_NUTRI_1), C.STATUS_NUTRI_A)
                  .otherwise(C.STATUS_NUTRI_B))
            .when(F.abs(avg_ph - tph) > F.lit(C.PH_DOSE_DEADBAND),
                  F.when(avg_ph > tph, C.STATUS_PH_MINUS).otherwise(C.STATUS_PH_PLUS))
            .otherwise(C.STATUS_STABLE))


def tick_spine(keys: DataFrame, n: int) -> DataFrame:
    """``keys`` x tick index ``j`` in [0, n), generated per key row (explode, not a join)."""
    return keys.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n, 1) - 1).cast("long")))
                       .alias("j")).filter(F.lit(n > 0))


def status_to_pump(status: Column) -> Column:
    expr = F.lit(None).cast("string")
    for st, pump in C.STATUS_TO_PUMP.items():
        expr = F.when(status == st, pump).otherwise(expr)
    return expr


def _grid(spark: SparkSession, sf_dir: str, p: ControlParams):
    if p.origin is not None and p.end is not None:
        origin, end = p.origin, p.end
    else:
        lo, hi = event_bounds(spark, sf_dir)
        origin = p.origin or lo.replace(minute=0, second=0, microsecond=0)
        end = p.end or hi
    n = int((end - origin).total_seconds() // p.tick_s) + 1 if end >= origin else 0
    return origin, end, n


def control_replay(spark: SparkSession, sf_dir: str, p: ControlParams | None = None,
                   telemetry: DataFrame | None = None,
                   actions: DataFrame | None = None,
                   config: DataFrame | None = None,
                   devices: DataFrame | None = None) -> DataFrame:
    """Decision per (device, tick).

    Columns: device_id, tick, status, avg_ph, avg_ec, last_pump, elapsed_s,
    command_target, duration_ms.  ``config`` (one row: target_ph, target_ec,
    e.g. ``current_config``) overrides the targets of ``p``.  ``devices`` (a
    device registry with ``device_id``) replaces the distinct scan of all
    telemetry that otherwise lists the devices.
    """
    p = p or ControlParams()
    origin, end, n = _grid(spark, sf_dir, p)
    tel = telemetry if telemetry is not None else bindings.telemetry(spark, sf_dir)
    act = actions if actions is not None else bindings.actuator_logs(spark, sf_dir)

    g = math.gcd(int(p.tick_s), int(p.lookback_s))          # slot width, seconds
    per_tick = p.tick_s // g
    lookback_slots = p.lookback_s // g
    o_us = int(origin.replace(tzinfo=_dt.timezone.utc).timestamp()) * 1_000_000 + origin.microsecond
    last_tick = origin + _dt.timedelta(seconds=p.tick_s * (n - 1))
    first_needed = origin - _dt.timedelta(seconds=p.lookback_s)

    # -- trailing averages ---------------------------------------------------
    rel = epoch_us("time") - F.lit(o_us)
    readings = (tel.filter(F.col("metric").isin("ph", "ec"))
                .filter((F.col("time") >= ntz(first_needed)) & (F.col("time") <= ntz(last_tick)))
                .select("device_id", "metric", "value",
                        F.floor(rel / F.lit(g * 1_000_000)).cast("long").alias("slot"),
                        (rel % F.lit(g * 1_000_000) == 0).alias("at_start")))
    is_ph = F.col("metric") == "ph"
    is_ec = F.col("metric") == "ec"
    v = micros(F.col("value"))
    at0 = F.col("at_start")
    partials = readings.groupBy("device_id", "slot").agg(
        F.sum(F.when(is_ph, v)).alias("s_ph"), F.count(F.when(is_ph, v)).alias("c_ph"),
        F.sum(F.when(is_ec, v)).alias("s_ec"), F.count(F.when(is_ec, v)).alias("c_ec"),
        F.sum(F.when(is_ph & at0, v)).alias("s0_ph"), F.count(F.when(is_ph & at0, v)).alias("c0_ph"),
        F.sum(F.when(is_ec & at0, v)).alias("s0_ec"), F.count(F.when(is_ec & at0, v)).alias("c0_ec"),
    ).withColumn("is_tick", F.lit(False))

    devices = (devices.select("device_id").distinct() if devices is not None
               else tel.select("device_id").distinct())
    # one row per (device, tick): each device row expands its own tick range (no join)
    spine = tick_spine(devices, n).select("device_id", (F.col("j") * per_tick).alias("slot"),
                                          F.lit(True).alias("is_tick"))

    w_prev = Window.partitionBy("device_id").orderBy("slot").rangeBetween(-lookback_slots, -1)
    w_peer = Window.partitionBy("device_id").orderBy("slot").rangeBetween(0, 0)
    combined = partials.unionByName(spine, allowMissingColumns=True)
    sums = {}
    for m in ("ph", "ec"):
        s = F.coalesce(F.sum(f"s_{m}").over(w_prev), F.lit(0)) + \
            F.coalesce(F.sum(f"s0_{m}").over(w_peer), F.lit(0))
        c = F.coalesce(F.sum(f"c_{m}").over(w_prev), F.lit(0)) + \
            F.coalesce(F.sum(f"c0_{m}").over(w_peer), F.lit(0))
        sums[m] = from_micros(s, c)
    avgs = (combined.withColumn("avg_ph", sums["ph"]).withColumn("avg_ec", sums["ec"])
            .filter(F.col("is_tick"))
            .select("device_id", (F.col("slot") / per_tick).cast("long").alias("j"),
                    "avg_ph", "avg_ec"))

    lock_keys = ["device_id"] if p.per_device_lock else []
    lock = lock_table(spark, act, p, origin, n, devices if lock_keys else None)

    tick = from_epoch_us(F.lit(o_us) + F.col("j") * F.lit(p.tick_s * 1_000_000))
    out = avgs.join(lock, [*lock_keys, "j"], "left").withColumn("tick", tick)
    tph, tec = p.target_ph, p.target_ec
    if config is not None:
        # point lookup of the one current configuration row; its values become literals
        row = config.select("target_ph", "target_ec").limit(1).first()
        if row is not None:
            tph = row["target_ph"] if row["target_ph"] is not None else tph
            tec = row["target_ec"] if row["target_ec"] is not None else tec
    elapsed = (epoch_us("tick") - epoch_us("last_time")) / F.lit(1e6)
    status = decision(F.col("avg_ph"), F.col("avg_ec"), elapsed, F.col("last_pump"),
                      p.mixing_delay_s, tph, tec)
    out = out.withColumn("elapsed_s", elapsed).withColumn("status", status)
    target = status_to_pump(F.col("status"))
    return out.select(
        "device_id", F.col("tick").cast("timestamp_ntz").alias("tick"), "status",
        "avg_ph", "avg_ec",
        "last_pump", F.round("elapsed_s", 3).alias("elapsed_s"),
        target.alias("command_target"),
        F.when(target.isNotNull(), F.lit(C.BASE_PULSE_MS)).alias("duration_ms"))


def lock_table(spark: SparkSession, act: DataFrame, p: ControlParams, origin: _dt.datetime,
               n: int, devices: DataFrame | None = None) -> DataFrame:
    """Last COMPLETED action at or before each tick: (j[, device_id], last_time, last_pump).

    Actions are reduced to one row per tick slot (partial aggregation), then
    carried over the tick grid by the bucketed as-of join on tick time, so no
    single task holds the grid.
    """
    lock_keys = ["device_id"] if devices is not None else []
    o_us = int(origin.replace(tzinfo=_dt.timezone.utc).timestamp()) * 1_000_000 + origin.microsecond
    last_tick = origin + _dt.timedelta(seconds=p.tick_s * (n - 1))
    arel = epoch_us("time") - F.lit(o_us)
    done = (act.filter(F.col("action") == "COMPLETED")
            .filter(F.col("time") <= ntz(last_tick))
            .select(*lock_keys, "time", "actuator_id", "id",
                    F.greatest(F.lit(0), F.ceil(arel / F.lit(p.tick_s * 1_000_000)))
                    .cast("long").alias("j")))
    last_per_slot = done.groupBy(*lock_keys, "j").agg(
        F.max_by(F.struct("time", "actuator_id"), F.struct("time", "id")).alias("a"))
    grid = spark.range(0, n).select(F.col("id").alias("j")) if not lock_keys else tick_spine(devices, n)

    def tick_at(j):
        return from_epoch_us(F.lit(o_us) + j * F.lit(p.tick_s * 1_000_000))
    grid = grid.withColumn("__tick", tick_at(F.col("j")))
    right = last_per_slot.select(*lock_keys, tick_at(F.col("j")).alias("__slot_tick"),
                                 F.col("j").alias("__rj"), F.col("a.time").alias("last_time"),
                                 F.col("a.actuator_id").alias("last_pump"))
    filled = asof_join(grid, right, lock_keys, "__tick", "__slot_tick",
                       {"last_time": "last_time", "last_pump": "last_pump"}, right_order="__rj",
                       matched_time=None)
    return filled.select(*lock_keys, "j", "last_time", "last_pump")


def mixing_lock(spark: SparkSession, sf_dir: str, p: ControlParams | None = None) -> DataFrame:
    """Per tick: newest COMPLETED action, seconds since it, and whether dosing must wait."""
    p = p or ControlParams()
    origin, _, n = _grid(spark, sf_dir, p)
    o_us = int(origin.replace(tzinfo=_dt.timezone.utc).timestamp()) * 1_000_000 + origin.microsecond
    lock = lock_table(spark, bindings.actuator_logs(spark, sf_dir), p, origin, n)
    tick = from_epoch_us(F.lit(o_us) + F.col("j") * F.lit(p.tick_s * 1_000_000))
    elapsed = (epoch_us(tick) - epoch_us("last_time")) / F.lit(1e6)
    return lock.select(tick.alias("tick"), "last_time", "last_pump",
                       F.round(elapsed, 3).alias("elapsed_s"),
                       F.coalesce(elapsed < F.lit(float(p.mixing_delay_s)), F.lit(False)).alias("waiting"))


def mixing_lock_sql(p: ControlParams | None = None) -> str:
    p = p or ControlParams()
    return bindings.with_views("actuator_logs") + f""",
bounds AS (SELECT date_trunc('hour', min(ts)) AS origin, max(ts) AS as_of FROM events),
ticks AS (
  SELECT j, tick FROM (
    SELECT j, origin + j * INTERVAL {p.tick_s} SECOND AS tick, as_of
    FROM (SELECT origin, as_of, unnest(range(0, date_diff('second', origin, as_of) // {p.tick_s} + 1)) AS j FROM bounds))
  WHERE tick <= as_of),
l AS (
  SELECT t.tick, a.time AS last_time, a.actuator_id AS last_pump,
         date_diff('microsecond', a.time, t.tick) / 1e6 AS elapsed_s
  FROM ticks t ASOF LEFT JOIN
       (SELECT time, actuator_id FROM actuator_logs WHERE action = 'COMPLETED') a ON t.tick >= a.time)
SELECT tick, last_time, last_pump, round(elapsed_s, 3) AS elapsed_s,
       coalesce(elapsed_s < {float(p.mixing_delay_s)}e0, false) AS waiting
FROM l"""


def _lock_sql(p: ControlParams) -> str:
    if p.per_device_lock:
        return """lock AS (
  SELECT s.device_id, s.tick, a.time AS last_time, a.actuator_id AS last_pump
  FROM (SELECT d.device_id, t.tick FROM devices d, ticks t) s ASOF LEFT JOIN
       (SELECT device_id, time, actuator_id FROM actuator_logs WHERE action = 'COMPLETED') a
       ON s.device_id = a.device_id AND s.tick >= a.time)"""
    return """lock AS (
  SELECT t.tick, a.time AS last_time, a.actuator_id AS last_pump
  FROM ticks t ASOF LEFT JOIN
       (SELECT time, actuator_id FROM actuator_logs WHERE action = 'COMPLETED') a
       ON t.tick >= a.time)"""


def control_replay_sql(p: ControlParams | None = None) -> str:
    """Same computation as DuckDB SQL over the driver tables (oracle)."""
    p = p or ControlParams()
    return bindings.with_views("telemetry", "actuator_logs") + f""",
bounds AS (SELECT date_trunc('hour', min(ts)) AS origin, max(ts) AS as_of FROM events),
ticks AS (
  SELECT j, tick FROM (
    SELECT j, origin + j * INTERVAL {p.tick_s} SECOND AS tick, as_of
    FROM (SELECT origin, as_of, unnest(range(0, date_diff('second', origin, as_of) // {p.tick_s} + 1)) AS j FROM bounds))
  WHERE tick <= as_of),
devices AS (SELECT DISTINCT device_id FROM telemetry),
avgs AS (
  SELECT d.device_id, t.tick,
         {sql_avg("x.value", "x.metric = 'ph'")} AS avg_ph,
         {sql_avg("x.value", "x.metric = 'ec'")} AS avg_ec
  FROM devices d CROSS JOIN ticks t
  LEFT JOIN telemetry x ON x.device_id = d.device_id AND x.metric IN ('ph', 'ec')
       AND x.time >= t.tick - INTERVAL {p.lookback_s} SECOND AND x.time <= t.tick
  GROUP BY d.device_id, t.tick),
{_lock_sql(p)},
j AS (
  SELECT v.device_id, v.tick, v.avg_ph, v.avg_ec, l.last_pump,
         date_diff('microsecond', l.last_time, v.tick) / 1e6 AS elapsed_s
  FROM avgs v LEFT JOIN lock l ON v.tick = l.tick{" AND v.device_id = l.device_id" if p.per_device_lock else ""}),
d AS (
  SELECT *, CASE
    WHEN elapsed_s IS NOT NULL AND elapsed_s < {float(p.mixing_delay_s)}e0 THEN 'WAITING'
    WHEN avg_ph IS NULL OR avg_ec IS NULL OR isnan(avg_ph) OR isnan(avg_ec) THEN 'NO_DATA'
    WHEN avg_ec > {p.target_ec}e0 + 3e-1 OR avg_ph < 4.5e0 OR avg_ph > 8e0 THEN 'EMERGENCY_STOP'
    WHEN {p.target_ec}e0 - avg_ec > 5e-2 THEN
      CASE WHEN last_pump IS DISTINCT FROM 'pump_nutri_1' THEN 'DOSE_NUTRI_A' ELSE 'DOSE_NUTRI_B' END
    WHEN abs(avg_ph - {p.target_ph}e0) > 1.5e-1 THEN
      CASE WHEN avg_ph > {p.target_ph}e0 THEN 'DOSE_PH_MINUS' ELSE 'DOSE_PH_PLUS' END
    ELSE 'STABLE' END AS status
  FROM j)
SELECT device_id, tick, status, avg_ph, avg_ec,
       last_pump, round(elapsed_s, 3) AS elapsed_s,
       CASE status WHEN 'DOSE_NUTRI_A' THEN 'pump_nutri_1' WHEN 'DOSE_NUTRI_B' THEN 'pump_nutri_2'
                   WHEN 'DOSE_PH_MINUS' THEN 'pump_ph_minus' WHEN 'DOSE_PH_PLUS' THEN 'pump_ph_plus' END
         AS command_target,
       CASE WHEN status LIKE 'DOSE%' THEN {C.BASE_PULSE_MS} END AS duration_ms
FROM d"""
