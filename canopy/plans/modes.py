"""Operating modes of a device, as the design notes specify them.

SAFETY       a sensor value beyond its extreme tolerance, or a critical event, until someone acknowledges it
MAINTENANCE  between a manual start and a manual stop
DEGRADED     no reading for more than 5 minutes
NORMAL       otherwise

in this order of precedence.  The machine's memory is three flags; each signal
sets at most one of each, and signals of one instant count together (a fault
beats an acknowledgement, a start beats a stop).  :func:`transitions` gives the
changes of mode, :mod:`canopy.streaming.modes` the same as a stream.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy import constants as C
from canopy.operators.sequence import asof_join, asof_last_values, epoch_us, from_epoch_us, prev_row
from canopy.plans.registry import register
from canopy.session import shared_dir
from canopy.sources import bindings as B
from canopy.sources.tables import as_of, event_bounds

SILENCE_S = 300            # a device that sends nothing for longer is offline
BUCKET_S = 86400.0         # signals of a device are put in order a day at a time
MODE_TICK_S = 3600
FAULT, ACK, START, STOP = "FAULT", "ACK", "ON", "OFF"   # the greater of two at one instant holds

W_S = B.with_views("telemetry", "system_events")


def beyond_tolerance(metric: Column, value: Column) -> Column:
    """True for readings at or beyond the extreme limits of their metric (NaN and infinite ones as well)."""
    bad = F.lit(False)
    for m, (_, _, _, lo, hi) in C.METRIC_LIMITS.items():
        bad = F.when(metric == m, (value <= lo) | (value >= hi)).otherwise(bad)  # NaN orders above every number
    return F.coalesce(bad, F.lit(False))


def signals(telemetry: DataFrame, events: DataFrame) -> DataFrame:
    """(device_id, t_us, seen, what): readings, and FAULT, ACK, ON, OFF.

    Of events the category is the device; critical ones are faults, resolved
    ones of level CRITICAL or WARNING acknowledge, INFO ones are the manual
    start (open) and stop (resolved) of maintenance.
    """
    r = telemetry.select("device_id", epoch_us("time").alias("t_us"), F.lit(True).alias("seen"),
                         F.when(beyond_tolerance(F.col("metric"), F.col("value")), FAULT).alias("what"))
    info = F.col("level") == "INFO"
    what = (F.when(info, F.when(F.col("is_resolved"), STOP).otherwise(START)).when(F.col("is_resolved"), ACK)
            .when(F.col("level") == "CRITICAL", FAULT))
    e = events.select(F.col("category").alias("device_id"), epoch_us("time").alias("t_us"), F.lit(False).alias("seen"), what.alias("what"))
    return r.unionByName(e.where("what is not null"))


def transitions(sig: DataFrame, until_us: int) -> DataFrame:
    """(device_id, time, mode, previous) whenever a device's mode changes, up to ``until_us``.

    Readings count only where a silence begins or ends, so the ordered part
    holds few of them; a device's signals are ordered in (device, day) pieces.
    """
    seen = sig.where("seen").select("device_id", "t_us").distinct().withColumn("time", from_epoch_us(F.col("t_us")))
    gaps = prev_row(seen, ["device_id"], "time", {"t_us": "before"}, bucket_s=BUCKET_S)
    limit = SILENCE_S * 1_000_000
    none = F.lit(None).cast("string")
    back = gaps.where(F.col("before").isNull() | (F.col("t_us") - F.col("before") > limit))
    still = (back.select("device_id", (F.col("before") + limit).alias("t_us")).where("t_us is not null")
             .unionByName(seen.groupBy("device_id").agg((F.max("t_us") + limit).alias("t_us"))))
    flags = (back.select("device_id", "t_us", F.lit(False).alias("silent"), none.alias("latch"), none.alias("upkeep"))
             .unionByName(still.select("device_id", "t_us", F.lit(True).alias("silent"), none.alias("latch"), none.alias("upkeep")))
             .unionByName(sig.where("what is not null").select(
                 "device_id", "t_us", F.lit(None).cast("boolean").alias("silent"), F.when(F.col("what").isin(FAULT, ACK), F.col("what")).alias("latch"),
                 F.when(F.col("what").isin(START, STOP), F.col("what")).alias("upkeep"))))
    points = (flags.where(F.col("t_us") <= until_us).groupBy("device_id", "t_us")
              .agg(F.max("silent").alias("silent"), F.max("latch").alias("latch"), F.max("upkeep").alias("upkeep"))
              .withColumn("time", from_epoch_us(F.col("t_us"))))
    shared_dir(points.sparkSession)
    points = points.checkpoint()  # few rows, read several times below; the readings are read here only
    memory = asof_last_values(points.select("device_id", "time"), points, ["device_id"], "time", "time",
                              {"silent": "silent", "latch": "latch", "upkeep": "upkeep"}, bucket_s=BUCKET_S)
    mode = memory.select("device_id", "time", mode_of(F.col("latch"), F.col("upkeep"), F.col("silent")).alias("mode"))
    changes = prev_row(mode, ["device_id"], "time", {"mode": "previous"}, bucket_s=BUCKET_S)
    return changes.where(~F.col("mode").eqNullSafe(F.col("previous")))


def mode_of(latch: Column, upkeep: Column, silent: Column) -> Column:
    return (F.when(latch == FAULT, "SAFETY").when(upkeep == START, "MAINTENANCE").when(silent, "DEGRADED").otherwise("NORMAL"))


def bound_signals(spark, sf_dir) -> DataFrame:
    return signals(B.telemetry(spark, sf_dir), B.system_events(spark, sf_dir))


def _us(t: _dt.datetime) -> int:
    return int(t.replace(tzinfo=_dt.timezone.utc).timestamp()) * 1_000_000 + t.microsecond


_BAD = " ".join(f"WHEN '{m}' THEN value <= {lo}e0 OR value >= {hi}e0" for m, (_, _, _, lo, hi) in C.METRIC_LIMITS.items())
TRANSITIONS_CTE = W_S + f""",
sig AS (
  SELECT device_id, time, true AS seen, CASE WHEN CASE metric {_BAD} ELSE false END THEN 'FAULT' END AS what FROM telemetry
  UNION ALL
  SELECT category, time, false, CASE WHEN level = 'INFO' THEN CASE WHEN is_resolved THEN 'OFF' ELSE 'ON' END
                                     WHEN is_resolved THEN 'ACK' WHEN level = 'CRITICAL' THEN 'FAULT' END FROM system_events),
reads AS (SELECT device_id, time, lag(time) OVER w AS before, lead(time) OVER w AS after
          FROM (SELECT DISTINCT device_id, time FROM sig WHERE seen) WINDOW w AS (PARTITION BY device_id ORDER BY time)),
raw AS (
  SELECT device_id, time, false AS silent, NULL AS latch, NULL AS upkeep FROM reads
  UNION ALL
  SELECT device_id, time + INTERVAL {SILENCE_S} SECOND, true, NULL, NULL FROM reads
  WHERE after IS NULL OR after > time + INTERVAL {SILENCE_S} SECOND
  UNION ALL
  SELECT device_id, time, NULL, CASE WHEN what IN ('FAULT', 'ACK') THEN what END, CASE WHEN what IN ('ON', 'OFF') THEN what END
  FROM sig WHERE what IS NOT NULL),
points AS (SELECT device_id, time, max(silent) AS silent, max(latch) AS latch, max(upkeep) AS upkeep FROM raw
           WHERE time <= (SELECT max(ts) FROM events) GROUP BY device_id, time),
memory AS (SELECT device_id, time, last_value(silent IGNORE NULLS) OVER w AS silent, last_value(latch IGNORE NULLS) OVER w AS latch,
                  last_value(upkeep IGNORE NULLS) OVER w AS upkeep
           FROM points WINDOW w AS (PARTITION BY device_id ORDER BY time ROWS UNBOUNDED PRECEDING)),
modes AS (SELECT device_id, time, CASE WHEN latch = 'FAULT' THEN 'SAFETY' WHEN upkeep = 'ON' THEN 'MAINTENANCE'
                                       WHEN silent THEN 'DEGRADED' ELSE 'NORMAL' END AS mode FROM memory),
changes AS (SELECT * FROM (SELECT device_id, time, mode, lag(mode) OVER (PARTITION BY device_id ORDER BY time) AS previous FROM modes)
            WHERE mode IS DISTINCT FROM previous)"""


@register("mode_transitions", TRANSITIONS_CTE + "\nSELECT device_id, time, mode, previous FROM changes")
def mode_transitions(spark, sf_dir):
    """Every change of a device's operating mode."""
    return transitions(bound_signals(spark, sf_dir), _us(as_of(spark, sf_dir)))


def _tick_sql(last_only: bool = False) -> str:
    return TRANSITIONS_CTE + f""",
bounds AS (SELECT date_trunc('hour', min(ts)) AS origin, max(ts) AS as_of FROM events),
ticks AS (
  SELECT tick FROM (
    SELECT origin + j * INTERVAL {MODE_TICK_S} SECOND AS tick, as_of
    FROM (SELECT origin, as_of, unnest(range(0, date_diff('second', origin, as_of) // {MODE_TICK_S} + 1)) AS j FROM bounds))
  WHERE tick <= as_of{" AND tick + INTERVAL " + str(MODE_TICK_S) + " SECOND > as_of" if last_only else ""}),
spine AS (SELECT d.device_id, t.tick FROM (SELECT DISTINCT device_id FROM sig WHERE seen OR what IS NOT NULL) d, ticks t)
SELECT s.device_id, s.tick, coalesce(c.mode, 'NORMAL') AS mode
FROM spine s ASOF LEFT JOIN changes c ON s.device_id = c.device_id AND s.tick >= c.time"""


def modes_at_ticks(spark, sf_dir, last_only: bool = False) -> DataFrame:
    """Mode per device and tick: the last change at or before it, NORMAL before the first signal."""
    sig = bound_signals(spark, sf_dir)
    lo, hi = event_bounds(spark, sf_dir)
    origin = lo.replace(minute=0, second=0, microsecond=0)
    n = int((hi - origin).total_seconds() // MODE_TICK_S) + 1
    j = F.explode(F.sequence(F.lit(n - 1 if last_only else 0).cast("long"), F.lit(n - 1).cast("long")))
    spine = sig.select("device_id").distinct().select("device_id", j.alias("j")).select(
        "device_id", from_epoch_us(F.lit(_us(origin)) + F.col("j") * (MODE_TICK_S * 1_000_000)).alias("tick"))
    at = asof_join(spine, transitions(sig, _us(as_of(spark, sf_dir))), ["device_id"], "tick", "time", {"mode": "mode"},
                   matched_time=None, bucket_s=BUCKET_S)
    return at.withColumn("mode", F.coalesce("mode", F.lit("NORMAL")))


@register("mode_machine", _tick_sql())
def mode_machine(spark, sf_dir):
    """NORMAL / DEGRADED / MAINTENANCE / SAFETY per device at every hourly tick."""
    return modes_at_ticks(spark, sf_dir)


@register("system_mode_latest", _tick_sql(last_only=True))
def system_mode_latest(spark, sf_dir):
    """Current mode of every device (the last tick only)."""
    return modes_at_ticks(spark, sf_dir, last_only=True)
