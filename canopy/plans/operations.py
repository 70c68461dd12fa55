"""Operational queries: alerts, faults, maintenance, drift, calibration, recipes.

The original application specifies these in its design notes; each one is a
plain DataFrame plan over the bound tables.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from canopy import constants as C
from canopy.functions.gauges import limits_df, limits_sql
from canopy.functions.numeric import exact_avg, from_micros, micros, sql_avg
from canopy.operators.latest import latest_per_key
from canopy.operators.rangejoin import interval_join
from canopy.operators.sequence import asof_join, epoch_us, floor_time, prev_row, range_sums
from canopy.plans.modes import beyond_tolerance
from canopy.plans.registry import register
from canopy.sources import bindings as B
from canopy.sources.tables import as_of, event_bounds, ntz

HEARTBEAT_GAP_S = 300          # silence longer than 5 minutes is a loss of connection
MAINTENANCE_S = 30 * 60        # a CRITICAL event opens a maintenance window this long
DOSE_RESPONSE_S = 3600         # ph averaged this long before and after a ph dose
STATE_SYNC_LAG_DAYS = 7        # stored state is this old when the ping arrives
DRIFT_ORIGIN = "2024-01-01 00:00:00"

# Growth recipe: stage, first day, last day, target ph, target ec.
RECIPE = [("seedling", 1, 7, 5.8, 0.8), ("vegetative", 8, 21, 6.0, 1.4),
          ("flowering", 22, 60, 6.2, 1.8)]

W_E = B.with_views("system_events")
W_T = B.with_views("telemetry")


def _values_sql(rows, cols):
    def lit(v):
        if isinstance(v, str):
            return f"'{v}'"
        if isinstance(v, float):
            return f"{v}e0"
        return str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({', '.join(cols)})"


@register("event_counts", W_E + """
SELECT level, category, count(*) AS n_events,
       count(*) FILTER (WHERE NOT is_resolved) AS n_unresolved
FROM system_events GROUP BY level, category""")
def event_counts(spark, sf_dir):
    """Alerts by level and category, with the unresolved count."""
    e = B.system_events(spark, sf_dir)
    return e.groupBy("level", "category").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count(F.when(~F.col("is_resolved"), 1)).alias("n_unresolved"))


@register("unresolved_alerts", W_E + """
SELECT id, time, level, category, message FROM system_events
WHERE NOT is_resolved ORDER BY time DESC, id DESC""")
def unresolved_alerts(spark, sf_dir):
    """Alert list: unresolved events, newest first."""
    e = B.system_events(spark, sf_dir).filter(~F.col("is_resolved"))
    return e.select("id", "time", "level", "category", "message") \
        .orderBy(F.col("time").desc(), F.col("id").desc())


@register("heartbeat_gaps", W_T + f"""
, g AS (SELECT device_id, lag(time) OVER (PARTITION BY device_id ORDER BY time, event_id) AS gap_start,
               time AS gap_end FROM telemetry)
SELECT device_id, gap_start, gap_end, date_diff('microsecond', gap_start, gap_end) / 1e6 AS gap_s
FROM g WHERE date_diff('microsecond', gap_start, gap_end) > CAST({HEARTBEAT_GAP_S} AS BIGINT) * 1000000""")
def heartbeat_gaps(spark, sf_dir):
    """Silences longer than the heartbeat limit between readings of a device."""
    t = B.telemetry(spark, sf_dir).select("event_id", "device_id", "time")
    p = prev_row(t, ["device_id"], "time", {"time": "gap_start"}, order_col="event_id")
    gap_us = epoch_us("time") - epoch_us("gap_start")
    return p.filter(gap_us > HEARTBEAT_GAP_S * 1_000_000).select(
        "device_id", "gap_start", F.col("time").alias("gap_end"), (gap_us / F.lit(1e6)).alias("gap_s"))


_EXTREMES = [(m, lo, hi) for m, (_, _, _, lo, hi) in C.METRIC_LIMITS.items()]


@register("sensor_fault", W_T + f"""
, lim AS ({_values_sql(_EXTREMES, ['metric', 'lo', 'hi'])})
SELECT t.event_id, t.device_id, t.metric, t.time, t.value,
       CASE WHEN t.value <= l.lo THEN 'below' ELSE 'above' END AS fault
FROM telemetry t JOIN lim l ON t.metric = l.metric
WHERE t.value <= l.lo OR t.value >= l.hi""")
def sensor_fault(spark, sf_dir):
    """Readings at or beyond the extreme tolerance of their metric (pH 1, water at 40 degrees)."""
    t = B.telemetry(spark, sf_dir)
    below = F.lit(False)
    for m, lo, _ in _EXTREMES:
        below = F.when(F.col("metric") == m, F.col("value") <= lo).otherwise(below)
    return t.where(beyond_tolerance(F.col("metric"), F.col("value"))).select(
        "event_id", "device_id", "metric", "time", "value", F.when(below, "below").otherwise("above").alias("fault"))


@register("ph_drift", B.with_views("telemetry", "actuator_logs") + f"""
, d AS (
  SELECT t.device_id, a.time AS span_start, t.time, t.value
  FROM (SELECT * FROM telemetry WHERE metric = 'ph') t
  ASOF LEFT JOIN (SELECT * FROM actuator_logs WHERE action = 'COMPLETED'
                  AND actuator_id IN ('pump_ph_minus', 'pump_ph_plus')) a
    ON t.device_id = a.device_id AND t.time >= a.time)
SELECT device_id, span_start, count(*) AS n_points,
  CASE WHEN min(time) < max(time)
       THEN round(regr_slope(value, date_diff('microsecond', TIMESTAMP '{DRIFT_ORIGIN}', time) / 3.6e9), 6) END AS ph_per_hour
FROM d GROUP BY device_id, span_start""")
def ph_drift(spark, sf_dir):
    """Natural pH slope per hour of each device between two pH doses; null where all readings are of one instant."""
    ph = B.telemetry(spark, sf_dir).filter(F.col("metric") == "ph").select("device_id", "time", "value")
    doses = B.actuator_logs(spark, sf_dir).filter(
        (F.col("action") == "COMPLETED") & F.col("actuator_id").isin(C.PUMP_PH_MINUS, C.PUMP_PH_PLUS))
    d = asof_join(ph, doses, ["device_id"], "time", "time", {}, right_order="id",
                  matched_time="span_start")
    x = (epoch_us("time") - epoch_us(ntz(DRIFT_ORIGIN))) / F.lit(3.6e9)
    slope = F.when(F.min("time") < F.max("time"), F.round(F.regr_slope(F.col("value"), x), 6))
    return d.groupBy("device_id", "span_start").agg(F.count(F.lit(1)).alias("n_points"), slope.alias("ph_per_hour"))


@register("calibrate", B.with_views("telemetry", "sensor_calibrations") + """
, cal AS (SELECT sensor_id, last_calibrated, arg_max(slope, id) AS slope, arg_max(intercept, id) AS intercept
          FROM sensor_calibrations GROUP BY sensor_id, last_calibrated)
SELECT t.event_id, t.device_id, t.metric, t.time, t.value, c.last_calibrated,
       coalesce(c.slope, 1e0) * t.value + coalesce(c.intercept, 0e0) AS calibrated
FROM (SELECT *, device_id || ':' || metric AS sensor_id FROM telemetry) t
ASOF LEFT JOIN cal c ON c.sensor_id = t.sensor_id AND t.time >= c.last_calibrated""")
def calibrate(spark, sf_dir):
    """value = slope * raw + intercept by the calibration valid at the reading's time."""
    return calibrated(B.telemetry(spark, sf_dir), B.sensor_calibrations(spark, sf_dir)).select(
        "event_id", "device_id", "metric", "time", "value", "last_calibrated", "calibrated")


def calibrated(telemetry, versions):
    """``telemetry`` with ``calibrated`` and ``last_calibrated``: each reading by its sensor's newest version so far.

    A sensor is ``device:metric``.  A version holds from its ``last_calibrated``
    until the next one; of versions of one instant the greatest id holds;
    readings before a sensor's first version pass through.
    """
    t = telemetry.withColumn("sensor_id", F.concat_ws(":", "device_id", "metric"))
    j = asof_join(t, versions, ["sensor_id"], "time", "last_calibrated", {"slope": "slope", "intercept": "intercept"},
                  right_order="id", matched_time="last_calibrated")
    value = F.coalesce("slope", F.lit(1.0)) * F.col("value") + F.coalesce("intercept", F.lit(0.0))
    return j.withColumn("calibrated", value).drop("sensor_id", "slope", "intercept")


@register("recipe_setpoint", W_T + f"""
, recipe AS ({_values_sql(RECIPE, ['stage', 'first_day', 'last_day', 'target_ph', 'target_ec'])}),
d AS (SELECT event_id, time,
        CAST(date_diff('day', (SELECT CAST(min(ts) AS DATE) FROM events), CAST(time AS DATE)) + 1 AS INT) AS growth_day
      FROM telemetry)
SELECT d.event_id, d.time, d.growth_day, r.stage, r.target_ph, r.target_ec
FROM d LEFT JOIN recipe r ON d.growth_day BETWEEN r.first_day AND r.last_day""")
def recipe_setpoint(spark, sf_dir):
    """Growth day of every reading and the recipe stage setpoints for it (non-equi join)."""
    planted = event_bounds(spark, sf_dir)[0].date()
    recipe = spark.createDataFrame(RECIPE, "stage string, first_day int, last_day int, "
                                           "target_ph double, target_ec double")
    t = B.telemetry(spark, sf_dir).select(
        "event_id", "time",
        (F.datediff(F.to_date("time"), F.lit(planted)) + 1).cast("int").alias("growth_day"))
    # the recipe expanded to one row per growth day (a fixed, tiny table): the stage lookup
    # becomes a broadcast equi-join instead of a nested-loop range join
    days = recipe.select("stage", "target_ph", "target_ec",
                         F.explode(F.sequence("first_day", "last_day")).alias("growth_day"))
    j = t.join(F.broadcast(days), "growth_day", "left")
    return j.select("event_id", "time", "growth_day", "stage", "target_ph", "target_ec")


@register("minute_downsample", W_T + f"""
SELECT device_id, metric, date_trunc('minute', time) AS minute, {sql_avg('value')} AS avg_value,
       count(*) AS n FROM telemetry GROUP BY device_id, metric, date_trunc('minute', time)""")
def minute_downsample(spark, sf_dir):
    """One point per minute per device and metric."""
    t = B.telemetry(spark, sf_dir)
    return t.groupBy("device_id", "metric", floor_time("time", 60).alias("minute")).agg(
        exact_avg(F.col("value")).alias("avg_value"), F.count(F.lit(1)).alias("n"))


_WIDE = ["ph", "ec", "water_temp"]


@register("telemetry_wide", W_T + "SELECT device_id, date_trunc('hour', time) AS hour_start, " + ", ".join(
    f"{sql_avg('value', f'metric = {chr(39)}{m}{chr(39)}')} AS {m}" for m in _WIDE)
    + " FROM telemetry GROUP BY device_id, date_trunc('hour', time)")
def telemetry_wide(spark, sf_dir):
    """Hourly wide rows: one column per metric (pivot with a fixed list)."""
    t = B.telemetry(spark, sf_dir)
    return (t.groupBy("device_id", floor_time("time", 3600).alias("hour_start"))
            .pivot("metric", _WIDE).agg(exact_avg(F.col("value"))))


@register("maintenance_antijoin", B.with_views("telemetry", "system_events") + f"""
SELECT t.* FROM telemetry t WHERE NOT EXISTS (
  SELECT 1 FROM system_events e WHERE e.level = 'CRITICAL' AND e.category = t.device_id
    AND t.time >= e.time AND t.time <= e.time + INTERVAL {MAINTENANCE_S} SECOND)""")
def maintenance_antijoin(spark, sf_dir):
    """Readings outside every maintenance window of their device (range anti join)."""
    win = B.system_events(spark, sf_dir).filter(F.col("level") == "CRITICAL").select(
        F.col("category").alias("device_id"), F.col("time").alias("m_start"),
        (F.col("time") + F.make_dt_interval(secs=F.lit(MAINTENANCE_S))).alias("m_end"))
    return interval_join(B.telemetry(spark, sf_dir), win, ["device_id"], "time", "m_start", "m_end",
                         bucket_s=float(MAINTENANCE_S), how="left_anti")


@register("alert_raise", W_T + f"""
, limits AS ({limits_sql()})
SELECT t.time, CASE WHEN t.value < l.min_v OR t.value > l.max_v THEN 'CRITICAL' ELSE 'WARNING' END AS level,
       t.device_id AS category, t.metric || ' out of range' AS message, false AS is_resolved
FROM telemetry t JOIN limits l ON t.metric = l.metric
WHERE t.metric IN ('water_temp', 'ec') AND (t.value < l.min_ok OR t.value > l.max_ok)""")
def alert_raise(spark, sf_dir):
    """Event rows for water-temperature and EC readings outside their limits."""
    t = B.telemetry(spark, sf_dir).filter(F.col("metric").isin("water_temp", "ec"))
    j = t.join(F.broadcast(limits_df(spark)), "metric")  # fixed 4-row dimension
    out = j.filter((F.col("value") < F.col("min_ok")) | (F.col("value") > F.col("max_ok")))
    return out.select(
        "time",
        F.when((F.col("value") < F.col("min_v")) | (F.col("value") > F.col("max_v")), "CRITICAL")
        .otherwise("WARNING").alias("level"),
        F.col("device_id").alias("category"),
        F.concat(F.col("metric"), F.lit(" out of range")).alias("message"),
        F.lit(False).alias("is_resolved"))


@register("lockout_latch", B.with_views("telemetry", "system_events") + """
, k AS (SELECT category AS device_id, time, id,
          CASE WHEN is_resolved THEN 'ACK' ELSE 'FAULT' END AS kind
        FROM system_events WHERE level = 'CRITICAL' OR is_resolved)
SELECT t.event_id, t.device_id, t.time, coalesce(k.kind = 'FAULT', false) AS locked,
       CASE WHEN k.kind = 'FAULT' THEN k.time END AS locked_since
FROM telemetry t
ASOF LEFT JOIN k ON t.device_id = k.device_id AND t.time >= k.time""")
def lockout_latch(spark, sf_dir):
    """Per reading: is the device latched by an unacknowledged critical fault?"""
    k = B.system_events(spark, sf_dir).filter((F.col("level") == "CRITICAL") | F.col("is_resolved")) \
        .select(F.col("category").alias("device_id"), "time", "id",
                F.when(F.col("is_resolved"), "ACK").otherwise("FAULT").alias("kind"))
    t = B.telemetry(spark, sf_dir).select("event_id", "device_id", "time")
    j = asof_join(t, k, ["device_id"], "time", "time", {"kind": "__kind"}, right_order="id",
                  matched_time="__ktime")
    fault = F.col("__kind") == "FAULT"
    return j.select("event_id", "device_id", "time", F.coalesce(fault, F.lit(False)).alias("locked"),
                    F.when(fault, F.col("__ktime")).alias("locked_since"))


@register("dose_response", B.with_views("telemetry", "actuator_logs") + f"""
SELECT a.id, a.device_id, a.actuator_id, a.time,
  {sql_avg('t.value', 't.time < a.time')} AS ph_before,
  {sql_avg('t.value', 't.time > a.time')} AS ph_after,
  count(t.value) FILTER (WHERE t.time < a.time) AS n_before,
  count(t.value) FILTER (WHERE t.time > a.time) AS n_after
FROM (SELECT * FROM actuator_logs WHERE action = 'COMPLETED'
      AND actuator_id IN ('pump_ph_minus', 'pump_ph_plus')) a
LEFT JOIN (SELECT * FROM telemetry WHERE metric = 'ph') t
  ON t.device_id = a.device_id AND t.time >= a.time - INTERVAL {DOSE_RESPONSE_S} SECOND
     AND t.time <= a.time + INTERVAL {DOSE_RESPONSE_S} SECOND
GROUP BY a.id, a.device_id, a.actuator_id, a.time""")
def dose_response(spark, sf_dir):
    """Mean ph in the hour before and after every ph dose, from prefix sums at the windows' ends."""
    doses = B.actuator_logs(spark, sf_dir).filter(
        (F.col("action") == "COMPLETED") & F.col("actuator_id").isin(C.PUMP_PH_MINUS, C.PUMP_PH_PLUS)) \
        .select("id", "device_id", "actuator_id", "time")
    ph = B.telemetry(spark, sf_dir).filter(F.col("metric") == "ph").select(
        "device_id", F.col("time").alias("read_at"), micros(F.col("value")).alias("v"))
    at, reach = epoch_us("time"), DOSE_RESPONSE_S * 1_000_000
    near = range_sums(doses, ph, ["device_id"], "id", "read_at", "v", {"before": (at - reach, at - 1), "after": (at + 1, at + reach)})
    return doses.join(near, ["device_id", "id"]).select(
        "id", "device_id", "actuator_id", "time", from_micros(F.col("before_sum"), F.col("before_cnt")).alias("ph_before"),
        from_micros(F.col("after_sum"), F.col("after_cnt")).alias("ph_after"),
        F.col("before_cnt").alias("n_before"), F.col("after_cnt").alias("n_after"))


@register("state_sync", B.with_views("actuator_logs") + f"""
, st AS (SELECT *, CASE WHEN action = 'STARTED' THEN 'ON' ELSE 'OFF' END AS state FROM actuator_logs),
stored AS (SELECT DISTINCT ON (device_id, actuator_id) device_id, actuator_id, state FROM st
           WHERE time <= (SELECT max(ts) FROM events) - INTERVAL {STATE_SYNC_LAG_DAYS} DAY
           ORDER BY device_id, actuator_id, time DESC, id DESC),
ping AS (SELECT DISTINCT ON (device_id, actuator_id) device_id, actuator_id, state FROM st
         ORDER BY device_id, actuator_id, time DESC, id DESC)
SELECT coalesce(p.device_id, s.device_id) AS device_id, coalesce(p.actuator_id, s.actuator_id) AS actuator_id,
       s.state AS stored_state, p.state AS ping_state, coalesce(p.state, s.state) AS state,
       s.state IS DISTINCT FROM p.state AS diverged
FROM ping p FULL OUTER JOIN stored s ON p.device_id = s.device_id AND p.actuator_id = s.actuator_id""")
def state_sync(spark, sf_dir):
    """Stored relay state vs the state a node reports: ping wins, divergence flagged."""
    a = B.actuator_logs(spark, sf_dir).withColumn(
        "state", F.when(F.col("action") == "STARTED", "ON").otherwise("OFF"))
    keys = ["device_id", "actuator_id"]
    order = [F.col("time").desc(), F.col("id").desc()]
    cutoff = as_of(spark, sf_dir) - _dt.timedelta(days=STATE_SYNC_LAG_DAYS)
    stored = latest_per_key(a.filter(F.col("time") <= ntz(cutoff)), keys, order) \
        .select(*keys, F.col("state").alias("stored_state"))
    ping = latest_per_key(a, keys, order).select(*keys, F.col("state").alias("ping_state"))
    j = ping.join(stored, keys, "full_outer")
    return j.select(*keys, "stored_state", "ping_state",
                    F.coalesce("ping_state", "stored_state").alias("state"),
                    (~F.col("stored_state").eqNullSafe(F.col("ping_state"))).alias("diverged"))
