"""Dashboard queries: gauges, colour bands, hourly trend and pump activity matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy import constants as C
from canopy.functions import gauges as G
from canopy.functions.numeric import exact_avg, sql_avg
from canopy.operators.sequence import floor_time
from canopy.plans.registry import register
from canopy.plans.telemetry import ASOF_SQL, latest_per_metric, since
from canopy.sources import bindings as B

TREND_HOURS = 24
_LATEST_SQL = """
, latest AS (SELECT DISTINCT ON (metric) metric, value, time, device_id
             FROM telemetry ORDER BY metric, time DESC, device_id),
limits AS (""" + G.limits_sql() + ")\n"
W_TL = B.with_views("telemetry") + _LATEST_SQL


@register("threshold_lookup", W_TL + """
SELECT x.metric, x.value, l.target, l.min_ok, l.max_ok, l.min_v, l.max_v
FROM latest x LEFT JOIN limits l ON x.metric = l.metric""")
def threshold_lookup(spark, sf_dir):
    """Latest value of each metric with its limits (broadcast dimension join)."""
    latest = latest_per_metric(spark, sf_dir).select("metric", "value")
    # the limits table is a fixed four-row dimension: broadcasting it is size-safe
    return latest.join(F.broadcast(G.limits_df(spark)), "metric", "left")


@register("gauge_position", W_TL + """
SELECT x.metric, x.value,
  (l.min_ok - l.min_v) / (l.max_v - l.min_v) * 100e0 AS green_start_pct,
  (l.max_ok - l.min_ok) / (l.max_v - l.min_v) * 100e0 AS green_width_pct,
  greatest(0e0, least(100e0, (x.value - l.min_v) / (l.max_v - l.min_v) * 100e0)) AS cursor_pct,
  x.value >= l.min_ok AND x.value <= l.max_ok AS is_ok,
  printf('%.2f', x.value) AS display
FROM latest x JOIN limits l ON x.metric = l.metric""")
def gauge_position(spark, sf_dir):
    """Linear tolerance gauge: green zone, clamped cursor, in-range flag."""
    latest = latest_per_metric(spark, sf_dir).select("metric", "value")
    j = latest.join(F.broadcast(G.limits_df(spark)), "metric")
    return j.select("metric", "value",
                    *G.gauge_columns(F.col("value"), F.col("min_ok"), F.col("max_ok"),
                                     F.col("min_v"), F.col("max_v")))


@register("threshold_band", B.with_views("telemetry") + f"""
SELECT event_id, metric, value,
  CASE metric WHEN 'ph' THEN {G.band_sql('value', C.PH_BANDS)}
              ELSE {G.band_sql('value', C.EC_BANDS)} END AS band
FROM telemetry WHERE metric IN ('ph', 'ec')""")
def threshold_band(spark, sf_dir):
    """Dashboard colour step of every ph and ec reading."""
    t = B.telemetry(spark, sf_dir).filter(F.col("metric").isin("ph", "ec"))
    v = F.col("value")
    return t.select("event_id", "metric", "value",
                    F.when(F.col("metric") == "ph", G.band(v, C.PH_BANDS))
                    .otherwise(G.band(v, C.EC_BANDS)).alias("band"))


_TREND_SQL = f"""
, trend AS (
  SELECT date_trunc('hour', time) AS hour_start, metric, {sql_avg('value')} AS avg_value
  FROM telemetry WHERE metric IN ('ph', 'ec') AND time >= {ASOF_SQL} - INTERVAL {TREND_HOURS} HOUR
  GROUP BY date_trunc('hour', time), metric)
"""


def _trend(spark, sf_dir):
    t = (B.telemetry(spark, sf_dir).filter(F.col("metric").isin("ph", "ec"))
         .filter(since(spark, sf_dir, TREND_HOURS * 3600)))
    return t.groupBy(floor_time("time", 3600).alias("hour_start"), "metric") \
        .agg(exact_avg(F.col("value")).alias("avg_value"))


@register("hourly_trend", B.with_views("telemetry") + _TREND_SQL + "SELECT * FROM trend")
def hourly_trend(spark, sf_dir):
    """Mean ph and ec per hour over the last 24 h."""
    return _trend(spark, sf_dir)


@register("activity_halo", B.with_views("telemetry") + _TREND_SQL + f"""
, limits AS ({G.limits_sql()})
SELECT t.hour_start, t.metric, t.avg_value,
  {G.halo_sql('t.metric', 't.avg_value', 'l.min_ok', 'l.max_ok')} AS halo
FROM trend t JOIN limits l ON t.metric = l.metric""")
def activity_halo(spark, sf_dir):
    """Hour classed high / low / ok against the limits, with its halo colour."""
    j = _trend(spark, sf_dir).join(F.broadcast(G.limits_df(spark)), "metric")
    return j.select("hour_start", "metric", "avg_value",
                    G.halo(F.col("metric"), F.col("avg_value"), F.col("min_ok"), F.col("max_ok"))
                    .alias("halo"))


_PUMPS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{p}')" for p in C.PUMPS) + ") AS p(pump)"


@register("hourly_pump_matrix", B.with_views("actuator_logs") + f"""
, counts AS (
  SELECT CAST(hour(time) AS INT) AS hour, actuator_id AS pump, count(*) AS n
  FROM actuator_logs WHERE action = 'COMPLETED' AND time >= {ASOF_SQL} - INTERVAL {TREND_HOURS} HOUR
  GROUP BY 1, 2),
spine AS (SELECT CAST(h.range AS INT) AS hour, p.pump FROM range(0, 24) h, ({_PUMPS_SQL}) p)
SELECT s.hour, s.pump, coalesce(c.n, 0) AS pulses,
  {G.activity_class_sql('coalesce(c.n, 0)')} AS cell_class
FROM spine s LEFT JOIN counts c ON s.hour = c.hour AND s.pump = c.pump""")
def hourly_pump_matrix(spark, sf_dir):
    """Dense 24 x pumps matrix of completed pulses over the last 24 h."""
    a = B.actuator_logs(spark, sf_dir).filter(
        (F.col("action") == "COMPLETED") & since(spark, sf_dir, TREND_HOURS * 3600)
        & F.col("actuator_id").isin(*C.PUMPS))  # bounds the broadcast below to 24 x pumps rows
    counts = a.groupBy(F.hour("time").cast("int").alias("hour"), F.col("actuator_id").alias("pump")) \
        .agg(F.count(F.lit(1)).alias("n"))
    spine = spark.range(24).select(F.col("id").cast("int").alias("hour"),
                                   F.explode(F.array(*[F.lit(p) for p in C.PUMPS])).alias("pump"))
    pulses = F.coalesce(F.col("n"), F.lit(0).cast("long"))
    # spine and counts are both at most 24 x pumps rows
    return spine.join(F.broadcast(counts), ["hour", "pump"], "left").select(
        "hour", "pump", pulses.alias("pulses"), G.activity_class(pulses).alias("cell_class"))


@register("activity_bucket", B.with_views("actuator_logs") + f"""
SELECT device_id, actuator_id, CAST(time AS DATE) AS day, count(*) AS pulses,
  {G.activity_class_sql('count(*)')} AS cell_class
FROM actuator_logs WHERE action = 'COMPLETED' GROUP BY device_id, actuator_id, CAST(time AS DATE)""")
def activity_bucket(spark, sf_dir):
    """Activity class of every (device, pump, day) cell."""
    a = B.actuator_logs(spark, sf_dir).filter(F.col("action") == "COMPLETED")
    c = a.groupBy("device_id", "actuator_id", F.to_date("time").alias("day")) \
        .agg(F.count(F.lit(1)).alias("pulses"))
    return c.withColumn("cell_class", G.activity_class(F.col("pulses")))


_LIVE = ["ph", "ec", "water_temp", "air_temp", "humidity"]


@register("live_defaults", W_TL + "SELECT " + ", ".join(
    G.live_default_sql(f"max(value) FILTER (WHERE metric = '{m}')", C.LIVE_DEFAULTS[m]) + f" AS {m}"
    for m in _LIVE) + " FROM latest")
def live_defaults(spark, sf_dir):
    """Gauge inputs: latest value per metric with the dashboard's fallbacks."""
    latest = latest_per_metric(spark, sf_dir)
    row = latest.agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in _LIVE])
    return row.select(*[G.live_default(F.col(m), C.LIVE_DEFAULTS[m]).alias(m) for m in _LIVE])
