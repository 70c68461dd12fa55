"""Reads of the telemetry table: histories, filters, latest values, averages."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from canopy.functions.numeric import exact_avg, sql_avg
from canopy.operators.latest import last_value_per_key, latest_per_key, top1
from canopy.plans.registry import register
from canopy.sources import bindings as B
from canopy.sources.tables import as_of, ntz

# Parameters of the registered queries (the original's defaults where it has one).
HISTORY_HOURS = 24          # dashboard history
RANGE_HOURS = 72            # generic time-range filter
DEVICE = "node2"            # the device a single-device query looks at
DEVICE_LOOKBACK_S = 6 * 3600
AVG_LOOKBACK_S = 24 * 3600
ASOF_SQL = "(SELECT max(ts) FROM events)"


def since(spark, sf_dir, seconds: float):
    """``time >= as_of - seconds`` as a literal predicate (pushed to parquet)."""
    return F.col("time") >= ntz(as_of(spark, sf_dir) - _dt.timedelta(seconds=seconds))


def tel(spark, sf_dir):
    return B.telemetry(spark, sf_dir)


W_T = B.with_views("telemetry")


@register("scan_telemetry", W_T + "SELECT * FROM telemetry")
def scan_telemetry(spark, sf_dir):
    """Full scan of the telemetry view."""
    return tel(spark, sf_dir)


@register("latest_per_metric", W_T + """
SELECT DISTINCT ON (metric) metric, value, time, device_id
FROM telemetry ORDER BY metric, time DESC, device_id""")
def latest_per_metric(spark, sf_dir):
    """Newest reading of each metric across all devices (DISTINCT ON)."""
    t = tel(spark, sf_dir).select("metric", "value", "time", "device_id")
    return latest_per_key(t, ["metric"], [F.col("time").desc(), F.col("device_id")])


def _latest_metric_sql(metric):
    return W_T + f"""
SELECT time, value FROM telemetry WHERE metric = '{metric}' AND device_id = '{DEVICE}'
ORDER BY time DESC, event_id DESC LIMIT 1"""


def _latest_metric(spark, sf_dir, metric):
    t = tel(spark, sf_dir).filter((F.col("metric") == metric) & (F.col("device_id") == DEVICE))
    return top1(t, [F.col("time").desc(), F.col("event_id").desc()]).select("time", "value")


@register("latest_ph", _latest_metric_sql("ph"))
def latest_ph(spark, sf_dir):
    """Dashboard pH stat: newest ph of one device."""
    return _latest_metric(spark, sf_dir, "ph")


@register("latest_ec", _latest_metric_sql("ec"))
def latest_ec(spark, sf_dir):
    """Dashboard EC stat: newest ec of one device."""
    return _latest_metric(spark, sf_dir, "ec")


@register("history_sorted", W_T + f"""
SELECT time, metric, value FROM telemetry
WHERE time >= {ASOF_SQL} - INTERVAL {HISTORY_HOURS} HOUR ORDER BY time ASC""")
def history_sorted(spark, sf_dir):
    """Chart history: readings of the last 24 h, oldest first."""
    t = tel(spark, sf_dir).filter(since(spark, sf_dir, HISTORY_HOURS * 3600))
    return t.select("time", "metric", "value").orderBy("time")


@register("filter_time_range", W_T + f"""
SELECT * FROM telemetry WHERE time >= {ASOF_SQL} - INTERVAL {RANGE_HOURS} HOUR""")
def filter_time_range(spark, sf_dir):
    """``time >= now - interval`` on the whole table."""
    return tel(spark, sf_dir).filter(since(spark, sf_dir, RANGE_HOURS * 3600))


@register("filter_device_window", W_T + f"""
SELECT * FROM telemetry WHERE device_id = '{DEVICE}'
  AND time >= {ASOF_SQL} - INTERVAL {DEVICE_LOOKBACK_S} SECOND""")
def filter_device_window(spark, sf_dir):
    """One device's readings over the control lookback."""
    return tel(spark, sf_dir).filter((F.col("device_id") == DEVICE)
                                     & since(spark, sf_dir, DEVICE_LOOKBACK_S))


@register("filter_metric_device", W_T + f"""
SELECT time, value FROM telemetry WHERE metric = 'ph' AND device_id = 'node3'""")
def filter_metric_device(spark, sf_dir):
    """All ph readings of one device."""
    t = tel(spark, sf_dir)
    return t.filter((F.col("metric") == "ph") & (F.col("device_id") == "node3")).select("time", "value")


@register("filter_metric_series", W_T + f"""
SELECT time, value FROM telemetry WHERE metric = 'ec'
  AND time >= {ASOF_SQL} - INTERVAL {HISTORY_HOURS} HOUR""")
def filter_metric_series(spark, sf_dir):
    """Per-metric chart series (ec, last 24 h)."""
    t = tel(spark, sf_dir).filter((F.col("metric") == "ec") & since(spark, sf_dir, HISTORY_HOURS * 3600))
    return t.select("time", "value")


@register("avg_by_metric", W_T + f"""
SELECT metric, {sql_avg('value')} AS avg_val FROM telemetry
WHERE device_id = '{DEVICE}' AND time >= {ASOF_SQL} - INTERVAL {AVG_LOOKBACK_S} SECOND
GROUP BY metric""")
def avg_by_metric(spark, sf_dir):
    """Control input: average per metric of one device over the lookback."""
    t = tel(spark, sf_dir).filter((F.col("device_id") == DEVICE) & since(spark, sf_dir, AVG_LOOKBACK_S))
    return t.groupBy("metric").agg(exact_avg(F.col("value")).alias("avg_val"))


@register("filter_notnull_avg", W_T + f"""
SELECT device_id, metric, {sql_avg('value')} AS avg_val FROM telemetry
WHERE time >= {ASOF_SQL} - INTERVAL {AVG_LOOKBACK_S} SECOND
GROUP BY device_id, metric HAVING count(value) > 0""")
def filter_notnull_avg(spark, sf_dir):
    """Averages of every device and metric over the lookback, null averages dropped."""
    t = tel(spark, sf_dir).filter(since(spark, sf_dir, AVG_LOOKBACK_S))
    a = t.groupBy("device_id", "metric").agg(exact_avg(F.col("value")).alias("avg_val"))
    return a.filter(F.col("avg_val").isNotNull())


@register("metrics_pivot", W_T + f"""
SELECT device_id, {sql_avg('value', "metric = 'ph'")} AS ph, {sql_avg('value', "metric = 'ec'")} AS ec
FROM telemetry WHERE time >= {ASOF_SQL} - INTERVAL {AVG_LOOKBACK_S} SECOND
GROUP BY device_id""")
def metrics_pivot(spark, sf_dir):
    """Per device, the ph and ec averages as columns (pivot with a fixed list)."""
    t = tel(spark, sf_dir).filter(since(spark, sf_dir, AVG_LOOKBACK_S))
    return (t.groupBy("device_id").pivot("metric", ["ph", "ec"])
            .agg(exact_avg(F.col("value"))))


@register("last_not_null", W_T + """
SELECT device_id, metric, arg_max(value, (time, event_id)) AS last_value, max(time) AS last_time
FROM telemetry WHERE value IS NOT NULL GROUP BY device_id, metric""")
def last_not_null(spark, sf_dir):
    """Dashboard reducer lastNotNull per device and metric."""
    return last_value_per_key(tel(spark, sf_dir), ["device_id", "metric"], "value", "time",
                              tiebreak="event_id")


@register("history_label", W_T + f"""
SELECT time, strftime(time, '%H:%M') AS label, metric, value FROM telemetry
WHERE time >= {ASOF_SQL} - INTERVAL {HISTORY_HOURS} HOUR""")
def history_label(spark, sf_dir):
    """History rows with the chart's HH:mm label."""
    t = tel(spark, sf_dir).filter(since(spark, sf_dir, HISTORY_HOURS * 3600))
    return t.select("time", F.date_format("time", "HH:mm").alias("label"), "metric", "value")


@register("live_status_map")
def live_status_map(spark, sf_dir):
    """Live status as one map ``{metric: {value, time}}`` (one row)."""
    latest = latest_per_metric(spark, sf_dir)
    # one row per metric reaches the final aggregate: the map is as small as the metric list
    return latest.agg(F.map_from_entries(F.collect_list(
        F.struct("metric", F.struct("value", "time")))).alias("status"))
