"""Registered queries of the control loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy import constants as C
from canopy.functions.numeric import from_micros, micros, sql_micros
from canopy.operators.sequence import asof_join, trailing_sum_exact
from canopy.plans.control import (ControlParams, control_replay as _replay, control_replay_sql,
                                  mixing_lock as _lock, mixing_lock_sql)
from canopy.plans.registry import register
from canopy.sources import bindings as B

REPLAY = ControlParams()  # hourly ticks, 24 h lookback, 600 s mixing lock, global lock
TRAILING_S = 6 * 3600


@register("control_replay", control_replay_sql(REPLAY))
def control_replay(spark, sf_dir):
    """Dosing decision for every device at every hourly tick (flagship)."""
    return _replay(spark, sf_dir, REPLAY)


REPLAY_DEVICE_LOCK = ControlParams(per_device_lock=True)


@register("control_replay_device_lock", control_replay_sql(REPLAY_DEVICE_LOCK))
def control_replay_device_lock(spark, sf_dir):
    """The replay with the mixing lock kept per device (the keyed / streaming form)."""
    return _replay(spark, sf_dir, REPLAY_DEVICE_LOCK)


@register("mixing_lock", mixing_lock_sql(REPLAY))
def mixing_lock(spark, sf_dir):
    """Seconds since the newest COMPLETED action at every tick, and the WAITING flag."""
    return _lock(spark, sf_dir, REPLAY)


@register("trailing_avg", B.with_views("telemetry") + f"""
SELECT event_id, device_id, metric, time, value,
  CAST(sum({sql_micros('value')}) OVER w AS DOUBLE) / count({sql_micros('value')}) OVER w / 1e6 AS trailing_avg,
  count({sql_micros('value')}) OVER w AS trailing_cnt
FROM telemetry
WINDOW w AS (PARTITION BY device_id, metric ORDER BY time
             RANGE BETWEEN INTERVAL {TRAILING_S} SECOND PRECEDING AND CURRENT ROW)""")
def trailing_avg(spark, sf_dir):
    """Per reading: average of the same device and metric over the preceding 6 h."""
    t = B.telemetry(spark, sf_dir).withColumn("__us", micros(F.col("value")))
    r = trailing_sum_exact(t, ["device_id", "metric"], "time", "__us", TRAILING_S, prefix="w_")
    return r.select("event_id", "device_id", "metric", "time", "value",
                    from_micros(F.col("w_sum"), F.col("w_cnt")).alias("trailing_avg"),
                    F.col("w_cnt").alias("trailing_cnt"))


@register("last_action_asof", B.with_views("telemetry", "actuator_logs") + """
SELECT t.event_id, t.device_id, t.time, t.value, a.actuator_id AS last_pump, a.time AS last_action_time
FROM telemetry t
ASOF LEFT JOIN (SELECT * FROM actuator_logs WHERE action = 'COMPLETED') a
  ON t.device_id = a.device_id AND t.time >= a.time""")
def last_action_asof(spark, sf_dir):
    """Every reading with the device's last completed action at or before it (as-of join)."""
    readings = B.telemetry(spark, sf_dir).select("event_id", "device_id", "time", "value")
    done = B.actuator_logs(spark, sf_dir).filter(F.col("action") == "COMPLETED")
    return asof_join(readings, done, ["device_id"], "time", "time", {"actuator_id": "last_pump"},
                     right_order="id", matched_time="last_action_time")


def node_of(device):
    """``mock_node2_wet`` -> ``node2``; ids without '_' are used whole."""
    return F.coalesce(F.try_element_at(F.split(device, "_"), F.lit(2)), device)


_CMD_SQL = ("WITH r AS (\n" + control_replay_sql(REPLAY).replace("\n", "\n  ") + "\n)\n" + f"""
SELECT device_id, tick,
  '{C.TOPIC_PREFIX}/' || CASE WHEN strpos(device_id, '_') > 0 THEN split_part(device_id, '_', 2) ELSE device_id END || '/commands' AS topic,
  CAST(json_object('action', '{C.COMMAND_ACTION}', 'cmd_id', sha256(device_id || '|' || CAST(tick AS VARCHAR)),
                   'target', command_target, 'duration_ms', duration_ms) AS VARCHAR) AS payload
FROM r WHERE command_target IS NOT NULL""")


@register("sink_commands", _CMD_SQL)
def sink_commands(spark, sf_dir):
    """Command messages (topic, JSON payload) for every dosing decision of the replay.

    ``cmd_id`` is a hash of (device, tick): a retried task re-emits the same id.
    """
    return command_messages(_replay(spark, sf_dir, REPLAY))


def command_messages(decisions):
    """Decisions with a pump to run as messages (device_id, tick, topic, payload)."""
    r = decisions.filter(F.col("command_target").isNotNull())
    cmd_id = F.sha2(F.concat_ws("|", F.col("device_id"), F.col("tick").cast("string")), 256)
    payload = F.to_json(F.struct(F.lit(C.COMMAND_ACTION).alias("action"), cmd_id.alias("cmd_id"),
                                 F.col("command_target").alias("target"), F.col("duration_ms")))
    topic = F.concat(F.lit(C.TOPIC_PREFIX + "/"), node_of(F.col("device_id")), F.lit("/commands"))
    return r.select("device_id", "tick", topic.alias("topic"), payload.alias("payload"))
