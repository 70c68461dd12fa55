"""Ingest queries: routing, typed parsing, dead-letter rows, status pings.

The Spark side parses the landing messages (VARIANT, Python coercion rules).
The oracle SQL never parses JSON: it states the expected outcome of each
injected payload shape directly from the source tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy import constants as C
from canopy.functions.climate import expected_lux as lux_expr
from canopy.plans.registry import register
from canopy.sources import bindings as B
from canopy.sources import landing as L
from canopy.sources import messages as M

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
_P = C.TOPIC_PREFIX
_WX = f"""wx AS (SELECT event_id, ts AS time, 'station' || CAST(user_id % {B.DEVICES} AS STRING) AS sensor_name,
  1e1 + value / 10e0 AS temperature, value / 20e0 AS windspeed, {_K} AS weathercode
  FROM events WHERE event_type = 'signup')"""
_ST = f"""st AS (SELECT event_id, ts, 'node' || CAST(user_id % {B.DEVICES} AS STRING) AS device_id, {_K} AS k
  FROM events WHERE event_type = 'error')"""
_WITH = B.with_views("telemetry", "actuator_logs") + ", " + _WX + ", " + _ST + "\n"
_TEL_TOPIC = f"CASE WHEN event_id % 2 = 0 THEN '{M.TOPIC_TELEMETRY}' ELSE '{_P}/' || device_id || '/telemetry' END"
_ACT_TOPIC = f"CASE WHEN id % 2 = 0 THEN '{M.TOPIC_ACTUATOR}' ELSE '{_P}/' || device_id || '/acks' END"
_TEL_BAD = "(2, 4, 5, 6, 7, 8)"
_WX_BAD = "(3, 4, 7)"
_ACT_BAD = "(1, 2, 4)"


def _msgs(spark, sf_dir, kind):
    return M.route_by_topic(L.messages(spark, sf_dir), kind)


@register("route_by_topic", _WITH + f"""
SELECT event_id * 4 AS msg_id, {_TEL_TOPIC} AS topic, 'telemetry' AS kind FROM telemetry
UNION ALL SELECT event_id * 4 + 1, '{M.TOPIC_WEATHER}', 'weather' FROM wx
UNION ALL SELECT id * 4 + 2, {_ACT_TOPIC}, 'actuator' FROM actuator_logs
UNION ALL SELECT event_id * 4 + 3, '{_P}/' || device_id || '/status', 'status' FROM st WHERE k % 7 <> 0""")
def route_by_topic(spark, sf_dir):
    """Messages of known topics with the handler they go to; unknown topics dropped."""
    m = L.messages(spark, sf_dir)
    return m.select("msg_id", "topic", M.topic_kind(F.col("topic")).alias("kind")) \
        .filter(F.col("kind").isNotNull())


@register("parse_telemetry", _WITH + f"""
SELECT event_id * 4 AS msg_id, time, device_id, metric,
  CASE event_id % {L.TEL_MOD} WHEN 1 THEN 0e0 WHEN 9 THEN 1e0 ELSE value END AS value
FROM telemetry WHERE event_id % {L.TEL_MOD} NOT IN {_TEL_BAD}""")
def parse_telemetry(spark, sf_dir):
    """Telemetry payloads -> telemetry rows (accepted only)."""
    return M.accepted(M.parse_telemetry(_msgs(spark, sf_dir, M.KIND_TELEMETRY)))


@register("parse_weather", _WITH + f"""
SELECT event_id * 4 + 1 AS msg_id, time,
  CASE event_id % {L.WX_MOD} WHEN 2 THEN NULL WHEN 8 THEN '{C.DEFAULT_SENSOR_NAME}' ELSE sensor_name END AS sensor_name,
  CASE WHEN event_id % {L.WX_MOD} = 1 THEN 0e0 ELSE temperature END AS temperature,
  CASE WHEN event_id % {L.WX_MOD} = 1 THEN 0e0 ELSE windspeed END AS windspeed,
  CASE WHEN event_id % {L.WX_MOD} = 1 THEN 0 ELSE weathercode END AS weathercode
FROM wx WHERE event_id % {L.WX_MOD} NOT IN {_WX_BAD}""")
def parse_weather(spark, sf_dir):
    """Weather payloads -> weather_metrics rows (accepted only)."""
    return M.accepted(M.parse_weather(_msgs(spark, sf_dir, M.KIND_WEATHER)))


@register("parse_actuator", _WITH + f"""
SELECT id * 4 + 2 AS msg_id, time, actuator_id, action,
  CASE WHEN id % {L.ACT_MOD} = 3 THEN NULL ELSE duration_ms END AS duration_ms,
  '{C.TRIGGER_SOURCE}' AS trigger_source
FROM actuator_logs WHERE id % {L.ACT_MOD} NOT IN {_ACT_BAD}""")
def parse_actuator(spark, sf_dir):
    """Ack payloads -> actuator_logs rows (accepted only), tagged with the trigger source."""
    return M.accepted(M.parse_actuator(_msgs(spark, sf_dir, M.KIND_ACTUATOR)))


_REJECT_SQL = _WITH + f"""
SELECT event_id * 4 AS msg_id, {_TEL_TOPIC} AS topic,
  CASE event_id % {L.TEL_MOD} WHEN 2 THEN 'type:value' WHEN 4 THEN 'type:value' WHEN 5 THEN 'null:device_id'
       WHEN 8 THEN 'length:metric' ELSE 'malformed' END AS reason
FROM telemetry WHERE event_id % {L.TEL_MOD} IN {_TEL_BAD}
UNION ALL
SELECT event_id * 4 + 1, '{M.TOPIC_WEATHER}',
  CASE event_id % {L.WX_MOD} WHEN 3 THEN 'null:time' WHEN 4 THEN 'type:time' ELSE 'type:weathercode' END
FROM wx WHERE event_id % {L.WX_MOD} IN {_WX_BAD}
UNION ALL
SELECT id * 4 + 2, {_ACT_TOPIC},
  CASE id % {L.ACT_MOD} WHEN 1 THEN 'null:actuator_id' WHEN 2 THEN 'null:action' ELSE 'length:action' END
FROM actuator_logs WHERE id % {L.ACT_MOD} IN {_ACT_BAD}"""


def _all_rejects(spark, sf_dir):
    m = L.messages(spark, sf_dir)
    return (M.rejected(M.parse_telemetry(M.route_by_topic(m, M.KIND_TELEMETRY)))
            .unionByName(M.rejected(M.parse_weather(M.route_by_topic(m, M.KIND_WEATHER))))
            .unionByName(M.rejected(M.parse_actuator(M.route_by_topic(m, M.KIND_ACTUATOR)))))


@register("reject_bad_rows", _REJECT_SQL)
def reject_bad_rows(spark, sf_dir):
    """Dead-letter rows of every handler with the reason they were refused."""
    return _all_rejects(spark, sf_dir)


@register("notnull_constraints", "SELECT * FROM (" + _REJECT_SQL + ") r WHERE reason LIKE 'null:%' OR reason LIKE 'length:%'")
def notnull_constraints(spark, sf_dir):
    """Rows refused by the target tables' NOT NULL and length limits."""
    r = _all_rejects(spark, sf_dir)
    return r.filter(F.col("reason").startswith("null:") | F.col("reason").startswith("length:"))


@register("status_relays", _WITH + f"""
SELECT event_id * 4 + 3 AS msg_id, device_id,
  CASE WHEN k >= 60 THEN 'NORMAL' WHEN k >= 20 THEN 'DEGRADED' ELSE 'SAFETY' END AS mode,
  r.relay, CASE r.relay WHEN 'light_grow' THEN (CASE WHEN k % 2 = 0 THEN 'ON' ELSE 'OFF' END)
                        WHEN 'fan_extractor' THEN (CASE WHEN k % 3 = 0 THEN 'ON' ELSE 'OFF' END)
                        ELSE (CASE WHEN k % 5 = 0 THEN 'ON' ELSE 'OFF' END) END AS state
FROM st, (VALUES ('light_grow'), ('fan_extractor'), ('fan_stirring')) r(relay) WHERE k % 7 <> 0""")
def status_relays(spark, sf_dir):
    """Status pings (JSON with a relays MAP) flattened to one row per relay."""
    s = M.parse_status(_msgs(spark, sf_dir, M.KIND_STATUS))
    return s.select("msg_id", "device_id", "mode", F.explode("relays").alias("relay", "state"))


@register("expected_lux", _WITH + f"""
SELECT event_id * 4 + 3 AS msg_id, device_id,
  {C.LUX_BASE}e0 + CASE WHEN k % 2 = 0 THEN {C.LUX_GROW_LIGHT}e0 ELSE 0e0 END
    + {C.LUX_SUN_FULL}e0 * (k / 100e0) AS lux
FROM st WHERE k % 7 <> 0""")
def expected_lux(spark, sf_dir):
    """Modelled light level of every status ping (grow light and louver position)."""
    s = M.parse_status(_msgs(spark, sf_dir, M.KIND_STATUS))
    on = F.col("relays").getItem("light_grow") == "ON"
    return s.select("msg_id", "device_id",
                    lux_expr(on, F.col("louvers_position").cast("double")).alias("lux"))
