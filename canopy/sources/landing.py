"""A landing zone of JSON messages derived from the driver's ``events`` table.

Every event becomes one message (``msg_id = 4 * event_id + kind``):
view/click/signup -> telemetry, signup -> also weather, purchase -> actuator
ack, error -> node status ping (or an unrouted debug topic).  Payloads are
mostly clean; fixed rules on ``event_id`` inject the malformed shapes the
ingest must handle (missing keys, explicit nulls, strings for numbers,
garbage, over-long fields).  Every event is kept; the rules only choose the
payload's shape.  The same rules are written as SQL in ``plans/messages.py``
for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy import constants as C
from canopy.sources import bindings as B
from canopy.sources.messages import TOPIC_ACTUATOR, TOPIC_TELEMETRY, TOPIC_WEATHER
from canopy.sources.tables import read_table

# Fault-injection rules: modulus and the payload shape chosen per remainder.
TEL_MOD, WX_MOD, ACT_MOD = 50, 40, 30


def _q(c: Column) -> Column:
    """A JSON string literal (the derived values contain no quotes or escapes)."""
    return F.concat(F.lit('"'), c, F.lit('"'))


def _num(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def _json(*fields: tuple[str, Column]) -> Column:
    """``{"k": <json text>, ...}`` from already-encoded values (plain concat: small codegen)."""
    parts = []
    for i, (name, val) in enumerate(fields):
        parts += [F.lit(("," if i else "") + f'"{name}":'), val]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def _node_topic(device: Column, kind: str) -> Column:
    return F.concat(F.lit(C.TOPIC_PREFIX + "/"), device, F.lit("/" + kind))


def telemetry_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = B.telemetry(spark, sf_dir)
    r = F.col("event_id") % TEL_MOD
    d, m, v = F.col("device_id"), F.col("metric"), F.col("value")
    dq, mq = _q(d), _q(F.when(r == 8, F.concat(m, F.repeat(F.lit("x"), 60))).otherwise(m))
    value = (F.when(r == 2, F.lit("null")).when(r == 3, _q(v.cast("string")))
             .when(r == 4, F.lit('"abc"')).when(r == 9, F.lit("true")).otherwise(_num(v)))
    payload = (F.when(r == 1, _json(("device_id", dq), ("metric", mq)))
               .when(r == 5, _json(("metric", mq), ("value", value)))
               .when(r == 6, F.lit("not json"))
               .when(r == 7, F.lit("[1]"))
               .otherwise(_json(("device_id", dq), ("metric", mq), ("value", value))))
    topic = F.when(F.col("event_id") % 2 == 0, F.lit(TOPIC_TELEMETRY)).otherwise(_node_topic(d, "telemetry"))
    return t.select((F.col("event_id") * 4).alias("msg_id"), topic.alias("topic"),
                    payload.alias("payload"), F.col("time").alias("ingest_ts"))


def weather_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = B.weather_metrics(spark, sf_dir, with_id=True)
    r = F.col("event_id") % WX_MOD
    t, ws, k, s = F.col("temperature"), F.col("windspeed"), F.col("weathercode"), F.col("sensor_name")
    tm = _q(F.when(r == 4, F.lit("yesterday"))
            .otherwise(F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
    sq = F.when(r == 2, F.lit("null")).otherwise(_q(s))
    kq = (F.when(r == 5, _num(k + F.lit(0.7))).when(r == 6, _q(k.cast("string")))
          .when(r == 7, _q(F.concat(k.cast("string"), F.lit(".7")))).otherwise(_num(k)))
    nums = [("temperature", _num(t)), ("windspeed", _num(ws)), ("weathercode", kq)]
    payload = (F.when(r == 1, _json(("time", tm), ("sensor_name", sq)))
               .when(r == 3, _json(*nums, ("sensor_name", sq)))
               .when(r == 8, _json(*nums, ("time", tm)))
               .otherwise(_json(*nums, ("time", tm), ("sensor_name", sq))))
    return w.select((F.col("event_id") * 4 + 1).alias("msg_id"), F.lit(TOPIC_WEATHER).alias("topic"),
                    payload.alias("payload"), F.col("time").alias("ingest_ts"))


def actuator_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = B.actuator_logs(spark, sf_dir)
    r = F.col("id") % ACT_MOD
    ac, st, du = F.col("actuator_id"), F.col("action"), F.col("duration_ms")
    aq = _q(ac)
    sq = _q(F.when(r == 4, F.concat(st, F.repeat(F.lit("!"), 20))).otherwise(st))
    dq = F.when(r == 5, _q(du.cast("string"))).otherwise(_num(du))
    payload = (F.when(r == 1, _json(("status", sq), ("actual_duration_ms", dq)))
               .when(r == 2, _json(("actuator", aq), ("actual_duration_ms", dq)))
               .when(r == 3, _json(("actuator", aq), ("status", sq)))
               .otherwise(_json(("actuator", aq), ("status", sq), ("actual_duration_ms", dq))))
    topic = F.when(F.col("id") % 2 == 0, F.lit(TOPIC_ACTUATOR)).otherwise(
        _node_topic(F.col("device_id"), "acks"))
    return a.select((F.col("id") * 4 + 2).alias("msg_id"), topic.alias("topic"),
                    payload.alias("payload"), F.col("time").alias("ingest_ts"))


def status_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    k = F.regexp_extract(F.col("props"), r"([0-9]+)", 1).try_cast("int")
    dev = F.concat(F.lit("node"), (F.col("user_id") % B.DEVICES).cast("string"))
    onoff = lambda c: F.when(c, F.lit("ON")).otherwise(F.lit("OFF"))
    relays = _json(("light_grow", _q(onoff(k % 2 == 0))), ("fan_extractor", _q(onoff(k % 3 == 0))),
                   ("fan_stirring", _q(onoff(k % 5 == 0))))
    mode = F.when(k >= 60, "NORMAL").when(k >= 20, "DEGRADED").otherwise("SAFETY")
    payload = _json(("device_id", _q(dev)), ("uptime_s", _num(F.col("event_id"))), ("mode", _q(mode)),
                    ("louvers_position", _num(k)), ("relays", relays))
    topic = F.when(k % 7 == 0, _node_topic(dev, "debug")).otherwise(_node_topic(dev, "status"))
    return e.select((F.col("event_id") * 4 + 3).alias("msg_id"), topic.alias("topic"),
                    payload.alias("payload"), F.col("ts").alias("ingest_ts"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages: (msg_id, topic, payload, ingest_ts)."""
    return (telemetry_messages(spark, sf_dir)
            .unionByName(weather_messages(spark, sf_dir))
            .unionByName(actuator_messages(spark, sf_dir))
            .unionByName(status_messages(spark, sf_dir)))
