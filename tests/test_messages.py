"""JSON coercion edge rows (FIXTURES 2) through the ingest parsers."""

import datetime as dt

from pyspark.sql import functions as F

from canopy.sources import messages as M


def _msgs(spark, payloads, topic):
    rows = [(i, topic, p, dt.datetime(2024, 1, 1)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "msg_id long, topic string, payload string, ingest_ts timestamp_ntz")


def test_telemetry_coercion(spark):
    base = '"device_id":"mock_node2_wet","metric":"ph"'
    cases = [
        ("{" + base + "}", 0.0),
        ("{" + base + ',"value":null}', "type:value"),
        ("{" + base + ',"value":"6.1"}', 6.1),
        ("{" + base + ',"value":" 1e3 "}', 1000.0),
        ("{" + base + ',"value":"1_000"}', 1000.0),
        ("{" + base + ',"value":true}', 1.0),
        ("{" + base + ',"value":"abc"}', "type:value"),
        ("{" + base + ',"value":6.5}', 6.5),
        ('{"metric":"ph","value":1}', "null:device_id"),
        ('{"device_id":null,"metric":"ph","value":1}', "null:device_id"),
        ('{"device_id":"' + "d" * 51 + '","metric":"ph","value":1}', "length:device_id"),
        ("[1]", "malformed"),
        ("not json", "malformed"),
        ("{" + base + ',"value":NaN}', "malformed"),
    ]
    out = M.parse_telemetry(_msgs(spark, [c for c, _ in cases], "telemetry_stream")) \
        .orderBy("msg_id").collect()
    for (payload, exp), r in zip(cases, out):
        got = r.reason if r.reason else r.value
        assert got == exp, payload


def test_weather_coercion(spark):
    t = '"time":"2026-05-01T16:45"'
    cases = [
        ("{" + t + "}", (0.0, 0.0, 0, "unknown")),
        ("{" + t + ',"sensor_name":null}', (0.0, 0.0, 0, None)),
        ('{"temperature":1}', "null:time"),
        ('{"time":"yesterday"}', "type:time"),
        ("{" + t + ',"weathercode":3.7}', (0.0, 0.0, 3, "unknown")),
        ("{" + t + ',"weathercode":"3"}', (0.0, 0.0, 3, "unknown")),
        ("{" + t + ',"weathercode":"3.7"}', "type:weathercode"),
        ("{" + t + ',"temperature":12.3,"windspeed":4.0,"weathercode":3,"sensor_name":"x"}',
         (12.3, 4.0, 3, "x")),
    ]
    out = M.parse_weather(_msgs(spark, [c for c, _ in cases], "weather_raw")).orderBy("msg_id").collect()
    for (payload, exp), r in zip(cases, out):
        got = r.reason if r.reason else (r.temperature, r.windspeed, r.weathercode, r.sensor_name)
        assert got == exp, payload
    ok = [r for r in out if r.reason is None]
    assert all(r.time == dt.datetime(2026, 5, 1, 16, 45) for r in ok)


def test_actuator_and_routing(spark):
    cases = ['{"actuator":"pump_ph_minus","status":"COMPLETED","actual_duration_ms":1000}',
             '{"cmd_id":"c1","status":"STARTED"}',
             '{"actuator":"fan_extractor","status":"COMPLETED","actual_duration_ms":1000.5}']
    out = M.parse_actuator(_msgs(spark, cases, "actuator_stream")).orderBy("msg_id").collect()
    assert out[0].reason is None and out[0].duration_ms == 1000 and out[0].trigger_source == "auto_backend"
    assert out[1].reason == "null:actuator_id"
    assert out[2].duration_ms == 1000  # half-even rounding of the INT column
    topics = spark.createDataFrame([("telemetry_stream",), ("site/node2/telemetry",), ("site/node1/acks",),
                                    ("weather_raw",), ("other",), ("site/node3/status",)], "topic string")
    kinds = [r.k for r in topics.select(M.topic_kind(F.col("topic")).alias("k")).collect()]
    assert kinds == ["telemetry", "telemetry", "actuator", "weather", None, "status"]
