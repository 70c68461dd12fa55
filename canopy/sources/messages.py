"""JSON messages -> typed rows, with a dead-letter split.

A message is ``(msg_id, topic, payload STRING, ingest_ts)`` -- the shape of a
Kafka record or a line of a landing file.  Routing is by topic; payloads are
parsed once into a VARIANT, and every field follows the original worker's
Python coercion:

* ``d.get(k, default)``: the default applies only when the key is missing;
  an explicit ``null`` is a value and fails the conversion or the NOT NULL
  column -- VARIANT tells the two apart, ``from_json`` does not.
* ``float(x)`` accepts numbers, booleans and numeric strings (``" 1e3 "``,
  ``"1_000"``); anything else rejects the row.
* ``int(x)`` truncates numbers, accepts integer strings only.
* timestamps are parsed from strings; missing or unparsable rejects.
* NOT NULL and VARCHAR(n) limits of the target table reject.

Rejected rows keep ``(msg_id, topic, reason)``; reasons are ``malformed``,
``type:<field>``, ``null:<field>``, ``length:<field>`` in that priority.
A bare ``NaN`` token is not JSON: Python would accept it, we reject it
(documented divergence).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy import constants as C

# Topics the worker subscribes to, and the node-side topic layout (fixed values).
TOPIC_TELEMETRY = "telemetry_stream"
TOPIC_WEATHER = "weather_raw"
TOPIC_ACTUATOR = "actuator_stream"
NODE_TOPIC = r"^" + C.TOPIC_PREFIX + r"/[^/]+/(telemetry|acks|status)$"

KIND_TELEMETRY, KIND_WEATHER, KIND_ACTUATOR, KIND_STATUS = "telemetry", "weather", "actuator", "status"


def topic_kind(topic: Column) -> Column:
    """Route: exact worker topics, plus ``<prefix>/<node>/<kind>`` node topics.

    Same as matching ``NODE_TOPIC``, with a split instead of a regex per message.
    """
    parts = F.split(topic, "/")
    node_kind = F.when((F.size(parts) == 3) & (parts[0] == C.TOPIC_PREFIX) & (parts[1] != ""), parts[2])
    return (F.when(topic == TOPIC_TELEMETRY, KIND_TELEMETRY)
            .when(topic == TOPIC_WEATHER, KIND_WEATHER)
            .when(topic == TOPIC_ACTUATOR, KIND_ACTUATOR)
            .when(node_kind == "telemetry", KIND_TELEMETRY)
            .when(node_kind == "acks", KIND_ACTUATOR)
            .when(node_kind == "status", KIND_STATUS))


def route_by_topic(msgs: DataFrame, kind: str) -> DataFrame:
    return msgs.filter(topic_kind(F.col("topic")) == kind)


# ---------------------------------------------------------------------------
# field coercion
#
# Parsing is staged: (1) the payload becomes one VARIANT column, (2) each key
# is extracted once into plain columns (present?, JSON null?, string?, as
# string, as double), (3) typed values, (4) the reject reason.  Each stage is
# a separate projection over attribute references, which keeps the generated
# code small and every VARIANT lookup computed once per row.
# ---------------------------------------------------------------------------

@dataclass
class Field:
    present: Column     # key exists (value may be JSON null)
    value: Column       # converted value, NULL when absent or not convertible
    bad_type: Column    # present but not convertible


_PY_UNDERSCORE = r"(?<=[0-9])_(?=[0-9])"


def _extract(df: DataFrame, keys: list[str], typed_keys: tuple[str, ...] = ()) -> DataFrame:
    """One column set per key; ``typed_keys`` also get ``__isstr`` (scalar type test)."""
    v = F.col("v")
    df = df.select("*", *[F.try_variant_get(v, f"$.{k}", "variant").alias(f"{k}__raw") for k in keys])
    cols = []
    for k in keys:
        raw = F.col(f"{k}__raw")
        cols += [raw.isNotNull().alias(f"{k}__present"),
                 F.coalesce(F.is_variant_null(raw), F.lit(False)).alias(f"{k}__jnull"),
                 F.try_variant_get(raw, "$", "string").alias(f"{k}__s"),
                 F.try_variant_get(raw, "$", "double").alias(f"{k}__d")]
        if k in typed_keys:
            cols.append(F.coalesce(F.schema_of_variant(raw) == "STRING", F.lit(False)).alias(f"{k}__isstr"))
    return df.select(*[c for c in df.columns if not c.endswith("__raw")], *cols)


def _c(k: str, part: str) -> Column:
    return F.col(f"{k}__{part}")


def as_float(key: str, default: float | None) -> Field:
    """The VARIANT double cast already takes numbers, booleans and trimmed numeric
    strings; only Python's digit-group underscores need a second try.  The type
    suffixes that the cast takes as well (``1.0d``) are refused."""
    present = _c(key, "present")
    from_str = F.when(_c(key, "s").contains("_"),
                      F.regexp_replace(F.trim(_c(key, "s")), _PY_UNDERSCORE, "").try_cast("double"))
    suffixed = F.coalesce(_c(key, "s").rlike(r"[0-9.][dDfF]\s*$"), F.lit(False))
    num = F.when(~suffixed, F.coalesce(_c(key, "d"), from_str))
    value = F.when(~present, F.lit(default)).otherwise(num) if default is not None else num
    return Field(present, value, present & num.isNull())


def as_int(key: str, default: int | None) -> Field:
    present = _c(key, "present")
    s = F.trim(_c(key, "s"))
    from_str = F.when(s.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.regexp_replace(s, "_", "").try_cast("int"))
    num = F.when(_c(key, "isstr"), from_str).otherwise(_c(key, "d").try_cast("int"))
    value = F.when(~present, F.lit(default)).otherwise(num) if default is not None else num
    return Field(present, value, present & num.isNull())


def as_rounded_int(key: str) -> Field:
    """Nullable INT fed by a Python value: floats round half-even, strings must be integers."""
    present = _c(key, "present") & ~_c(key, "jnull")
    s = F.trim(_c(key, "s"))
    from_str = F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("int"))
    num = F.when(_c(key, "isstr"), from_str).otherwise(F.bround(_c(key, "d"), 0).try_cast("int"))
    return Field(present, F.when(present, num), present & num.isNull())


def as_string(key: str, default: str | None = None) -> Field:
    present = _c(key, "present")
    val = _c(key, "s")
    value = F.when(~present, F.lit(default)).otherwise(val) if default is not None else val
    return Field(present, value, F.lit(False))


def as_timestamp(key: str) -> Field:
    present = _c(key, "present") & ~_c(key, "jnull")
    ts = F.when(_c(key, "isstr"), F.trim(_c(key, "s")).try_cast("timestamp_ntz"))
    return Field(present, ts, present & ts.isNull())


# ---------------------------------------------------------------------------
# parsers
# ---------------------------------------------------------------------------

def _reason(checks: list[tuple[Column, str]]) -> Column:
    expr = F.lit(None).cast("string")
    for cond, reason in reversed(checks):
        expr = F.when(cond, F.lit(reason)).otherwise(expr)
    return expr


def _too_long(value: Column, field: str) -> Column:
    return F.coalesce(F.length(value) > C.VARCHAR_LIMITS[field], F.lit(False))


def _parsed(msgs: DataFrame, keys: list[str], typed_keys: tuple[str, ...] = ()) -> DataFrame:
    # valid JSON whose first character is '{' is an object
    p = msgs.select("*", F.try_parse_json(F.col("payload")).alias("v"))
    p = p.select("*", (F.col("v").isNotNull() & F.ltrim(F.col("payload")).startswith("{")).alias("__obj"))
    return _extract(p, keys, typed_keys)


def _finish(p: DataFrame, keep: list[str], fields: dict[str, Field],
            checks: list[tuple[Column | str, str]]) -> DataFrame:
    typed = p.select(*keep, "__obj",
                     *[f.value.alias(n) for n, f in fields.items()],
                     *[f.bad_type.alias(f"{n}__bad") for n, f in fields.items()])
    conds = [(F.col(c) if isinstance(c, str) else c, r) for c, r in checks]
    row = F.struct(*[F.col(c) for c in keep], *[F.col(c) for c in fields], _reason(conds).alias("reason"))
    # A one-element inline (Generate) ends the parse: filters on its output --
    # the accepted / rejected split -- stay above it instead of being pushed
    # down with every alias inlined, which would re-parse the JSON per reference.
    return typed.select(F.inline(F.array(row)))


def parse_telemetry(msgs: DataFrame) -> DataFrame:
    """Telemetry messages -> rows ``(msg_id, time, device_id, metric, value, reason)``.

    ``reason`` is NULL for accepted rows; split with :func:`accepted` /
    :func:`rejected`.  ``time`` is the ingest time (the original stamps NOW()).
    """
    p = _parsed(msgs, ["device_id", "metric", "value"]).withColumnRenamed("ingest_ts", "time")
    fields = {"device_id": as_string("device_id"), "metric": as_string("metric"),
              "value": as_float("value", 0.0)}
    return _finish(p, ["msg_id", "topic", "time"], fields, [
        (~F.col("__obj"), "malformed"),
        ("value__bad", "type:value"),
        (F.col("device_id").isNull(), "null:device_id"),
        (F.col("metric").isNull(), "null:metric"),
        (_too_long(F.col("device_id"), "device_id"), "length:device_id"),
        (_too_long(F.col("metric"), "metric"), "length:metric"),
    ]).select("msg_id", "topic", "time", "device_id", "metric", "value", "reason")


def parse_weather(msgs: DataFrame) -> DataFrame:
    """Weather messages -> ``(msg_id, time, sensor_name, temperature, windspeed, weathercode, reason)``."""
    p = _parsed(msgs, ["temperature", "windspeed", "weathercode", "time", "sensor_name"],
                typed_keys=("weathercode", "time"))
    fields = {"time": as_timestamp("time"), "sensor_name": as_string("sensor_name", C.DEFAULT_SENSOR_NAME),
              "temperature": as_float("temperature", 0.0), "windspeed": as_float("windspeed", 0.0),
              "weathercode": as_int("weathercode", 0)}
    return _finish(p, ["msg_id", "topic"], fields, [
        (~F.col("__obj"), "malformed"),
        ("temperature__bad", "type:temperature"),
        ("windspeed__bad", "type:windspeed"),
        ("weathercode__bad", "type:weathercode"),
        ("time__bad", "type:time"),
        (F.col("time").isNull(), "null:time"),
        (_too_long(F.col("sensor_name"), "sensor_name"), "length:sensor_name"),
    ])


def parse_actuator(msgs: DataFrame) -> DataFrame:
    """Ack messages -> ``(msg_id, time, actuator_id, action, duration_ms, trigger_source, reason)``."""
    p = _parsed(msgs, ["actuator", "status", "actual_duration_ms"],
                typed_keys=("actual_duration_ms",)).withColumnRenamed("ingest_ts", "time")
    fields = {"actuator_id": as_string("actuator"), "action": as_string("status"),
              "duration_ms": as_rounded_int("actual_duration_ms")}
    out = _finish(p, ["msg_id", "topic", "time"], fields, [
        (~F.col("__obj"), "malformed"),
        (F.col("actuator_id").isNull(), "null:actuator_id"),
        (F.col("action").isNull(), "null:action"),
        ("duration_ms__bad", "type:duration_ms"),
        (_too_long(F.col("actuator_id"), "actuator_id"), "length:actuator_id"),
        (_too_long(F.col("action"), "action"), "length:action"),
    ])
    from canopy.functions.commands import canonical_pump
    return out.select("msg_id", "topic", "time", canonical_pump(F.col("actuator_id")).alias("actuator_id"),
                      "action", "duration_ms", F.lit(C.TRIGGER_SOURCE).alias("trigger_source"), "reason")


STATUS_SCHEMA = "device_id string, uptime_s long, mode string, louvers_position int, relays map<string,string>"


def check_status(msgs: DataFrame) -> DataFrame:
    """Status pings -> ``(msg_id, topic, time, device_id, uptime_s, mode, louvers_position, relays MAP, reason)``."""
    p = msgs.select("msg_id", "topic", F.col("ingest_ts").alias("time"),
                    F.try_parse_json(F.col("payload")).alias("v"), F.ltrim(F.col("payload")).startswith("{").alias("obj"))
    v = F.col("v")
    typed = p.select("msg_id", "topic", "time",
                     F.try_variant_get(v, "$.device_id", "string").alias("device_id"),
                     F.try_variant_get(v, "$.uptime_s", "long").alias("uptime_s"),
                     F.try_variant_get(v, "$.mode", "string").alias("mode"),
                     F.try_variant_get(v, "$.louvers_position", "int").alias("louvers_position"),
                     F.try_variant_get(v, "$.relays", "map<string,string>").alias("relays"),
                     (v.isNotNull() & F.col("obj")).alias("obj"))
    return typed.withColumn("reason", _reason([(~F.coalesce("obj", F.lit(False)), "malformed"), (F.col("device_id").isNull(), "null:device_id")])).drop("obj")


def parse_status(msgs: DataFrame) -> DataFrame:
    """Status pings that name their device."""
    return accepted(check_status(msgs))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).drop("reason", "topic")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull()).select("msg_id", "topic", "reason")
