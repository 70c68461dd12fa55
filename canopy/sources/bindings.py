"""Reference-shaped views over the driver's tables.

Each view exists twice: as a Spark DataFrame builder (what the library runs)
and as SQL text (what the DuckDB oracle runs).  Both follow the same rules;
the DataFrame form is written so that the ``event_type`` filter and the
column list reach the parquet scan.

Views: telemetry, actuator_logs, weather_metrics, system_events,
image_frames, commands, acks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.sources.tables import read_table

# Users are folded onto this many devices / stations so that per-device
# series stay dense.  Every row is kept; this is a mapping, not a filter.
DEVICES = 8


def _k(col: str = "props") -> Column:
    # try_cast: a props string without digits yields NULL instead of failing the job (ANSI mode)
    return F.regexp_extract(F.col(col), r"([0-9]+)", 1).try_cast("int")


def _device(prefix: str = "node", devices: int | None = None) -> Column:
    """Device of an event's user; ``devices=0`` keeps every user as its own device."""
    d = DEVICES if devices is None else devices
    uid = F.col("user_id") if d == 0 else F.col("user_id") % d
    return F.concat(F.lit(prefix), uid.cast("string"))


def telemetry(spark: SparkSession, sf_dir: str, devices: int | None = None) -> DataFrame:
    """telemetry(event_id, time, device_id, metric, value)."""
    e = read_table(spark, sf_dir, "events")
    et = F.col("event_type")
    return (e.filter(et.isin("view", "click", "signup"))
            .select(
                F.col("event_id"),
                F.col("ts").alias("time"),
                _device(devices=devices).alias("device_id"),
                F.when(et == "view", "ph").when(et == "click", "ec")
                 .otherwise("water_temp").alias("metric"),
                F.when(et == "view", F.lit(4.0) + F.col("value") / 25.0)
                 .when(et == "click", F.lit(0.9) + F.col("value") / 100.0)
                 .otherwise(F.lit(18.0) + F.col("value") / 20.0).alias("value")))


def actuator_logs(spark: SparkSession, sf_dir: str, devices: int | None = None) -> DataFrame:
    """actuator_logs(id, time, device_id, actuator_id, action, duration_ms, trigger_source)."""
    e = read_table(spark, sf_dir, "events")
    k5 = _k() % 5
    return (e.filter(F.col("event_type") == "purchase")
            .select(
                F.col("event_id").alias("id"),
                F.col("ts").alias("time"),
                _device(devices=devices).alias("device_id"),
                F.when(k5 == 0, "pump_ph_minus").when(k5 == 1, "pump_ph_plus")
                 .when(k5 == 2, "pump_nutri_1").when(k5 == 3, "pump_nutri_2")
                 .otherwise("pump_nutri_3").alias("actuator_id"),
                F.when(F.col("event_id") % 4 == 0, "STARTED").otherwise("COMPLETED").alias("action"),
                F.floor(F.col("value") * 100.0).try_cast("int").alias("duration_ms"),
                F.lit("auto_backend").alias("trigger_source")))


def weather_metrics(spark: SparkSession, sf_dir: str, with_id: bool = False) -> DataFrame:
    """weather_metrics(time, sensor_name, temperature, windspeed, weathercode)."""
    e = read_table(spark, sf_dir, "events")
    return (e.filter(F.col("event_type") == "signup")
            .select(
                *([F.col("event_id")] if with_id else []),
                F.col("ts").alias("time"),
                _device("station").alias("sensor_name"),
                (F.lit(10.0) + F.col("value") / 10.0).alias("temperature"),
                (F.col("value") / 20.0).alias("windspeed"),
                _k().alias("weathercode")))


def system_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """system_events(id, time, level, category, message, is_resolved)."""
    e = read_table(spark, sf_dir, "events")
    k = _k()
    return (e.filter(F.col("event_type") == "error")
            .select(
                F.col("event_id").alias("id"),
                F.col("ts").alias("time"),
                F.when(k < 20, "CRITICAL").when(k < 60, "WARNING").otherwise("INFO").alias("level"),
                _device().alias("category"),
                F.col("props").alias("message"),
                (F.col("event_id") % 3 == 0).alias("is_resolved")))


def sensor_calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sensor_calibrations(id, sensor_id, slope, intercept, last_calibrated): a version for every resolved event."""
    e = read_table(spark, sf_dir, "events")
    k = _k()
    metric = F.when(k % 3 == 0, "ph").when(k % 3 == 1, "ec").otherwise("water_temp")
    return (e.filter((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0))
            .select(F.col("event_id").alias("id"), F.concat_ws(":", _device(), metric).alias("sensor_id"),
                    (F.lit(1.0) + (k % 11 - 5) / 100.0).alias("slope"), ((k % 7 - 3) / 10.0).alias("intercept"),
                    F.col("ts").alias("last_calibrated")))


def tank_refills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tank_refills(id, time, actuator_id): a tank filled up for every resolved INFO event."""
    e = system_events(spark, sf_dir).filter((F.col("level") == "INFO") & F.col("is_resolved"))
    k5 = F.col("id") % 5
    return e.select("id", "time", F.when(k5 == 0, "pump_ph_minus").when(k5 == 1, "pump_ph_plus").when(k5 == 2, "pump_nutri_1")
                    .when(k5 == 3, "pump_nutri_2").otherwise("pump_nutri_3").alias("actuator_id"))


def config_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """config_requests(commit_id, id, mode_auto, target_ph, target_ec, updated_at): updates as received, all text."""
    e = read_table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    key = F.col("event_id")
    return e.select(key.alias("commit_id"), (F.col("user_id") % 4 + 1).cast("string").alias("id"),
                    F.when(key % 3 == 0, "true").when(key % 7 == 0, "maybe").otherwise("0").alias("mode_auto"),
                    F.when(key % 13 == 0, "abc").otherwise(F.concat(F.lit("5."), (key % 10).cast("string"))).alias("target_ph"),
                    F.concat(F.lit(" 1."), (key % 7).cast("string")).alias("target_ec"), F.col("ts").alias("updated_at"))


def command_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """command_requests(cmd_id, target, duration_ms, device_id): manual commands as received, all text."""
    o = read_table(spark, sf_dir, "orders")
    key, p = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    pump = (F.when(p == "1", "pump_ph_minus").when(p == "2", "pump_ph_plus").when(p == "3", "pump_nutri_a")
            .when(p == "4", "pump_nutri_b").otherwise("pump_nutri_c"))
    stop = key % 11 == 0
    return o.select(key.alias("cmd_id"), F.when(stop, "EMERGENCY_STOP").when(key % 17 != 0, pump).alias("target"),
                    F.when(stop, "0").when(key % 19 == 0, "2.5s").when(key % 2 == 0, "15000").otherwise(" 90000").alias("duration_ms"),
                    F.concat(F.lit("node"), (F.col("o_custkey") % DEVICES).cast("string")).alias("device_id"))


IMAGE_EPOCH0 = 1704067200


def image_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_frames(vec_id, sensor_name, ts_epoch, image_path, embedding).

    ``embedding`` (64 floats) is read as an 8x8 grey image.
    """
    v = read_table(spark, sf_dir, "embeddings")
    sensor = F.concat(F.lit("cam"), F.col("label").cast("string"))
    ts = F.lit(IMAGE_EPOCH0) + F.col("vec_id")
    return v.select(
        F.col("vec_id"),
        sensor.alias("sensor_name"),
        ts.alias("ts_epoch"),
        F.concat(sensor, F.lit("_"), ts.cast("string"), F.lit(".jpg")).alias("image_path"),
        F.col("embedding"))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commands(cmd_id, time, target, duration_ms): five priorities = five pumps."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("cmd_id"), F.col("o_orderdate").alias("time"),
                    F.col("o_orderpriority").alias("target"), F.lit(1000).alias("duration_ms"))


def acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """acks(cmd_id, time, status)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("cmd_id"), F.col("l_shipdate").alias("time"),
                     F.col("l_linestatus").alias("status"))


BUILDERS = {
    "sensor_calibrations": sensor_calibrations,
    "tank_refills": tank_refills,
    "config_requests": config_requests,
    "command_requests": command_requests,
    "telemetry": telemetry,
    "actuator_logs": actuator_logs,
    "weather_metrics": weather_metrics,
    "system_events": system_events,
    "image_frames": image_frames,
    "commands": commands,
    "acks": acks,
}


# ---------------------------------------------------------------------------
# SQL text of the same views (DuckDB oracle; also parses in Spark SQL)
# ---------------------------------------------------------------------------

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
_DEV = f"'node' || CAST(user_id % {DEVICES} AS STRING)"

VIEW_SQL = {
    "telemetry": f"""SELECT event_id, ts AS time, {_DEV} AS device_id,
  CASE event_type WHEN 'view' THEN 'ph' WHEN 'click' THEN 'ec' ELSE 'water_temp' END AS metric,
  CASE event_type WHEN 'view' THEN 4e0 + value / 25e0
                  WHEN 'click' THEN 9e-1 + value / 100e0
                  ELSE 18e0 + value / 20e0 END AS value
FROM events WHERE event_type IN ('view','click','signup')""",
    "actuator_logs": f"""SELECT event_id AS id, ts AS time, {_DEV} AS device_id,
  CASE {_K} % 5 WHEN 0 THEN 'pump_ph_minus' WHEN 1 THEN 'pump_ph_plus' WHEN 2 THEN 'pump_nutri_1'
             WHEN 3 THEN 'pump_nutri_2' ELSE 'pump_nutri_3' END AS actuator_id,
  CASE WHEN event_id % 4 = 0 THEN 'STARTED' ELSE 'COMPLETED' END AS action,
  CAST(floor(value * 100e0) AS INT) AS duration_ms, 'auto_backend' AS trigger_source
FROM events WHERE event_type = 'purchase'""",
    "weather_metrics": f"""SELECT ts AS time, 'station' || CAST(user_id % {DEVICES} AS STRING) AS sensor_name,
  1e1 + value / 10e0 AS temperature, value / 20e0 AS windspeed, {_K} AS weathercode
FROM events WHERE event_type = 'signup'""",
    "system_events": f"""SELECT event_id AS id, ts AS time,
  CASE WHEN {_K} < 20 THEN 'CRITICAL' WHEN {_K} < 60 THEN 'WARNING' ELSE 'INFO' END AS level,
  {_DEV} AS category, props AS message, event_id % 3 = 0 AS is_resolved
FROM events WHERE event_type = 'error'""",
    "sensor_calibrations": f"""SELECT event_id AS id,
  {_DEV} || ':' || CASE {_K} % 3 WHEN 0 THEN 'ph' WHEN 1 THEN 'ec' ELSE 'water_temp' END AS sensor_id,
  1e0 + ({_K} % 11 - 5) / 100e0 AS slope, ({_K} % 7 - 3) / 10e0 AS intercept, ts AS last_calibrated
FROM events WHERE event_type = 'error' AND event_id % 3 = 0""",
    "tank_refills": f"""SELECT event_id AS id, ts AS time,
  CASE event_id % 5 WHEN 0 THEN 'pump_ph_minus' WHEN 1 THEN 'pump_ph_plus' WHEN 2 THEN 'pump_nutri_1'
       WHEN 3 THEN 'pump_nutri_2' ELSE 'pump_nutri_3' END AS actuator_id
FROM events WHERE event_type = 'error' AND {_K} >= 60 AND event_id % 3 = 0""",
    "config_requests": """SELECT event_id AS commit_id, CAST(user_id % 4 + 1 AS STRING) AS id,
  CASE WHEN event_id % 3 = 0 THEN 'true' WHEN event_id % 7 = 0 THEN 'maybe' ELSE '0' END AS mode_auto,
  CASE WHEN event_id % 13 = 0 THEN 'abc' ELSE '5.' || CAST(event_id % 10 AS STRING) END AS target_ph,
  ' 1.' || CAST(event_id % 7 AS STRING) AS target_ec, ts AS updated_at
FROM events WHERE event_type = 'error'""",
    "command_requests": f"""SELECT o_orderkey AS cmd_id,
  CASE WHEN o_orderkey % 11 = 0 THEN 'EMERGENCY_STOP' WHEN o_orderkey % 17 <> 0 THEN
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'pump_ph_minus' WHEN '2' THEN 'pump_ph_plus' WHEN '3' THEN 'pump_nutri_a'
         WHEN '4' THEN 'pump_nutri_b' ELSE 'pump_nutri_c' END END AS target,
  CASE WHEN o_orderkey % 11 = 0 THEN '0' WHEN o_orderkey % 19 = 0 THEN '2.5s' WHEN o_orderkey % 2 = 0 THEN '15000' ELSE ' 90000' END AS duration_ms,
  'node' || CAST(o_custkey % {DEVICES} AS STRING) AS device_id
FROM orders""",
    "image_frames": f"""SELECT vec_id, 'cam' || CAST(label AS STRING) AS sensor_name,
  {IMAGE_EPOCH0} + vec_id AS ts_epoch,
  'cam' || CAST(label AS STRING) || '_' || CAST({IMAGE_EPOCH0} + vec_id AS STRING) || '.jpg' AS image_path,
  embedding
FROM embeddings""",
    "commands": "SELECT o_orderkey AS cmd_id, o_orderdate AS time, o_orderpriority AS target, 1000 AS duration_ms FROM orders",
    "acks": "SELECT l_orderkey AS cmd_id, l_shipdate AS time, l_linestatus AS status FROM lineitem",
}


def with_views(*names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH name AS (...), ...`` prefix for an oracle query."""
    parts = [f"{n} AS (\n{VIEW_SQL[n]}\n)" for n in names]
    for n, body in (extra or {}).items():
        parts.append(f"{n} AS (\n{body}\n)")
    return "WITH " + ",\n".join(parts) + "\n"


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Register every bound view as a Spark temp view (for SQL users)."""
    for name, build in BUILDERS.items():
        build(spark, sf_dir).createOrReplaceTempView(name)
