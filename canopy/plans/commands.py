"""Commands and acknowledgements: matching, lost commands, ack rows, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy import constants as C
from canopy.functions.commands import normalize_commands
from canopy.plans.registry import register
from canopy.sources import bindings as B

ACK_WINDOW_DAYS = 30
W_CA = B.with_views("commands", "acks")
# Command targets of the bound view are order priorities; they stand for the pumps.
PRIORITY_PUMP = {"1-URGENT": C.PUMP_PH_MINUS, "2-HIGH": C.PUMP_PH_PLUS, "3-MEDIUM": C.PUMP_NUTRI_1,
                 "4-NOT SPECIFIED": C.PUMP_NUTRI_2, "5-LOW": C.PUMP_NUTRI_3}


def _ack_cond(c, a):
    return ((a["cmd_id"] == c["cmd_id"]) & (a["time"] >= c["time"])
            & (a["time"] <= c["time"] + F.make_interval(days=F.lit(ACK_WINDOW_DAYS))))


@register("command_ack", W_CA + f"""
SELECT c.cmd_id, c.target, c.time AS cmd_time, a.time AS ack_time, a.status
FROM commands c JOIN acks a
  ON a.cmd_id = c.cmd_id AND a.time >= c.time AND a.time <= c.time + INTERVAL {ACK_WINDOW_DAYS} DAY""")
def command_ack(spark, sf_dir):
    """Commands matched to their acks (same cmd_id, within 30 days)."""
    c, a = B.commands(spark, sf_dir).alias("c"), B.acks(spark, sf_dir).alias("a")
    j = c.join(a, _ack_cond(c, a), "inner")
    return j.select(c["cmd_id"], c["target"], c["time"].alias("cmd_time"),
                    a["time"].alias("ack_time"), a["status"])


@register("command_lost", W_CA + f"""
SELECT c.cmd_id, c.target, c.time FROM commands c
WHERE NOT EXISTS (SELECT 1 FROM acks a WHERE a.cmd_id = c.cmd_id AND a.time >= c.time
                  AND a.time <= c.time + INTERVAL {ACK_WINDOW_DAYS} DAY)""")
def command_lost(spark, sf_dir):
    """Commands with no ack within 30 days (anti join)."""
    c, a = B.commands(spark, sf_dir).alias("c"), B.acks(spark, sf_dir).alias("a")
    return c.join(a, _ack_cond(c, a), "left_anti").select("cmd_id", "target", "time")


_PUMP_CASE_SQL = "CASE target " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITY_PUMP.items()) + " END"


def _pump_col():
    expr = F.lit(None).cast("string")
    for k, v in PRIORITY_PUMP.items():
        expr = F.when(F.col("target") == k, v).otherwise(expr)
    return expr


@register("ack_rows", B.with_views("commands") + f"""
SELECT cmd_id, {_PUMP_CASE_SQL} AS actuator, 'STARTED' AS status, time FROM commands
UNION ALL
SELECT cmd_id, {_PUMP_CASE_SQL}, 'COMPLETED', time + INTERVAL (duration_ms) MILLISECOND FROM commands""")
def ack_rows(spark, sf_dir):
    """Acks a node emits for a PULSE: STARTED at receipt, COMPLETED after the pulse."""
    c = B.commands(spark, sf_dir)
    e = c.select("cmd_id", _pump_col().alias("actuator"), "time", "duration_ms",
                 F.explode(F.array(F.lit("STARTED"), F.lit("COMPLETED"))).alias("status"))
    done = F.col("time") + F.make_dt_interval(secs=(F.col("duration_ms") / F.lit(1000)).cast("decimal(18,6)"))
    return e.select("cmd_id", "actuator", "status",
                    F.when(F.col("status") == "STARTED", F.col("time")).otherwise(done)
                    .cast("timestamp_ntz").alias("time"))


@register("command_validate", B.with_views("command_requests") + """
, typed AS (SELECT cmd_id, device_id, target, CASE WHEN regexp_full_match(trim(duration_ms), '[+-]?[0-9]+') THEN TRY_CAST(trim(duration_ms) AS INT) END AS duration_ms
            FROM command_requests)
SELECT cmd_id, device_id,
  CASE WHEN target IS NULL THEN NULL WHEN target = 'EMERGENCY_STOP' THEN 'ESTOP' ELSE 'PULSE' END AS action,
  CASE target WHEN 'pump_nutri_a' THEN 'pump_nutri_1' WHEN 'pump_nutri_b' THEN 'pump_nutri_2' WHEN 'pump_nutri_c' THEN 'pump_nutri_3' ELSE target END AS target,
  duration_ms, target IS NOT NULL AND duration_ms IS NOT NULL AND device_id IS NOT NULL AS accepted,
  CASE WHEN target IS NULL THEN 'type:target' WHEN duration_ms IS NULL THEN 'type:duration_ms'
       WHEN device_id IS NULL THEN 'type:device_id' END AS reject_reason
FROM typed""")
def command_validate(spark, sf_dir):
    """Typed check of manual commands (target text, duration whole milliseconds, device text), the stop command included."""
    return validate_commands(B.command_requests(spark, sf_dir))


def validate_commands(requests):
    """Requests as received -> typed commands with canonical pumps; any whole duration is accepted, 0 as well."""
    ms = F.trim(F.col("duration_ms"))
    typed = requests.select("cmd_id", "device_id", F.when(F.col("target").isNotNull(), C.COMMAND_ACTION).alias("action"), "target",
                            F.when(ms.rlike(r"^[+-]?[0-9]+$"), ms.try_cast("int")).alias("duration_ms"))
    reason = (F.when(F.col("target").isNull(), "type:target").when(F.col("duration_ms").isNull(), "type:duration_ms")
              .when(F.col("device_id").isNull(), "type:device_id"))
    return normalize_commands(typed).withColumn("reject_reason", reason).select(
        "cmd_id", "device_id", "action", "target", "duration_ms", F.col("reject_reason").isNull().alias("accepted"), "reject_reason")
