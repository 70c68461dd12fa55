"""System configuration as an append-only change log, node command filters,
and setpoint fallback.

The original keeps one mutable row (``UPDATE system_config ... WHERE id = 1``).
Here every update is an appended, validated row; the current configuration is
the latest row per id (``row_number() = 1``), a one-row frame that joins into
the control plan as a broadcast (its size is fixed by the number of ids).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy import constants as C
from canopy.operators.latest import latest_per_key
from canopy.operators.sequence import asof_join
from canopy.plans.registry import register
from canopy.sources import bindings as B
from canopy.sources.tables import read_table

CONFIG_SCHEMA = "id int, mode_auto boolean, target_ph double, target_ec double, updated_at timestamp_ntz"
RELAYS = ("light_grow", "fan_extractor", "fan_stirring")   # SET_STATE targets a node knows
LOUVERS = "stepper_louvers"                               # the one SET_POSITION target
SETPOINT_VALID_S = 24 * 3600


def config_validate(raw: DataFrame) -> DataFrame:
    """Typed config update ``(mode_auto bool, target_ph float, target_ec float)``; reject otherwise.

    Input columns are strings (as received); output adds ``reason`` (NULL = valid).
    """
    mode = F.lower(F.trim(F.col("mode_auto")))
    mode_b = F.when(mode.isin("true", "1"), True).when(mode.isin("false", "0"), False)
    ph = F.trim(F.col("target_ph")).try_cast("double")
    ec = F.trim(F.col("target_ec")).try_cast("double")
    reason = (F.when(mode_b.isNull(), "type:mode_auto").when(ph.isNull(), "type:target_ph")
              .when(ec.isNull(), "type:target_ec"))
    kept = [c for c in ("commit_id",) if c in raw.columns]
    return raw.select(*kept, F.col("id").cast("int").alias("id"), mode_b.alias("mode_auto"), ph.alias("target_ph"),
                      ec.alias("target_ec"), F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
                      reason.alias("reason"))


def config_update(log: DataFrame, updates: DataFrame) -> DataFrame:
    """Append valid updates to the log (the ``UPDATE ... SET ..., updated_at = NOW()``)."""
    ok = config_validate(updates).filter(F.col("reason").isNull()).drop("reason")
    return log.unionByName(ok)


def compacted(log: DataFrame) -> DataFrame:
    """Latest row per id: by time of update, then by ``commit_id`` where the log has one."""
    order = [F.col("updated_at").desc(), *([F.col("commit_id").desc()] if "commit_id" in log.columns else [])]
    return latest_per_key(log, ["id"], order)


def current_config(log: DataFrame, config_id: int = 1) -> DataFrame:
    """``SELECT mode_auto, target_ph, target_ec FROM system_config WHERE id = 1`` over the log."""
    latest = compacted(log.filter(F.col("id") == config_id))
    return latest.select("id", "mode_auto", "target_ph", "target_ec", "updated_at")


def default_config(spark) -> DataFrame:
    return spark.createDataFrame([(1, True, C.TARGET_PH, C.TARGET_EC, None)], CONFIG_SCHEMA)


def command_apply_filter(cmds: DataFrame) -> DataFrame:
    """What a climate node does with a command: SET_STATE only for known relays,
    SET_POSITION only for the louvers, position clamped to 0..100."""
    act, tgt = F.col("action"), F.col("target")
    accepted = ((act == "SET_STATE") & tgt.isin(*RELAYS)) | ((act == "SET_POSITION") & (tgt == LOUVERS))
    pos = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.col("position"), F.lit(0))))
    return cmds.select("*", accepted.alias("accepted"),
                       F.when(accepted & (act == "SET_POSITION"), pos).alias("applied_position"),
                       F.when(accepted & (act == "SET_STATE"), F.col("state")).alias("applied_state"))


def setpoint_fallback(readings: DataFrame, setpoints: DataFrame, by: list[str], default: float,
                      valid_s: float = SETPOINT_VALID_S, value_col: str = "setpoint") -> DataFrame:
    """Last known setpoint at each reading if it is at most ``valid_s`` old, else ``default``."""
    j = asof_join(readings, setpoints, by, "time", "time", {value_col: "__sp"}, tolerance_s=valid_s,
                  matched_time="setpoint_time")
    return j.withColumn(value_col, F.coalesce(F.col("__sp"), F.lit(float(default)))).drop("__sp")


# ---------------------------------------------------------------------------
# registered queries: the log of bound requests
# ---------------------------------------------------------------------------

_LOG = B.with_views("config_requests") + """,
typed AS (
  SELECT commit_id, CAST(id AS INT) AS id, CASE WHEN lower(trim(mode_auto)) IN ('true', '1') THEN true WHEN lower(trim(mode_auto)) IN ('false', '0') THEN false END AS mode_auto,
         TRY_CAST(trim(target_ph) AS DOUBLE) AS target_ph, TRY_CAST(trim(target_ec) AS DOUBLE) AS target_ec, CAST(updated_at AS TIMESTAMP) AS updated_at
  FROM config_requests),
valid AS (SELECT * FROM typed WHERE mode_auto IS NOT NULL AND target_ph IS NOT NULL AND target_ec IS NOT NULL),
latest AS (SELECT DISTINCT ON (id) id, mode_auto, target_ph, target_ec, updated_at FROM valid ORDER BY id, updated_at DESC, commit_id DESC)"""


def bound_log(spark, sf_dir) -> DataFrame:
    """Valid updates of the bound requests: the config log."""
    return config_validate(B.config_requests(spark, sf_dir)).filter(F.col("reason").isNull()).drop("reason")


@register("config_validate", _LOG + """
SELECT commit_id, id, mode_auto, target_ph, target_ec, updated_at,
  CASE WHEN mode_auto IS NULL THEN 'type:mode_auto' WHEN target_ph IS NULL THEN 'type:target_ph' WHEN target_ec IS NULL THEN 'type:target_ec' END AS reason
FROM typed""")
def config_validate_query(spark, sf_dir):
    """Every configuration request, typed, with the reason for which it is refused."""
    return config_validate(B.config_requests(spark, sf_dir))


@register("config_update", _LOG + "SELECT * FROM latest")
def config_update_query(spark, sf_dir):
    """The configuration table after all updates: an upsert log compacted to the latest valid row per id."""
    return compacted(bound_log(spark, sf_dir)).select("id", "mode_auto", "target_ph", "target_ec", "updated_at")


@register("scan_config", _LOG + "SELECT id, mode_auto, target_ph, target_ec FROM latest")
def scan_config(spark, sf_dir):
    """Current configuration rows, resolved from the log by commit."""
    return compacted(bound_log(spark, sf_dir)).select("id", "mode_auto", "target_ph", "target_ec")


@register("filter_pk", _LOG + "SELECT id, mode_auto, target_ph, target_ec, updated_at FROM latest WHERE id = 1")
def filter_pk(spark, sf_dir):
    """The configuration with id 1; the filter reaches the log before it is compacted."""
    return current_config(bound_log(spark, sf_dir), 1)


@register("setpoint_fallback", _LOG + f""",
t AS (SELECT event_id, CAST(user_id % 4 + 1 AS INT) AS id, ts AS time FROM events WHERE event_type = 'view'),
sp AS (SELECT id, updated_at, arg_max(target_ph, commit_id) AS target_ph FROM valid GROUP BY id, updated_at)
SELECT t.event_id, t.id, t.time, CASE WHEN sp.updated_at >= t.time - INTERVAL {SETPOINT_VALID_S} SECOND THEN sp.updated_at END AS setpoint_time,
       CASE WHEN sp.updated_at >= t.time - INTERVAL {SETPOINT_VALID_S} SECOND THEN sp.target_ph ELSE {C.TARGET_PH}e0 END AS target_ph
FROM t ASOF LEFT JOIN sp ON t.id = sp.id AND t.time >= sp.updated_at""")
def setpoint_fallback_query(spark, sf_dir):
    """The pH setpoint in force at every pH reading, the default where the last one is over 24 h old."""
    e = read_table(spark, sf_dir, "events").filter(F.col("event_type") == "view")
    readings = e.select("event_id", (F.col("user_id") % 4 + 1).cast("int").alias("id"), F.col("ts").alias("time"))
    setpoints = bound_log(spark, sf_dir).groupBy("id", F.col("updated_at").alias("time")).agg(F.max_by("target_ph", "commit_id").alias("target_ph"))
    return setpoint_fallback(readings, setpoints, ["id"], C.TARGET_PH, value_col="target_ph").select(
        "event_id", "id", "time", "setpoint_time", "target_ph")
