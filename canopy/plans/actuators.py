"""Actuator log queries: lock inputs, relay state, dose totals and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy import constants as C
from canopy.operators.latest import latest_per_key, top1
from canopy.operators.sequence import prev_row, trailing_sum_exact
from canopy.plans.registry import register
from canopy.sources import bindings as B
from canopy.sources.tables import as_of

W_A = B.with_views("actuator_logs")
RATE_WINDOW_S = 3600          # rolling window of the dose rate limit
RATE_LIMIT_MS = 5000          # at most this much pumping per pump per window
TANK_CAPACITY_MS = 2_000_000  # pumping time one full tank lasts


def act(spark, sf_dir):
    return B.actuator_logs(spark, sf_dir)


def completed(spark, sf_dir):
    return act(spark, sf_dir).filter(F.col("action") == "COMPLETED")


@register("scan_actuator_logs", W_A + "SELECT * FROM actuator_logs")
def scan_actuator_logs(spark, sf_dir):
    """Full scan of the actuator log."""
    return act(spark, sf_dir)


@register("filter_action", W_A + "SELECT * FROM actuator_logs WHERE action = 'COMPLETED'")
def filter_action(spark, sf_dir):
    """Completed actions only."""
    return completed(spark, sf_dir)


@register("last_completed_action", W_A + """
SELECT time, actuator_id, action FROM actuator_logs WHERE action = 'COMPLETED'
ORDER BY time DESC, id DESC LIMIT 1""")
def last_completed_action(spark, sf_dir):
    """Newest COMPLETED action of the whole log (the mixing lock input)."""
    return top1(completed(spark, sf_dir), [F.col("time").desc(), F.col("id").desc()]) \
        .select("time", "actuator_id", "action")


@register("relay_state", W_A + """
SELECT DISTINCT ON (device_id, actuator_id) device_id, actuator_id,
  CASE WHEN action = 'STARTED' THEN 'ON' ELSE 'OFF' END AS state, time
FROM actuator_logs ORDER BY device_id, actuator_id, time DESC, id DESC""")
def relay_state(spark, sf_dir):
    """Current ON/OFF state of every (device, pump): its newest action."""
    a = act(spark, sf_dir)
    last = latest_per_key(a, ["device_id", "actuator_id"], [F.col("time").desc(), F.col("id").desc()])
    return last.select("device_id", "actuator_id",
                       F.when(F.col("action") == "STARTED", "ON").otherwise("OFF").alias("state"),
                       "time")


@register("dose_totals", W_A + """
SELECT device_id, actuator_id, count(*) AS pulses, CAST(sum(duration_ms) AS BIGINT) AS total_ms
FROM actuator_logs WHERE action = 'COMPLETED' GROUP BY device_id, actuator_id""")
def dose_totals(spark, sf_dir):
    """Pulses and pumping time per device and pump."""
    return completed(spark, sf_dir).groupBy("device_id", "actuator_id").agg(
        F.count(F.lit(1)).alias("pulses"), F.sum("duration_ms").cast("long").alias("total_ms"))


@register("expected_dose_effect", W_A + f"""
SELECT id, device_id, actuator_id, time,
  CASE actuator_id WHEN 'pump_ph_minus' THEN -(duration_ms / 1000e0 * {C.DOSE_IMPACT_PER_SEC}e0)
                   WHEN 'pump_ph_plus' THEN duration_ms / 1000e0 * {C.DOSE_IMPACT_PER_SEC}e0
                   ELSE 0e0 END AS ph_delta,
  CASE WHEN contains(actuator_id, 'pump_nutri')
       THEN duration_ms / 1000e0 * {C.DOSE_IMPACT_PER_SEC}e0 * {C.NUTRIENT_EC_FACTOR}e0 ELSE 0e0 END AS ec_delta
FROM actuator_logs WHERE action = 'COMPLETED'""")
def expected_dose_effect(spark, sf_dir):
    """Modelled pH / EC change of every completed pulse."""
    a = completed(spark, sf_dir)
    impact = F.col("duration_ms") / F.lit(1000.0) * F.lit(C.DOSE_IMPACT_PER_SEC)
    pump = F.col("actuator_id")
    return a.select("id", "device_id", "actuator_id", "time",
                    F.when(pump == C.PUMP_PH_MINUS, -impact).when(pump == C.PUMP_PH_PLUS, impact)
                     .otherwise(F.lit(0.0)).alias("ph_delta"),
                    F.when(pump.contains("pump_nutri"), impact * F.lit(C.NUTRIENT_EC_FACTOR))
                     .otherwise(F.lit(0.0)).alias("ec_delta"))


@register("nutrient_alternate", W_A + """
SELECT id, device_id, time, actuator_id,
  lag(actuator_id) OVER (PARTITION BY device_id ORDER BY time, id) AS prev_pump,
  CASE WHEN lag(actuator_id) OVER (PARTITION BY device_id ORDER BY time, id) IS DISTINCT FROM 'pump_nutri_1'
       THEN 'pump_nutri_1' ELSE 'pump_nutri_2' END AS next_nutrient
FROM actuator_logs WHERE action = 'COMPLETED'""")
def nutrient_alternate(spark, sf_dir):
    """A/B nutrient choice after every completed action (null-safe on the first)."""
    a = completed(spark, sf_dir).select("id", "device_id", "time", "actuator_id")
    p = prev_row(a, ["device_id"], "time", {"actuator_id": "prev_pump"}, order_col="id")
    return p.withColumn("next_nutrient",
                        F.when(~F.col("prev_pump").eqNullSafe(C.PUMP_NUTRI_1), C.PUMP_NUTRI_1)
                        .otherwise(C.PUMP_NUTRI_2))


@register("state_timeline", W_A + """
, s AS (
  SELECT id, device_id, actuator_id, time, CASE WHEN action = 'STARTED' THEN 'ON' ELSE 'OFF' END AS state
  FROM actuator_logs),
c AS (
  SELECT *, lag(state) OVER (PARTITION BY device_id, actuator_id ORDER BY time, id) AS prev_state FROM s)
SELECT device_id, actuator_id, state, time AS span_start,
  lead(time) OVER (PARTITION BY device_id, actuator_id ORDER BY time, id) AS span_end
FROM c WHERE prev_state IS DISTINCT FROM state""")
def state_timeline(spark, sf_dir):
    """ON/OFF spans per pump: equal neighbours merged (gaps and islands)."""
    a = act(spark, sf_dir).select(
        "id", "device_id", "actuator_id", "time",
        F.when(F.col("action") == "STARTED", "ON").otherwise("OFF").alias("state"))
    keys = ["device_id", "actuator_id"]
    p = prev_row(a, keys, "time", {"state": "prev_state"}, order_col="id")
    starts = p.filter(~F.col("prev_state").eqNullSafe(F.col("state")))
    n = prev_row(starts.drop("prev_state"), keys, "time", {"time": "span_end"}, order_col="id",
                 direction="next")
    return n.select("device_id", "actuator_id", "state", F.col("time").alias("span_start"), "span_end")


@register("dose_rate_limit", W_A + f"""
SELECT id, device_id, actuator_id, time, duration_ms,
  CAST(sum(duration_ms) OVER (PARTITION BY device_id, actuator_id ORDER BY time
       RANGE BETWEEN INTERVAL {RATE_WINDOW_S} SECOND PRECEDING AND CURRENT ROW) AS BIGINT) AS ms_window,
  sum(duration_ms) OVER (PARTITION BY device_id, actuator_id ORDER BY time
       RANGE BETWEEN INTERVAL {RATE_WINDOW_S} SECOND PRECEDING AND CURRENT ROW) > {RATE_LIMIT_MS} AS refused
FROM actuator_logs WHERE action = 'COMPLETED'""")
def dose_rate_limit(spark, sf_dir):
    """Pumping time per pump over the rolling hour; refuse beyond the limit."""
    a = completed(spark, sf_dir).select("id", "device_id", "actuator_id", "time", "duration_ms")
    t = trailing_sum_exact(a, ["device_id", "actuator_id"], "time", "duration_ms", RATE_WINDOW_S,
                           prefix="w_")
    return t.select("id", "device_id", "actuator_id", "time", "duration_ms",
                    F.col("w_sum").cast("long").alias("ms_window"),
                    (F.col("w_sum") > RATE_LIMIT_MS).alias("refused"))


@register("tank_forecast", B.with_views("actuator_logs", "tank_refills") + f"""
, done AS (SELECT * FROM actuator_logs WHERE action = 'COMPLETED'),
filled AS (SELECT actuator_id, max(time) AS refilled FROM tank_refills GROUP BY actuator_id),
used AS (
  SELECT d.actuator_id, any_value(f.refilled) AS refilled, CAST(coalesce(sum(d.duration_ms), 0) AS BIGINT) AS total_ms,
         CAST(coalesce(sum(d.duration_ms) FILTER (WHERE f.refilled IS NULL OR d.time > f.refilled), 0) AS BIGINT) AS used_ms,
         date_diff('day', CAST(min(d.time) AS DATE), CAST((SELECT max(ts) FROM events) AS DATE)) + 1 AS days
  FROM done d LEFT JOIN filled f ON d.actuator_id = f.actuator_id GROUP BY d.actuator_id)
SELECT actuator_id, refilled, greatest({TANK_CAPACITY_MS} - used_ms, 0) AS left_ms, CAST(total_ms AS DOUBLE) / days AS ms_per_day,
       CASE WHEN total_ms > 0 THEN greatest({TANK_CAPACITY_MS} - used_ms, 0) / (CAST(total_ms AS DOUBLE) / days) END AS days_left
FROM used""")
def tank_forecast(spark, sf_dir):
    """What is left in each pump's tank since its last refill, and the days until it is empty."""
    return forecast(completed(spark, sf_dir), B.tank_refills(spark, sf_dir), as_of(spark, sf_dir))


def forecast(doses, refills, now, capacity_ms: int = TANK_CAPACITY_MS):
    """Level and days until empty per pump at ``now``.

    A refill fills a tank up, so only doses after the last one count against
    it; the rate is the mean over all days from the first dose to ``now``,
    days without a dose included.  A tank can't hold less than nothing; a pump
    that never dosed for any time has no forecast.
    """
    last = refills.groupBy("actuator_id").agg(F.max("time").alias("refilled"))   # a row a pump
    since = F.col("refilled").isNull() | (F.col("time") > F.col("refilled"))
    used = doses.join(last, "actuator_id", "left").groupBy("actuator_id").agg(
        F.any_value("refilled").alias("refilled"), F.coalesce(F.sum("duration_ms"), F.lit(0)).cast("long").alias("total_ms"),
        F.coalesce(F.sum(F.when(since, F.col("duration_ms"))), F.lit(0)).cast("long").alias("used_ms"),
        (F.datediff(F.lit(now.date()), F.to_date(F.min("time"))) + 1).alias("days"))
    left = F.greatest(F.lit(capacity_ms).cast("long") - F.col("used_ms"), F.lit(0).cast("long"))
    rate = F.col("total_ms") / F.col("days")
    return used.select("actuator_id", "refilled", left.alias("left_ms"), rate.alias("ms_per_day"),
                       F.when(F.col("total_ms") > 0, left / rate).alias("days_left"))


SPACING_S = 15 * 60   # at most one pulse of a pump every 15 minutes


@register("dose_spacing", W_A.replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, req AS (SELECT device_id, actuator_id, id, time,
                 row_number() OVER (PARTITION BY device_id, actuator_id ORDER BY time, id) AS rn
          FROM actuator_logs WHERE action = 'COMPLETED'),
nxt AS (SELECT r.device_id, r.actuator_id, r.id, r.rn, x.id AS nid
        FROM req r ASOF LEFT JOIN req x
          ON r.device_id = x.device_id AND r.actuator_id = x.actuator_id
         AND x.time >= r.time + INTERVAL {SPACING_S} SECOND),
chain AS (SELECT id, nid FROM nxt WHERE rn = 1
          UNION ALL SELECT n.id, n.nid FROM chain c JOIN nxt n ON n.id = c.nid)
SELECT a.id, a.device_id, a.actuator_id, a.time, a.duration_ms
FROM actuator_logs a JOIN chain c ON a.id = c.id""")
def dose_spacing(spark, sf_dir):
    """Pulses kept by the spacing rule (greedy, per device and pump)."""
    from canopy.operators.spacing import greedy_min_gap
    from canopy.session import shared_dir
    from canopy.sources.tables import event_bounds
    shared_dir(spark)
    lo, hi = event_bounds(spark, sf_dir)
    a = completed(spark, sf_dir).select("id", "device_id", "actuator_id", "time", "duration_ms")
    return greedy_min_gap(a, ["device_id", "actuator_id"], "time", "id", SPACING_S,
                          span_s=(hi - lo).total_seconds())
