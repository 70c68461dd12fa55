"""Decision boundaries as a hand-written edge table."""

import math

import pytest
from pyspark.sql import functions as F

from canopy.plans.control import decision

CASES = [
    # elapsed_s, last_pump, ph, ec, expected
    (59.9, "pump_ph_plus", 6.0, 1.4, "WAITING"),
    (60.0, "pump_ph_plus", 6.0, 1.4, "STABLE"),
    (None, None, None, 1.4, "NO_DATA"),
    (None, None, 6.0, 1.8, "EMERGENCY_STOP"),
    (None, None, 6.0, 1.7, "STABLE"),
    (None, None, 4.5, 1.4, "DOSE_PH_PLUS"),
    (None, None, 8.0, 1.4, "DOSE_PH_MINUS"),
    (None, None, 4.4, 1.4, "EMERGENCY_STOP"),
    (None, None, 8.1, 1.4, "EMERGENCY_STOP"),
    (None, None, 6.0, 1.2, "DOSE_NUTRI_A"),
    (100.0, "pump_nutri_1", 6.0, 1.2, "DOSE_NUTRI_B"),
    (100.0, "pump_nutri_2", 6.0, 1.2, "DOSE_NUTRI_A"),
    (None, None, 6.2, 1.4, "DOSE_PH_MINUS"),
    (None, None, 5.8, 1.4, "DOSE_PH_PLUS"),
    (None, None, 6.1, 1.4, "STABLE"),
    # abs(6.15 - 6.0) is 0.15000000000000036 in doubles, as in the original's Python
    (None, None, 6.15, 1.4, "DOSE_PH_MINUS"),
    (None, None, math.nan, 1.4, "NO_DATA"),
]


def test_decision_table(spark):
    df = spark.createDataFrame(CASES, "elapsed double, last string, ph double, ec double, exp string")
    out = df.select("exp", decision(F.col("ph"), F.col("ec"), F.col("elapsed"), F.col("last"), 60.0)
                    .alias("got")).collect()
    assert [(r.exp, r.got) for r in out] == [(r.exp, r.exp) for r in out]


def test_replay_outcome_counts(spark):
    from canopy.plans.control import ControlParams, control_replay
    rows = control_replay(spark, "/root/testdata/sf0.01", ControlParams()).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in rows} == {
        "DOSE_NUTRI_A": 1347, "DOSE_NUTRI_B": 359, "DOSE_PH_MINUS": 718, "DOSE_PH_PLUS": 950,
        "EMERGENCY_STOP": 353, "NO_DATA": 36, "STABLE": 325, "WAITING": 1672}


def test_per_device_lock_only_waits_more_locally(spark):
    from canopy.plans.control import ControlParams, control_replay
    g = control_replay(spark, "/root/testdata/sf0.001", ControlParams())
    d = control_replay(spark, "/root/testdata/sf0.001", ControlParams(per_device_lock=True))
    assert g.count() == d.count()
    assert d.filter("status = 'WAITING'").count() <= g.filter("status = 'WAITING'").count()


def _tel(spark, rows):
    return spark.createDataFrame(rows, "event_id long, time timestamp_ntz, device_id string, metric string, value double")


def _acts(spark, rows):
    return spark.createDataFrame(rows, "id long, time timestamp_ntz, device_id string, actuator_id string, "
                                       "action string, duration_ms int, trigger_source string")


def test_aberrant_ph_does_not_dose(spark):
    """Planned acceptance test of the original: a pH of -2 must not trigger a dose."""
    import datetime as dt
    from canopy.plans.control import ControlParams, control_replay
    t0 = dt.datetime(2024, 3, 1, 12)
    tel = _tel(spark, [(1, t0 - dt.timedelta(seconds=30), "n1", "ph", -2.0),
                       (2, t0 - dt.timedelta(seconds=20), "n1", "ec", 1.4)])
    acts = _acts(spark, [(1, t0 - dt.timedelta(days=1), "n1", "pump_ph_plus", "COMPLETED", 1000, "auto_backend")])
    p = ControlParams(tick_s=60, lookback_s=120, mixing_delay_s=60.0, origin=t0, end=t0)
    out = control_replay(spark, "", p, telemetry=tel, actions=acts).collect()
    assert [(r.status, r.command_target) for r in out] == [("EMERGENCY_STOP", None)]


def test_rate_limit_refuses(spark):
    """Planned acceptance test of the original: pumping beyond 5 s per hour is refused."""
    import datetime as dt
    from pyspark.sql import functions as F
    from canopy.operators.sequence import trailing_sum_exact
    t0 = dt.datetime(2024, 3, 1, 12)
    rows = [(i, t0 + dt.timedelta(minutes=10 * i), "n1", "pump_ph_minus", "COMPLETED", 2000, "auto_backend")
            for i in range(5)]
    rows.append((9, t0 + dt.timedelta(hours=3), "n1", "pump_ph_minus", "COMPLETED", 2000, "auto_backend"))
    a = _acts(spark, rows)
    t = trailing_sum_exact(a, ["device_id", "actuator_id"], "time", "duration_ms", 3600, prefix="w_")
    got = {r.id: (r.w_sum, r.w_sum > 5000) for r in t.collect()}
    assert got == {0: (2000, False), 1: (4000, False), 2: (6000, True), 3: (8000, True), 4: (10000, True),
                   9: (2000, False)}


def test_lock_equals_window_fill(spark):
    """The bucketed as-of gives the lock that one running window over all ticks gives."""
    from pyspark.sql import Window
    import canopy.plans.control as CT
    from canopy.sources import bindings
    sf, p = "/root/testdata/sf0.001", CT.ControlParams()
    origin, _, n = CT._grid(spark, sf, p)
    act = bindings.actuator_logs(spark, sf)
    got = {r.j: (r.last_time, r.last_pump) for r in CT.lock_table(spark, act, p, origin, n).collect()}
    done = sorted((r.time, r.id, r.actuator_id) for r in act.filter("action = 'COMPLETED'").collect())
    import bisect
    import datetime as dt
    times = [d[0] for d in done]
    for j in range(n):
        k = bisect.bisect_right(times, origin + dt.timedelta(seconds=p.tick_s * j))
        assert got[j] == ((done[k - 1][0], done[k - 1][2]) if k else (None, None))
    assert len(got) == n


def test_non_finite_readings_are_missing(spark):
    """NaN and infinite readings neither enter an average nor stop the job, in replay and in sums."""
    import datetime as dt
    from canopy.functions.numeric import exact_avg
    from canopy.plans.control import ControlParams, control_replay
    t0 = dt.datetime(2024, 3, 1, 12)
    at = t0 - dt.timedelta(seconds=30)
    inf = math.inf
    tel = _tel(spark, [(1, at, "n1", "ph", math.nan), (2, at, "n1", "ec", 1.4),
                       (3, at, "n2", "ph", inf), (4, at, "n2", "ph", inf), (5, at, "n2", "ph", 6.0), (6, at, "n2", "ec", 1.4),
                       (7, at, "n3", "ph", 6.0), (8, at, "n3", "ec", -inf)])
    p = ControlParams(tick_s=60, lookback_s=120, mixing_delay_s=60.0, origin=t0, end=t0)
    out = {r.device_id: (r.status, r.avg_ph) for r in control_replay(spark, "", p, telemetry=tel, actions=_acts(spark, [])).collect()}
    assert out == {"n1": ("NO_DATA", None), "n2": ("STABLE", 6.0), "n3": ("NO_DATA", 6.0)}
    v = spark.createDataFrame([(6.0,), (math.nan,), (None,)], "v double").agg(exact_avg(F.col("v")).alias("a")).first()
    assert v.a == 6.0
