"""Config change log, node command filter, setpoint fallback."""

import datetime as dt

from pyspark.sql import functions as F

from canopy.plans import config as K
from canopy.plans.control import ControlParams, control_replay

T0 = dt.datetime(2024, 1, 1)


def test_config_log_latest_and_validation(spark):
    log = K.default_config(spark).withColumn("updated_at", F.lit(T0).cast("timestamp_ntz"))
    ups = spark.createDataFrame([
        ("1", "true", "5.8", "1.2", "2024-01-02 00:00:00"),
        ("1", "maybe", "5.9", "1.3", "2024-01-03 00:00:00"),   # rejected
        ("1", "false", "6.2", "abc", "2024-01-04 00:00:00"),   # rejected
        ("1", "0", "6.1", " 1.5 ", "2024-01-05 00:00:00"),
    ], "id string, mode_auto string, target_ph string, target_ec string, updated_at string")
    v = {r.updated_at.day: r.reason for r in K.config_validate(ups).collect()}
    assert v == {2: None, 3: "type:mode_auto", 4: "type:target_ec", 5: None}
    cur = K.current_config(K.config_update(log, ups)).collect()
    assert [(r.mode_auto, r.target_ph, r.target_ec) for r in cur] == [(False, 6.1, 1.5)]


def test_config_targets_drive_decision(spark):
    sf = "/root/testdata/sf0.001"
    cfg = spark.createDataFrame([(1, True, 6.0, 5.0, None)], K.CONFIG_SCHEMA)
    d = control_replay(spark, sf, ControlParams(), config=cfg)
    # with target_ec 5.0 nothing is an EC emergency and EC is always low -> nutrients
    st = {r.status for r in d.collect()}
    assert "DOSE_NUTRI_A" in st and "STABLE" not in st


def test_command_apply_filter(spark):
    cmds = spark.createDataFrame([
        ("SET_STATE", "light_grow", "ON", None), ("SET_STATE", "unknown", "ON", None),
        ("SET_POSITION", "stepper_louvers", None, 140), ("SET_POSITION", "light_grow", None, 10),
        ("PULSE", "pump_ph_minus", None, None)], "action string, target string, state string, position int")
    out = [(r.accepted, r.applied_state, r.applied_position) for r in K.command_apply_filter(cmds).collect()]
    assert out == [(True, "ON", None), (False, None, None), (True, None, 100), (False, None, None),
                   (False, None, None)]


def test_setpoint_fallback(spark):
    rd = spark.createDataFrame([("n1", T0 + dt.timedelta(hours=h)) for h in (1, 10, 30, 60)],
                               "device_id string, time timestamp_ntz")
    sp = spark.createDataFrame([("n1", T0, 5.8), ("n1", T0 + dt.timedelta(hours=29), 6.2)],
                               "device_id string, time timestamp_ntz, setpoint double")
    got = {r.time.hour + 24 * (r.time.day - 1): r.setpoint
           for r in K.setpoint_fallback(rd, sp, ["device_id"], default=6.0).collect()}
    assert got == {1: 5.8, 10: 5.8, 30: 6.2, 60: 6.0}
