"""Results do not depend on the session time zone (all time arithmetic is TIMESTAMP_NTZ)."""

import pytest

from canopy.plans import load_all

QUERIES = ["control_replay", "mixing_lock", "hourly_trend", "minute_downsample", "telemetry_wide",
           "frames_by_day", "trailing_avg", "last_action_asof", "mode_machine", "history_label"]


@pytest.mark.parametrize("name", QUERIES)
def test_same_result_in_any_session_zone(spark, name):
    q = load_all()[name]
    sf = "/root/testdata/sf0.001"
    base = sorted(map(tuple, q.build(spark, sf).collect()), key=repr)
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")  # +05:30, no DST
        other = sorted(map(tuple, q.build(spark, sf).collect()), key=repr)
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # DST in the data's range
        third = sorted(map(tuple, q.build(spark, sf).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert base == other == third
