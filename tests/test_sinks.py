"""Chunk-partitioned tables, partition pruning, command normalisation."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from canopy.functions.commands import normalize_commands
from canopy.sources import bindings as B
from canopy.sources.sinks import append_idempotent, time_range_filter, with_chunk


def test_chunks_are_epoch_aligned_weeks(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 3, 12),), (dt.datetime(2024, 1, 4, 0),)],
                               "time timestamp_ntz")
    got = [r.chunk_start for r in with_chunk(df).collect()]
    assert got == [dt.datetime(2023, 12, 28), dt.datetime(2024, 1, 4)]


def test_replayed_batch_replaces_itself_and_pruning(spark):
    out = tempfile.mkdtemp(prefix="canopy-sink-")
    tel = with_chunk(B.telemetry(spark, "/root/testdata/sf0.001"))
    append_idempotent(tel, out, batch_id=7)
    append_idempotent(tel, out, batch_id=7)  # the same batch again (a retry)
    t = spark.read.parquet(out)
    assert t.count() == tel.count()
    q = time_range_filter(t, dt.datetime(2024, 1, 20), dt.datetime(2024, 1, 22))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chunk_start" in plan
    exp = tel.filter((F.col("time") >= dt.datetime(2024, 1, 20)) & (F.col("time") < dt.datetime(2024, 1, 22)))
    assert q.count() == exp.count()


def test_normalize_commands(spark):
    c = spark.createDataFrame([("PULSE", "pump_nutri_b", 2000), ("PULSE", "EMERGENCY_STOP", 0),
                               ("PULSE", "pump_ph_minus", 1000)], "action string, target string, duration_ms int")
    assert [(r.action, r.target) for r in normalize_commands(c).collect()] == [
        ("PULSE", "pump_nutri_2"), ("ESTOP", "EMERGENCY_STOP"), ("PULSE", "pump_ph_minus")]


def test_commit_log_replay_and_compaction(spark):
    from canopy.sources.sinks import append_committed, compact, live_folders, read_committed
    table = tempfile.mkdtemp(prefix="canopy-log-")
    tel = with_chunk(B.telemetry(spark, "/root/testdata/sf0.001")).cache()

    def rows():
        return sorted(read_committed(spark, table, tel.schema).select("event_id", "metric").collect())
    want = sorted(tel.select("event_id", "metric").collect())
    assert rows() == []
    for batch in range(3):
        append_committed(tel.where(F.col("event_id") % 3 == batch), table, batch)
    append_committed(tel.where(F.col("event_id") % 3 == 1), table, 1)  # batch 1 again: takes the first try's place
    assert rows() == want and len(live_folders(spark, table)) == 3
    compact(spark, table, tel.schema)
    assert rows() == want and len(live_folders(spark, table)) == 1
    append_committed(tel.where(F.col("event_id") % 3 == 2), table, 2)  # a late replay of a compacted batch
    append_committed(tel.where("false"), table, 3)                     # an empty batch
    assert rows() == want
    compact(spark, table, tel.schema)
    assert rows() == want and len(live_folders(spark, table)) == 1


def test_every_message_in_one_table(spark):
    from canopy.sources import landing as L, messages as M
    from canopy.streaming import ingest as I
    out = tempfile.mkdtemp(prefix="canopy-all-")
    msgs = L.messages(spark, "/root/testdata/sf0.001")
    odd = spark.createDataFrame([(-1, "no/such/topic/x", "{}", dt.datetime(2024, 1, 1)), (-2, "site/n1/status", "[1]", dt.datetime(2024, 1, 1)),
                                 (-3, "site/n1/status", "{}", dt.datetime(2024, 1, 1))], msgs.schema)
    every = msgs.unionByName(odd)
    I.write_batch(every, 0, out)
    ids = [r.msg_id for t in ("telemetry", "weather_metrics", "actuator_logs", "node_status", "dead_letter")
           for r in I.read_ingested(spark, out, t).select("msg_id").collect()]
    assert sorted(ids) == sorted(r.msg_id for r in every.select("msg_id").collect())
    dead = {r.msg_id: r.reason for r in I.read_ingested(spark, out, "dead_letter").where("msg_id < 0").collect()}
    assert dead == {-1: "unknown_topic", -2: "malformed", -3: "null:device_id"}
