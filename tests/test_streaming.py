"""Batch/stream equality: replay a landing directory with availableNow."""

import tempfile

from pyspark.sql import functions as F

from canopy.plans.control import ControlParams, control_replay
from canopy.sources import bindings as B
from canopy.sources import landing as L
from canopy.sources import messages as M
from canopy.streaming import ingest as I
from canopy.streaming import state as S
from canopy.streaming import windows as Wn

SF = "/root/testdata/sf0.001"


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_ingest_stream_equals_batch(spark):
    land = tempfile.mkdtemp(prefix="canopy-land-")
    out = tempfile.mkdtemp(prefix="canopy-out-")
    I.write_landing(L.messages(spark, SF).repartition(4), land, mode="overwrite")
    q = I.start_ingest(spark, I.file_messages(spark, land, max_files_per_trigger=2), out,
                       name=f"ingest-{out.rsplit('-', 1)[-1]}", available_now=True)
    q.awaitTermination(300)
    batch = M.accepted(M.parse_telemetry(M.route_by_topic(L.messages(spark, SF), M.KIND_TELEMETRY)))
    got = I.read_ingested(spark, out, "telemetry")
    cols = ["msg_id", "time", "device_id", "metric", "value"]
    assert _rows(got, cols) == _rows(batch, cols)
    dead = I.read_ingested(spark, out, "dead_letter")
    assert dead.count() > 0 and dead.filter(F.col("reason").isNull()).count() == 0


def test_hourly_trend_stream_append(spark):
    tel = B.telemetry(spark, SF)
    src = tempfile.mkdtemp(prefix="canopy-tel-")
    tel.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(tel.schema).parquet(src)
    name = "hourly_" + src.rsplit("-", 1)[-1].replace("-", "_")
    q = (Wn.hourly_trend_stream(stream.filter(F.col("metric").isin("ph", "ec")), watermark="0 seconds")
         .writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.table(name)
    # every window except the ones the final watermark has not passed yet
    assert got.count() > 0
    from canopy.functions.numeric import exact_avg
    exp = (tel.filter(F.col("metric").isin("ph", "ec"))
           .groupBy(F.date_trunc("hour", "time").alias("hour_start"), "metric")
           .agg(exact_avg(F.col("value")).alias("avg_value")))
    e = {(r.hour_start, r.metric): r.avg_value for r in exp.collect()}
    for r in got.collect():
        assert e[(r.hour_start, r.metric)] == r.avg_value


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _arrivals(spark, df, build, late_us, seed, batches=4):
    """Rows of ``build(stream)`` over ``df`` in ``batches`` micro-batches, each row up to ``late_us`` after its time."""
    src = tempfile.mkdtemp(prefix="canopy-arr-")
    rows = df.withColumn("__a", F.col("t_us") + F.pmod(F.xxhash64(*df.columns, F.lit(seed)), F.lit(late_us)))
    lo, hi = rows.agg(F.min("__a"), F.max("__a")).first()
    for k in range(batches):
        part = F.floor((F.col("__a") - lo) * batches / (hi - lo + 1))
        rows.where(part == k).drop("__a").orderBy(F.xxhash64(*df.columns, F.lit(seed + 1))).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    name = "arr_" + src.rsplit("-", 1)[-1].replace("-", "_")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        q = (build(stream).writeStream.format("memory").queryName(name).outputMode("append")
             .trigger(availableNow=True).start())
        q.awaitTermination(300)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert q.exception() is None and len([x for x in q.recentProgress if x["numInputRows"]]) >= 3
    return spark.table(name)


def test_control_state_equals_batch_replay_in_any_order(spark):
    from canopy.sources.tables import event_bounds
    lo, hi = event_bounds(spark, SF)
    p = ControlParams(per_device_lock=True, origin=lo.replace(minute=0, second=0, microsecond=0))
    tel, act = B.telemetry(spark, SF), B.actuator_logs(spark, SF)
    inputs = S.control_inputs(tel, act).coalesce(1)
    late = 3 * 3600
    cols = ["device_id", "tick", "status", "avg_ph", "avg_ec", "last_pump", "elapsed_s"]
    passed = inputs.agg(F.max("t_us")).first()[0] - late * 1_000_000
    batch = _rows(control_replay(spark, SF, p).where(F.unix_micros(F.col("tick").cast("timestamp")) <= passed), cols)
    for seed in (1, 2):
        got = _arrivals(spark, inputs, lambda s: S.control_state_stream(s, p, delay=f"{late} seconds"), late * 1_000_000, seed)
        assert _rows(got, cols) == batch and len(batch) > 1000


def test_mode_stream_equals_batch_in_any_order(spark):
    from canopy.plans import modes as P
    from canopy.streaming import modes as Mo
    sig = P.bound_signals(spark, SF).coalesce(1)
    late = 2 * 3600
    last = sig.agg(F.max("t_us")).first()[0]
    cols = ["device_id", "t_us", "mode", "previous"]
    us = F.unix_micros(F.col("time").cast("timestamp")).alias("t_us")
    batch = P.transitions(sig, last).select("device_id", us, "mode", "previous")
    closed = (F.floor(F.col("t_us") / 60_000_000) + 1) * 60_000_000
    want = [tuple(map(str, r)) for r in _rows_str(batch.where(closed <= last - late * 1_000_000), cols)]
    for seed in (1, 2):
        got = _arrivals(spark, sig, lambda s: Mo.mode_stream(s, delay=f"{late} seconds"), late * 1_000_000, seed)
        assert [tuple(map(str, r)) for r in _rows_str(got.select("device_id", us, "mode", "previous"), cols)] == want
    assert {r[2] for r in want} == {"NORMAL", "DEGRADED", "SAFETY", "MAINTENANCE"}


def _rows_str(df, cols):
    return sorted(df.select(*cols).collect(), key=str)


def test_mode_rules(spark):
    """Silence over 5 minutes, faults until acknowledged, manual maintenance, ties of one instant."""
    from canopy.plans import modes as P
    s = 1_000_000
    sig = [("a", 0, True, None), ("a", 300 * s, True, None), ("a", 601 * s, True, None),           # 300 s is no silence, 301 s is one
           ("a", 700 * s, True, "FAULT"), ("a", 800 * s, False, "ON"), ("a", 900 * s, False, "ACK"), ("a", 950 * s, True, None),
           ("a", 1000 * s, False, "OFF"), ("a", 1000 * s, False, "FAULT"), ("a", 1000 * s, False, "ACK"),
           ("b", 5 * s, False, "ON"), (None, 7 * s, True, None)]
    df = spark.createDataFrame(sig, "device_id string, t_us long, seen boolean, what string")
    got = P.transitions(df, 1500 * s).select("device_id", (F.unix_micros(F.col("time").cast("timestamp")) / s).cast("int").alias("t"), "mode").collect()
    assert [(r.t, r.mode) for r in sorted((r for r in got if r.device_id == "a"), key=lambda r: r.t)] == [
        (0, "NORMAL"), (600, "DEGRADED"), (601, "NORMAL"), (700, "SAFETY"), (900, "MAINTENANCE"), (1000, "SAFETY")]
    assert [(r.t, r.mode) for r in got if r.device_id == "b"] == [(5, "MAINTENANCE")]
    assert sorted((r.t, r.mode) for r in got if r.device_id is None) == [(7, "NORMAL"), (307, "DEGRADED")]
    bad = spark.createDataFrame([("ph", 4.0), ("ph", 4.01), ("ph", 1.0), ("water_temp", 40.0), ("ec", float("nan")), ("other", 9e9), ("ph", None)],
                                "metric string, value double")
    assert [r.b for r in bad.select(P.beyond_tolerance(F.col("metric"), F.col("value")).alias("b")).collect()] == [True, False, True, True, True, False, False]


def test_ack_join_stream_matches_batch(spark):
    src_c = tempfile.mkdtemp(prefix="canopy-cmd-")
    src_a = tempfile.mkdtemp(prefix="canopy-ack-")
    B.commands(spark, SF).write.mode("overwrite").parquet(src_c)
    B.acks(spark, SF).write.mode("overwrite").parquet(src_a)
    c = spark.readStream.schema(spark.read.parquet(src_c).schema).parquet(src_c)
    a = spark.readStream.schema(spark.read.parquet(src_a).schema).parquet(src_a)
    name = "acks_" + src_c.rsplit("-", 1)[-1].replace("-", "_")
    q = (Wn.ack_join_stream(c, a).writeStream.format("memory").queryName(name)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(300)
    from canopy.plans.commands import command_ack
    cols = ["cmd_id", "target", "cmd_time", "ack_time", "status"]
    assert _rows(spark.table(name), cols) == _rows(command_ack(spark, SF), cols)


def _ack_rows(seed, n, ids=40):
    """Commands and acks with equal keys and times, null keys, times and texts, and acks on the window's edges."""
    import random
    rnd = random.Random(seed)
    day = 86_400_000_000
    c = [(rnd.choice([None, *range(ids)]), rnd.choice([None, "pump", "pumpe ü", ""]), rnd.choice([None, rnd.randrange(100, 280) * day + rnd.randrange(3)]))
         for _ in range(n)]
    a = [(i, None if t is None else t + rnd.choice([-1, 0, 1, 30 * day, 30 * day + 1, 9 * day, 45 * day]), rnd.choice(["F", None, "DONE"]))
         for i, _, t in rnd.choices(c, k=2 * n)]
    pairs = sorted(((i, x, t, u, y) for i, x, t in c for j, u, y in a if None not in (i, j, t, u) and i == j and t <= u <= t + 30 * day), key=repr)
    return c, a, pairs


def _acks_run(spark, batches, text=False):
    """The stream join of (commands, acks) a micro-batch -> (its rows, the progress of its batches)."""
    at = lambda df: df.select(df.columns[0], *(F.timestamp_add("MICROSECOND", F.col(x), F.lit("1970-01-01").cast("timestamp_ntz")).alias("time")
                                               if x == "us" else x for x in df.columns[1:]))
    made = []
    for side, schema in zip(zip(*batches), ("cmd_id long, target string, us long", "cmd_id long, us long, status string")):
        src = tempfile.mkdtemp(prefix="canopy-acks-")
        for rows in side:
            df = at(spark.createDataFrame(rows, schema)).coalesce(1)
            (df.withColumn("cmd_id", F.concat(F.lit("k"), F.col("cmd_id").cast("string"))) if text else df).write.mode("append").parquet(src)
        made.append(spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src))
    name = "acks_" + src.rsplit("-", 1)[-1].replace("-", "_")
    q = (Wn.ack_join_stream(*made).writeStream.format("memory").queryName(name)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert q.exception() is None
    us = lambda x: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(x)).alias(x)
    got = spark.table(name).select("cmd_id", "target", us("cmd_time"), us("ack_time"), "status").collect()
    return sorted((tuple(r) for r in got), key=repr), q.recentProgress


def test_ack_join_of_odd_rows(spark):
    """Nulls, repeated keys and rows, both edges of the window, ids as text."""
    c, a, pairs = _ack_rows(1, 150)
    assert len(pairs) > 100
    assert _acks_run(spark, [(c, a)])[0] == pairs
    assert _acks_run(spark, [(c, a)], text=True)[0] == sorted(((f"k{p[0]}", *p[1:]) for p in pairs), key=repr)


def test_ack_join_keeps_blocks_in_its_state(spark):
    """The state of many rows is few entries, and none stays once the watermark has passed them."""
    day = 86_400_000_000
    c = [(i, "pump", (100 + i % 50) * day) for i in range(8000)]
    a = [(i % 8000, (100 + i % 8000 % 50) * day + i // 8000, "F") for i in range(16000)]
    c.append((-1, "pump", 400 * day))
    a.append((-1, 400 * day, "F"))
    got, progress = _acks_run(spark, [(c, a)])
    assert len(got) == 16001 and len(set(got)) == 16001
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert 0 < kept[0] < 24000 / 8
    assert kept[-1] <= 3  # the last command's blocks, in two slots, and its ack's


def test_ack_join_over_batches(spark):
    """Commands and acks of one micro-batch meet those of others in either order; late rows are dropped."""
    day = 86_400_000_000
    c = [(1, "a", 100 * day), (2, "b", 101 * day), (3, "c", 200 * day), (4, "d", 20 * day)]  # 4 comes when the watermark is past it
    a = [[(2, 102 * day, "F")], [(1, 101 * day, "F")], [(9, 200 * day, "F"), (3, 201 * day, "F")], [(4, 21 * day, "F")]]  # a file each
    on_time = [(1, "a", 100 * day, 101 * day, "F"), (2, "b", 101 * day, 102 * day, "F"), (3, "c", 200 * day, 201 * day, "F")]
    assert _acks_run(spark, [([x], y) for x, y in zip(c, a)])[0] == on_time


def test_ack_blocks_of_many_sizes(monkeypatch):
    """Blocks cut by bytes, packed twice, matched a few rows at a time: the pairs of a nested loop."""
    import numpy as np
    import pyarrow as pa
    from canopy.streaming import blocks as Bl
    rnd = np.random.default_rng(3)
    for name, value in (("PACK_ROWS", 60), ("BLOCK_BYTES", 200), ("OUT_ROWS", 20), ("MATCH_IN", 40), ("MATCH_ROWS", 5)):
        monkeypatch.setattr(Bl, name, value)
    kinds = {"id": "string", "t_us": "bigint", "value": "string"}
    sides = []
    for n in (150, 250):
        rows = [(int(b), f"k{b}{rnd.integers(5)}", int(rnd.integers(-300, 300)), rnd.choice(["", "ü" * int(rnd.integers(90)), None])) for b in rnd.integers(0, 3, n)]
        batch = lambda some: pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int32()), *(pa.array([r[i] for r in some]) for i in (1, 2, 3))],
                                                        names=["bucket", *kinds])
        small = [*Bl._packer(100, kinds, False)(batch(rows[i:i + 25]) for i in range(0, n, 25))]
        packed = pa.Table.from_batches([*Bl._packer(100, kinds, True)(iter(small))]).to_pylist()
        assert sum(len(b["t_us"]) // 8 for b in packed) == n and max(len(b["value_text"]) for b in packed) < 200 + 180
        sides.append((rows, packed))
    (le, l_packed), (r, r_packed) = sides
    met = [{**{f"l_{k}": v for k, v in x.items()}, **{f"r_{k}": v for k, v in y.items()}} for x in l_packed for y in r_packed
           if x["bucket"] == y["bucket"] and y["slot"] - x["slot"] in (0, 1)]
    one = pa.Table.from_pylist(met).combine_chunks().to_batches()[0]
    got = [tuple(x.values()) for b in Bl._matcher(100, *("string",) * 3)([one.slice(0, 7), one.slice(7)]) for x in b.to_pylist()]
    assert sorted(got, key=repr) == sorted(((i, v, t, u, w) for _, i, t, v in le for _, j, u, w in r if i == j and 0 <= u - t <= 100), key=repr)


def test_frame_pipeline_stream(spark):
    import numpy as np
    from test_vision import _png
    from canopy.functions.vision import laplacian_var_np
    from canopy.streaming.control import start_frame_pipeline
    frames = tempfile.mkdtemp(prefix="canopy-cam-")
    out = tempfile.mkdtemp(prefix="canopy-camout-")
    img = np.random.default_rng(5).integers(0, 255, (9, 11)).astype(np.uint8)
    _png(f"{frames}/cam7_1704067200.png", img)
    with open(f"{frames}/cam7_1704067201.jpg", "wb") as f:
        f.write(b"fake_jpeg_bytes_content")
    q = start_frame_pipeline(spark, frames, out, name=f"frames-{out.rsplit('-', 1)[-1]}")
    q.awaitTermination(300)
    rows = {r.image_path: r for r in spark.read.parquet(f"{out}/image_metrics").collect()}
    assert abs(rows["cam7_1704067200.png"].blur_score - laplacian_var_np(img)) < 1e-6
    assert rows["cam7_1704067201.jpg"].blur_score == 0.0


def test_frame_files_are_looked_up_by_few_tasks(spark):
    """A micro-batch of many files: no job of it has a task for each, as every task answers the driver."""
    from canopy.plans.streams import _score_files
    frames, out = tempfile.mkdtemp(prefix="canopy-cam-"), tempfile.mkdtemp(prefix="canopy-camout-")
    for i in range(150):
        with open(f"{frames}/cam{i % 3}_{1704067200 + i}.png", "wb") as f:
            f.write(b"no image")
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    q = _score_files(spark, frames, out)
    assert spark.conf.get(setting) == before
    assert spark.read.parquet(f"{out}/image_metrics").select("image_path").distinct().count() == 150
    status = spark.sparkContext.statusTracker()
    stages = [s for j in status.getJobIdsForGroup(str(q.runId)) for s in status.getJobInfo(j).stageIds]
    tasks = [x.numTasks for x in map(status.getStageInfo, stages) if x]
    assert tasks and max(tasks) <= max(32, spark.sparkContext.defaultParallelism)


def test_one_tick_evaluation_matches_replay(spark):
    from canopy.sources.tables import event_bounds
    from canopy.streaming.control import evaluate_latest_tick
    _, hi = event_bounds(spark, SF)
    p = ControlParams()
    one = evaluate_latest_tick(spark, B.telemetry(spark, SF), B.actuator_logs(spark, SF), p, hi)
    full = control_replay(spark, SF, p)
    last = full.agg(F.max("tick")).first()[0]
    cols = ["device_id", "tick", "status", "avg_ph", "avg_ec", "last_pump", "elapsed_s"]
    assert _rows(one, cols) == _rows(full.filter(F.col("tick") == last), cols)


def test_one_tick_evaluation_registry_and_host_zone(spark, monkeypatch):
    import datetime as dt
    import time
    from canopy.streaming.control import evaluate_latest_tick
    monkeypatch.setenv("TZ", "Asia/Kolkata")
    time.tzset()
    try:
        now = dt.datetime(2024, 1, 1, 10, 12, 5)
        registry = spark.createDataFrame([("silent",)], "device_id string")
        one = evaluate_latest_tick(spark, B.telemetry(spark, SF), B.actuator_logs(spark, SF),
                                   ControlParams(tick_s=3600), now, devices=registry)
        rows = one.select("device_id", F.col("tick").cast("string").alias("tick"), "status").collect()
    finally:
        monkeypatch.undo()
        time.tzset()
    assert [(r.device_id, r.tick) for r in rows] == [("silent", "2024-01-01 10:00:00")]
    assert rows[0].status == "NO_DATA"


def _stream_of(spark, df, prefix):
    src = tempfile.mkdtemp(prefix=prefix)
    df.write.mode("overwrite").parquet(src)
    return spark.readStream.schema(spark.read.parquet(src).schema).parquet(src), src


def test_late_replay_dedup_stream(spark):
    tel = B.telemetry(spark, SF).select("device_id", "metric", "time", "value")
    dup = tel.unionByName(tel.filter(F.col("metric") == "ph"))  # a node re-sends its cached ph readings
    stream, src = _stream_of(spark, dup, "canopy-late-")
    name = "late_" + src.rsplit("-", 1)[-1].replace("-", "_")
    q = (Wn.late_replay_dedup(stream).writeStream.format("memory").queryName(name)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert spark.table(name).count() == tel.dropDuplicates(["device_id", "metric", "time"]).count()


def test_heartbeat_timeout_stream(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [("quiet", t0 + dt.timedelta(seconds=s)) for s in (0, 60, 120)] + \
           [("busy", t0 + dt.timedelta(seconds=s)) for s in range(0, 3600, 60)]
    df = spark.createDataFrame(rows, "device_id string, time timestamp_ntz")
    stream, src = _stream_of(spark, df, "canopy-hb-")
    name = "hb_" + src.rsplit("-", 1)[-1].replace("-", "_")
    q = (S.heartbeat_timeout_stream(stream, gap_s=300, delay="0 seconds").writeStream.format("memory")
         .queryName(name).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(300)
    alerts = {r.device_id for r in spark.table(name).collect()}
    assert alerts == {"quiet"}


def test_periodic_control_over_stored_tables(spark):
    import datetime as dt
    import time as _time
    from canopy.sources.sinks import with_chunk
    from canopy.sources.tables import event_bounds
    from canopy.streaming.control import start_periodic_control
    tables = tempfile.mkdtemp(prefix="canopy-tables-")
    out = tempfile.mkdtemp(prefix="canopy-dec-")
    with_chunk(B.telemetry(spark, SF)).write.partitionBy("chunk_start").parquet(f"{tables}/telemetry")
    B.actuator_logs(spark, SF).write.parquet(f"{tables}/actuator_logs")
    _, hi = event_bounds(spark, SF)
    p = ControlParams(tick_s=1)  # 1 s trigger so the test sees a batch quickly
    p.lookback_s, p.mixing_delay_s = 86400, 600.0
    q = start_periodic_control(spark, tables, out, p, now_fn=lambda: hi,
                               name=f"periodic-{out.rsplit('-', 1)[-1]}")
    try:
        deadline = _time.time() + 120
        while _time.time() < deadline and not q.recentProgress:
            _time.sleep(1)
        _time.sleep(3)
    finally:
        q.stop()
    got = spark.read.parquet(f"{out}/decisions")
    assert got.select("device_id").distinct().count() == 8
    assert got.select("tick").distinct().count() >= 1
    doses = got.where("command_target is not null").select("device_id", "tick").distinct()
    sent = spark.read.parquet(f"{out}/commands").select("device_id", "tick", "payload").distinct().collect()
    assert {(r.device_id, r.tick) for r in sent} == {(r.device_id, r.tick) for r in doses.collect()}
    assert all('"action":"PULSE"' in r.payload for r in sent)
