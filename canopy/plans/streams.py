"""Stream operators as registered queries.

Each query snapshots data derived from the bound tables into the shared
folder (``spark.checkpoint.dir``), runs the Structured Streaming operator over
it with ``trigger(availableNow=True)`` into an exactly-once file sink, and
returns the sink's table.  The oracle SQL is the batch result the stream
must reproduce.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from contextlib import contextmanager

import numpy as np
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from canopy.functions.numeric import sql_avg
from canopy.operators.sequence import epoch_us
from canopy.plans.control import ControlParams, control_replay_sql
from canopy.plans.registry import REGISTRY, register
from canopy.session import CLUSTER_CONF, shared_dir
from canopy.sources import bindings as B
from canopy.sources import landing as L
from canopy.sources.tables import event_bounds
from canopy.plans import modes as P
from canopy.plans.images import BLUR_CTE, WIDTH
from canopy.streaming import blocks
from canopy.streaming import ingest as I
from canopy.streaming import modes as Mo
from canopy.streaming import state as S
from canopy.streaming import windows as Wn
from canopy.streaming.control import start_frame_pipeline

# the batch queries these streams must reproduce (registered by earlier modules)
import canopy.plans.commands  # noqa: F401,E402
import canopy.plans.messages  # noqa: F401,E402


ROCKSDB = CLUSTER_CONF["spark.sql.streaming.stateStore.providerClass"]


def _workdir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex[:12]}"


def _snapshot(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` once and read it back as a file stream."""
    df.write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


ARRIVALS = 4          # micro-batches of a query over out-of-order arrivals
LATENESS_S = 6 * 3600  # rows arrive up to so much later than their time


def _arriving(spark: SparkSession, df: DataFrame, t_us: Column, row_id: Column, path: str) -> DataFrame:
    """``df`` as a file stream of ``ARRIVALS`` micro-batches, rows out of order by up to ``LATENESS_S``.

    A row's delay comes from a hash of its id; rows are cut by arrival time
    into equal spans, written one after the other and read a file at a time.
    """
    arrival = t_us + F.pmod(F.xxhash64(row_id), F.lit(LATENESS_S * 1_000_000))
    lo, hi = df.select(arrival.alias("a")).agg(F.min("a"), F.max("a")).first()
    step = ((hi or 0) - (lo or 0)) // ARRIVALS + 1
    part = F.floor((arrival - F.lit(lo or 0)) / F.lit(step))
    for k in range(ARRIVALS):
        df.where(part == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _state_partitions(spark: SparkSession) -> int | None:
    try:
        return max(1, int(spark.sparkContext.defaultParallelism))
    except Exception:  # no SparkContext (remote session): keep the session setting
        return None


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """The session with ``values`` set; its own are restored at the end."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _run(spark: SparkSession, stream: DataFrame, work: str, start: dict[str, str] | None = None) -> DataFrame:
    """Run to completion into a parquet file sink (exactly-once); return its table.

    A fresh checkpoint fixes the number of state partitions and the state store
    at start: the cluster's default parallelism and RocksDB (which timers need)
    are set for the start, with the settings ``start``; then the session's values are restored.
    """
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB} | (start or {})
    if n := _state_partitions(spark):
        settings["spark.sql.shuffle.partitions"] = str(n)
    with _settings(spark, settings):
        q = (stream.writeStream.format("parquet").option("path", f"{work}/out")
             .option("checkpointLocation", f"{work}/checkpoint").outputMode("append")
             .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.schema(stream.schema).parquet(f"{work}/out")


def _ingested(spark: SparkSession, sf_dir: str, compacted: str | None = None) -> str:
    """Folder of the tables that the ingest makes of the bound messages, in several micro-batches."""
    work = _workdir(spark, "ingest")
    I.write_landing(L.messages(spark, sf_dir).repartition(4), f"{work}/landing", mode="overwrite")
    q = I.start_ingest(spark, I.file_messages(spark, f"{work}/landing", max_files_per_trigger=2), f"{work}/tables",
                       name=f"ingest-{work.rsplit('-', 1)[-1]}", available_now=True)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    if compacted:
        I.compact_ingested(spark, f"{work}/tables", compacted)
    return f"{work}/tables"


@register("stream_ingest", REGISTRY["parse_telemetry"].sql, kind="stream")
def stream_ingest(spark, sf_dir):
    """Continuous ingest: landing files -> foreachBatch -> telemetry table (stream = batch parse)."""
    return I.read_ingested(spark, _ingested(spark, sf_dir), "telemetry").select("msg_id", "time", "device_id", "metric", "value")


@register("stream_ingest_weather", REGISTRY["parse_weather"].sql, kind="stream")
def stream_ingest_weather(spark, sf_dir):
    """Continuous ingest: the weather table, read back after its batches were compacted."""
    return I.read_ingested(spark, _ingested(spark, sf_dir, "weather_metrics"), "weather_metrics").select(
        "msg_id", "time", "sensor_name", "temperature", "windspeed", "weathercode")


@register("stream_ingest_actuator", REGISTRY["parse_actuator"].sql, kind="stream")
def stream_ingest_actuator(spark, sf_dir):
    """Continuous ingest: the actuator log, read back after its batches were compacted."""
    return I.read_ingested(spark, _ingested(spark, sf_dir, "actuator_logs"), "actuator_logs").select(
        "msg_id", "time", "actuator_id", "action", "duration_ms", "trigger_source")


@register("stream_ingest_status", REGISTRY["status_relays"].sql, kind="stream")
def stream_ingest_status(spark, sf_dir):
    """Continuous ingest: status pings, one row per relay."""
    s = I.read_ingested(spark, _ingested(spark, sf_dir), "node_status")
    return s.select("msg_id", "device_id", "mode", F.explode("relays").alias("relay", "state"))


@register("stream_ack_join", REGISTRY["command_ack"].sql, kind="stream")
def stream_ack_join(spark, sf_dir):
    """Stream-stream join of commands and acks with watermarks (stream = batch join)."""
    work = _workdir(spark, "acks")
    c = _snapshot(spark, B.commands(spark, sf_dir), f"{work}/commands")
    a = _snapshot(spark, B.acks(spark, sf_dir), f"{work}/acks")
    return _run(spark, Wn.ack_join_stream(c, a), work, blocks.SETTINGS)


@register("stream_late_replay", B.with_views("telemetry") + """
SELECT DISTINCT device_id, metric, time, value FROM telemetry""", kind="stream")
def stream_late_replay(spark, sf_dir):
    """Nodes re-send their cached ph readings; the stream keeps one copy (watermark dedup)."""
    work = _workdir(spark, "late")
    tel = B.telemetry(spark, sf_dir).select("device_id", "metric", "time", "value")
    resent = tel.unionByName(tel.filter(F.col("metric") == "ph"))
    dedup = Wn.late_replay_dedup(_snapshot(spark, resent, f"{work}/src"))
    return _run(spark, dedup.withColumn("time", Wn.to_ntz(F.col("time"))), work)


_STATE_P = ControlParams(per_device_lock=True)


def _state_sql() -> str:
    # ticks that the final watermark has passed, of devices with a slot (an hour) closed by then
    mx = B.with_views("telemetry", "actuator_logs") + f""",
x AS (SELECT device_id, time FROM telemetry WHERE metric IN ('ph', 'ec')
      UNION ALL SELECT device_id, time FROM actuator_logs WHERE action = 'COMPLETED')
SELECT device_id, (SELECT max(time) FROM x) - INTERVAL {LATENESS_S} SECOND AS passed
FROM x GROUP BY device_id
HAVING date_trunc('hour', min(time) - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR <= passed"""
    return ("WITH r AS (\n" + control_replay_sql(_STATE_P) + "\n),\nmx AS (\n" + mx + "\n)\n"
            "SELECT r.* FROM r JOIN mx ON r.device_id = mx.device_id WHERE r.tick <= mx.passed")


@register("stream_control_state", _state_sql(), kind="stream")
def stream_control_state(spark, sf_dir):
    """Keyed live control by timers: every tick that the watermark has passed, rows arriving out of order."""
    lo, _ = event_bounds(spark, sf_dir)
    p = ControlParams(per_device_lock=True, origin=lo.replace(minute=0, second=0, microsecond=0))
    work = _workdir(spark, "control")
    inputs = S.control_inputs(B.telemetry(spark, sf_dir), B.actuator_logs(spark, sf_dir))
    stream = _arriving(spark, inputs, F.col("t_us"), F.struct("t_us", "kind", "value"), f"{work}/src")
    return _run(spark, S.control_state_stream(stream, p, delay=f"{LATENESS_S} seconds"), work)


@register("stream_mode_machine", P.TRANSITIONS_CTE + f"""
SELECT device_id, time, mode, previous FROM changes
WHERE date_trunc('minute', time) + INTERVAL 1 MINUTE <= (SELECT max(time) FROM sig WHERE seen OR what IS NOT NULL) - INTERVAL {LATENESS_S} SECOND""",
          kind="stream")
def stream_mode_machine(spark, sf_dir):
    """Changes of operating mode by a state machine with timers, signals arriving out of order."""
    work = _workdir(spark, "modes")
    sig = P.bound_signals(spark, sf_dir)
    stream = _arriving(spark, sig, F.col("t_us"), F.struct("t_us", "what"), f"{work}/src")
    return _run(spark, Mo.mode_stream(stream, delay=f"{LATENESS_S} seconds"), work)


def _late_telemetry(spark: SparkSession, tel: DataFrame, work: str) -> DataFrame:
    """Readings as a stream of arrivals up to ``LATENESS_S`` late."""
    rows = tel.select("device_id", "metric", "time", "value")
    return _arriving(spark, rows, epoch_us("time"), F.struct("device_id", "metric", "time", "value"), f"{work}/src")


@register("stream_hourly_trend", B.with_views("telemetry") + f"""
, t AS (SELECT * FROM telemetry WHERE metric IN ('ph', 'ec'))
SELECT date_trunc('hour', time) AS hour_start, metric, {sql_avg('value')} AS avg_value
FROM t GROUP BY date_trunc('hour', time), metric
HAVING date_trunc('hour', time) + INTERVAL 1 HOUR <= (SELECT max(time) FROM t) - INTERVAL {LATENESS_S} SECOND""", kind="stream")
def stream_hourly_trend(spark, sf_dir):
    """Tumbling hourly means of readings that come late: every hour the watermark has closed (append mode)."""
    work = _workdir(spark, "hourly")
    tel = B.telemetry(spark, sf_dir).filter(F.col("metric").isin("ph", "ec"))
    return _run(spark, Wn.hourly_trend_stream(_late_telemetry(spark, tel, work), watermark=f"{LATENESS_S} seconds"), work)


HEARTBEAT_GAP_S = 300  # silence longer than 5 minutes raises an alert


@register("stream_heartbeat", B.with_views("telemetry") + f"""
, last AS (SELECT device_id, max(time) AS last_seen FROM telemetry GROUP BY device_id),
wm AS (SELECT epoch_ms(max(time)) AS wm_ms FROM telemetry)
SELECT device_id, last_seen, (wm_ms * 1000 - epoch_us(last_seen)) / 1e6 AS silent_s
FROM last, wm WHERE wm_ms > epoch_us(last_seen) // 1000 + {HEARTBEAT_GAP_S * 1000}""", kind="stream")
def stream_heartbeat(spark, sf_dir):
    """Devices silent longer than the heartbeat limit when the stream's watermark passes them."""
    work = _workdir(spark, "heartbeat")
    tel = B.telemetry(spark, sf_dir).select("device_id", "time")
    return _run(spark, S.heartbeat_timeout_stream(_snapshot(spark, tel, f"{work}/src"), gap_s=HEARTBEAT_GAP_S,
                                                  delay="0 seconds"), work)


@register("stream_minute_downsample", B.with_views("telemetry") + f"""
SELECT device_id, metric, date_trunc('minute', time) AS minute, {sql_avg('value')} AS avg_value, count(*) AS n
FROM telemetry GROUP BY device_id, metric, date_trunc('minute', time)
HAVING date_trunc('minute', time) + INTERVAL 1 MINUTE <= (SELECT max(time) FROM telemetry) - INTERVAL {LATENESS_S} SECOND""", kind="stream")
def stream_minute_downsample(spark, sf_dir):
    """One point per minute per device and metric, emitted as the watermark closes each minute; readings come late."""
    work = _workdir(spark, "minute")
    late = _late_telemetry(spark, B.telemetry(spark, sf_dir), work)
    return _run(spark, Wn.minute_downsample_stream(late, watermark=f"{LATENESS_S} seconds"), work)


GREY_STEP = 40         # grey levels per unit of an embedding's value
CORRUPT_EVERY = 50     # every 50th frame file is no image

_GREY_SQL = f"""
, image_frames AS (
  SELECT vec_id, sensor_name, ts_epoch, replace(image_path, '.jpg', '.png') AS image_path,
         [least(255e0, greatest(0e0, floor(128e0 + {GREY_STEP}e0 * CAST(x AS DOUBLE) + 5e-1))) FOR x IN embedding] AS embedding
  FROM frames)"""


def _frame_files(frames: DataFrame, path: str) -> None:
    """Write ``frames`` as 8-bit grey PNG files named by their keys, each task its own rows."""
    def write(rows):
        fs, root = pa_fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        fs.create_dir(root)
        for r in rows:
            grey = np.clip(np.floor(128.0 + GREY_STEP * np.asarray(r.embedding, dtype=np.float64) + 0.5), 0, 255).astype(np.uint8).reshape(-1, WIDTH)

            def chunk(tag, data):
                return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
            png = (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(grey), 8, 0, 0, 0, 0))
                   + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + line.tobytes() for line in grey))) + chunk(b"IEND", b""))
            with fs.open_output_stream(f"{root}/{r.image_path.replace('.jpg', '.png')}") as f:
                f.write(b"no image" if r.vec_id % CORRUPT_EVERY == 0 else png)

    frames.select("vec_id", "image_path", "embedding").foreachPartition(write)


def _score_files(spark: SparkSession, files: str, tables: str) -> StreamingQuery:
    """The frame pipeline over all files there are, run to its end.

    Spark looks up every micro-batch's files by a job of its own, by default
    with a task a file, and each task's answer to the driver is some 2.8 KB
    besides the file's status: here that job has as many tasks as run at once.
    """
    with _settings(spark, {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(_state_partitions(spark) or 32)}):
        q = start_frame_pipeline(spark, files, tables, name=f"frames-{uuid.uuid4().hex[:12]}")
        q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return q


@register("stream_image_metrics", "WITH frames AS (\n" + B.VIEW_SQL["image_frames"] + ")" + _GREY_SQL + BLUR_CTE.replace("round(var_pop(lap), 6)", """
  CASE WHEN vec_id % 50 = 0 THEN 0e0 ELSE round(var_pop(lap), 6) END""") + "SELECT sensor_name, timestamp, image_path, blur_score FROM image_metrics",
          kind="stream")
def stream_image_metrics(spark, sf_dir):
    """Frame files decoded and scored in a stream, read back from the image_metrics table."""
    work = _workdir(spark, "frames")
    _frame_files(B.image_frames(spark, sf_dir), f"{work}/files")
    _score_files(spark, f"{work}/files", f"{work}/tables")
    return spark.read.parquet(f"{work}/tables/image_metrics").select(
        "sensor_name", "timestamp", "image_path", F.round("blur_score", 6).alias("blur_score"))
