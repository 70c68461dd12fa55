"""Periodic control over stored tables, and the camera frame pipeline.

``start_periodic_control`` is the scheduler of the original loop as a stream:
a ``rate`` source is the clock, and every micro-batch evaluates the decision
for the newest tick of the stored telemetry and actuator tables (set-based,
all devices at once) and appends the decisions and the command messages that
follow from them, replay-safe per batch id.

``start_frame_pipeline`` streams new frame files through Spark's ``image``
source, which decodes on the executors, scores blur and appends
``image_metrics`` rows; no file name passes the driver's Python.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from canopy.plans.control import ControlParams, control_replay
from canopy.plans.control_queries import command_messages
from canopy.plans.images import decoded_metrics
from canopy.session import shared_dir
from canopy.sources.images import stream_frames
from canopy.sources.sinks import append_idempotent, time_range_filter


def evaluate_latest_tick(spark: SparkSession, telemetry: DataFrame, actions: DataFrame,
                         p: ControlParams, now: _dt.datetime, sf_dir: str | None = None,
                         devices: DataFrame | None = None) -> DataFrame:
    """Decisions for every device at the newest tick <= ``now`` (one-tick replay).

    ``now`` is naive UTC.  With a registry of ``devices``, those without a reading get a row as well.
    """
    seconds = int(now.replace(tzinfo=_dt.timezone.utc).timestamp())
    tick = now.replace(microsecond=0) - _dt.timedelta(seconds=seconds % p.tick_s)
    one = ControlParams(**{**p.__dict__, "origin": tick, "end": tick})
    return control_replay(spark, sf_dir or "", one, telemetry=telemetry, actions=actions, devices=devices)


def start_periodic_control(spark: SparkSession, tables_dir: str, out_dir: str, p: ControlParams,
                           now_fn=None, name: str = "periodic_control",
                           available_now_batches: int | None = None,
                           devices: DataFrame | None = None) -> StreamingQuery:
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def run(batch: DataFrame, batch_id: int) -> None:
        now = (now_fn or (lambda: _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)))()
        # only the chunks the lookback touches are read (time + chunk_start predicates)
        tel = time_range_filter(spark.read.parquet(f"{tables_dir}/telemetry"),
                                now - _dt.timedelta(seconds=p.lookback_s + p.tick_s),
                                now + _dt.timedelta(seconds=1))
        act = spark.read.parquet(f"{tables_dir}/actuator_logs")
        d = evaluate_latest_tick(spark, tel, act, p, now, devices=devices).persist()  # a row a device
        try:
            append_idempotent(d, f"{out_dir}/decisions", batch_id, partition_cols=())
            append_idempotent(command_messages(d), f"{out_dir}/commands", batch_id, partition_cols=())
        finally:
            d.unpersist()

    return (clock.writeStream.queryName(name)
            .option("checkpointLocation", f"{shared_dir(spark)}/{name}")
            .trigger(processingTime=f"{max(1, int(p.tick_s))} seconds")
            .foreachBatch(run).start())


def start_frame_pipeline(spark: SparkSession, frames_dir: str, out_dir: str,
                         name: str = "frames", available_now: bool = True,
                         max_files_per_trigger: int = 1000) -> StreamingQuery:
    """Score new frame files and append them to the ``image_metrics`` table, replay-safe per batch id."""
    rows = decoded_metrics(stream_frames(spark, frames_dir, max_files_per_trigger))

    def run(batch: DataFrame, batch_id: int) -> None:
        append_idempotent(batch, f"{out_dir}/image_metrics", batch_id, partition_cols=())

    w = (rows.writeStream.queryName(name)
         .option("checkpointLocation", f"{shared_dir(spark)}/{name}").foreachBatch(run))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
