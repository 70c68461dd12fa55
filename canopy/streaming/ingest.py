"""Continuous ingest: message stream -> typed tables + dead letters, replay-safe.

Source: JSON-lines landing files (``readStream.json``) or Kafka
(``readStream.format("kafka")``, needs the Kafka connector on the classpath).
Each micro-batch is parsed once (persisted), then split into the telemetry,
weather, actuator and status tables and a dead-letter table, which also takes
messages of unknown topics.  Every write is a folder named in the table's
commit log, so a replayed batch after an executor or driver loss takes its own
place, and compaction doesn't change what readers see; the checkpoint lives in
the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from canopy.session import shared_dir
from canopy.sources import messages as M
from canopy.sources.sinks import append_committed, compact, read_committed, with_chunk

MSG_SCHEMA = "msg_id long, topic string, payload string, ingest_ts timestamp_ntz"
# Landing files keep microseconds (the JSON default writes milliseconds).
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_landing(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write messages as JSON lines in the landing layout ``file_messages`` reads."""
    df.write.mode(mode).option("timestampNTZFormat", TS_FORMAT).json(path)


HANDLERS = [(M.KIND_TELEMETRY, M.parse_telemetry, "telemetry"),
            (M.KIND_WEATHER, M.parse_weather, "weather_metrics"),
            (M.KIND_ACTUATOR, M.parse_actuator, "actuator_logs"),
            (M.KIND_STATUS, M.check_status, "node_status")]


def file_messages(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(MSG_SCHEMA).option("timestampNTZFormat", TS_FORMAT)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path)


def kafka_messages(spark: SparkSession, bootstrap: str, topics: list[str] | None = None,
                   pattern: str | None = None, max_offsets_per_trigger: int | None = None) -> DataFrame:
    """Kafka records as messages; ``pattern`` is a ``subscribePattern`` (node wildcard topics)."""
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap)
    r = r.option("subscribePattern", pattern) if pattern else r.option("subscribe", ",".join(topics or []))
    if max_offsets_per_trigger:
        r = r.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    k = r.load()
    msg_id = F.xxhash64(F.col("topic"), F.col("partition"), F.col("offset"))
    return k.select(msg_id.alias("msg_id"), "topic", F.col("value").cast("string").alias("payload"),
                    F.col("timestamp").cast("timestamp_ntz").alias("ingest_ts"))


def write_batch(batch: DataFrame, batch_id: int, out_dir: str) -> None:
    """Body of ``foreachBatch``: parse every message once, write each to exactly one table."""
    batch = batch.persist()
    kept = [batch]
    try:
        kind = M.topic_kind(F.col("topic"))
        rejects = batch.where(kind.isNull()).select("msg_id", "topic", F.lit("unknown_topic").alias("reason"))
        for name, parse, table in HANDLERS:
            parsed = parse(M.route_by_topic(batch, name)).persist()
            kept.append(parsed)  # rows and rejects of one parse: kept until both are written
            append_committed(with_chunk(M.accepted(parsed)), f"{out_dir}/{table}", batch_id)
            rejects = rejects.unionByName(M.rejected(parsed))
        append_committed(rejects, f"{out_dir}/dead_letter", batch_id, partition_cols=())
    finally:
        for df in reversed(kept):
            df.unpersist()


def start_ingest(spark: SparkSession, source: DataFrame, out_dir: str, name: str = "ingest",
                 available_now: bool = False, processing_time: str | None = None) -> StreamingQuery:
    ckpt = f"{shared_dir(spark)}/{name}"
    w = (source.writeStream.queryName(name).option("checkpointLocation", ckpt)
         .foreachBatch(lambda df, bid: write_batch(df, bid, out_dir)))
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def table_schema(spark: SparkSession, table: str) -> StructType:
    """Columns of an ingested table, from its parser."""
    none = spark.createDataFrame([], MSG_SCHEMA)
    if table == "dead_letter":
        return none.select("msg_id", "topic", F.lit("").alias("reason")).schema
    parse = next(p for _, p, t in HANDLERS if t == table)
    return with_chunk(M.accepted(parse(none))).schema


def read_ingested(spark: SparkSession, out_dir: str, table: str) -> DataFrame:
    """An ingested table as of its newest commit."""
    return read_committed(spark, f"{out_dir}/{table}", table_schema(spark, table))


def compact_ingested(spark: SparkSession, out_dir: str, table: str) -> None:
    """Merge the folders of a table's batches."""
    compact(spark, f"{out_dir}/{table}", table_schema(spark, table), () if table == "dead_letter" else ("chunk_start",))
