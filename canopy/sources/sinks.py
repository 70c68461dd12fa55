"""Table sinks: partitioned parquet appends that are safe to replay."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from canopy import constants as C


def chunk_start(time: Column) -> Column:
    """Start of the epoch-aligned 7-day chunk a time falls in (the original's hypertable chunk)."""
    from canopy.operators.sequence import epoch_us, from_epoch_us
    width = C.CHUNK_DAYS * 86400 * 1_000_000
    return from_epoch_us(F.floor(epoch_us(time) / F.lit(width)).cast("long") * F.lit(width))


def with_chunk(df: DataFrame, time_col: str = "time") -> DataFrame:
    return df.withColumn("chunk_start", chunk_start(F.col(time_col)))


def time_range_filter(df: DataFrame, lo, hi=None, time_col: str = "time") -> DataFrame:
    """``lo <= time [< hi]`` plus the matching ``chunk_start`` bounds, so partition pruning
    happens on chunk-partitioned tables (a ``time`` predicate alone does not prune them)."""
    from canopy.sources.tables import ntz
    lo_c = ntz(lo)
    cond = (F.col(time_col) >= lo_c) & (F.col("chunk_start") > lo_c - F.expr(f"INTERVAL {C.CHUNK_DAYS} DAYS"))
    if hi is not None:
        cond = cond & (F.col(time_col) < ntz(hi)) & (F.col("chunk_start") < ntz(hi))
    return df.filter(cond)


def append_idempotent(df: DataFrame, path: str, batch_id: int, partition_cols: tuple[str, ...] = ("chunk_start",)) -> None:
    """Write one micro-batch so that a replay of the same batch replaces, not duplicates.

    Rows carry ``batch_id`` as the innermost partition; dynamic partition
    overwrite rewrites exactly the partitions of this batch.
    """
    (df.withColumn("batch_id", F.lit(int(batch_id)))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partition_cols, "batch_id").parquet(path))


# --- tables with a commit log ---------------------------------------------------------------------------
#
# A batch is written to a folder of its own and becomes visible when its commit
# is in the log; readers resolve the live folders from the log.  Of several
# commits of one batch (replays) the last holds.  Compaction writes the live
# rows anew and commits one folder that covers all batches it has read, so a
# late replay of one of them changes nothing either.

COMMIT_SCHEMA = "version long, batch_id long, folder string, covers array<long>"


def _commits(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.schema(COMMIT_SCHEMA).parquet(f"{table}/commits")


def _log(spark: SparkSession, table: str) -> list:
    """The log's rows in order of version: one a batch or compaction, so as many as micro-batches since the table began."""
    try:
        return sorted(_commits(spark, table).collect(), key=lambda r: r.version)
    except AnalysisException:  # no commit yet
        return []


def _add_commit(spark: SparkSession, table: str, batch_id: int | None, folder: str, covers: list[int]) -> None:
    version = max((r.version for r in _log(spark, table)), default=0) + 1
    spark.createDataFrame([(version, batch_id, folder, covers)], COMMIT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{table}/commits")


def live_folders(spark: SparkSession, table: str) -> list[str]:
    """Folders that hold the table's rows now."""
    log = _log(spark, table)
    merged = [r for r in log if r.batch_id is None][-1:]   # a compaction covers the earlier ones
    covered = set(merged[0].covers) if merged else set()
    by_batch = {r.batch_id: r.folder for r in log if r.batch_id is not None and r.batch_id not in covered}
    return [r.folder for r in merged] + list(by_batch.values())


def append_committed(df: DataFrame, table: str, batch_id: int, partition_cols: tuple[str, ...] = ("chunk_start",)) -> None:
    """Append one micro-batch; a replay of it takes the place of the first try."""
    folder = f"batch-{int(batch_id)}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_cols).parquet(f"{table}/data/folder={folder}")
    _add_commit(df.sparkSession, table, int(batch_id), folder, [])


def read_committed(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """The table's rows as of the newest commit."""
    folders = [f"{table}/data/folder={f}" for f in live_folders(spark, table)]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", f"{table}/data").schema(schema).parquet(*folders).select(*schema.names)


def compact(spark: SparkSession, table: str, schema: StructType, partition_cols: tuple[str, ...] = ("chunk_start",)) -> None:
    """Write the live rows anew, in files of even size, as one folder; earlier folders stay for readers that resolved them."""
    log = _log(spark, table)
    covers = sorted({r.batch_id for r in log if r.batch_id is not None} | {b for r in log for b in r.covers})
    if len(live_folders(spark, table)) < 2:
        return
    folder = f"compact-{uuid.uuid4().hex}"
    rows = read_committed(spark, table, schema).hint("rebalance", *partition_cols)
    rows.write.partitionBy(*partition_cols).parquet(f"{table}/data/folder={folder}")
    _add_commit(spark, table, None, folder, covers)


def to_topic_records(df: DataFrame, topic: Column, key: Column | None = None) -> DataFrame:
    """(key, value JSON, topic) records for a Kafka sink (``write.format("kafka")``)."""
    cols = [c for c in df.columns]
    out = df.select((key.cast("string") if key is not None else F.lit(None).cast("string")).alias("key"),
                    F.to_json(F.struct(*cols)).alias("value"), topic.alias("topic"))
    return out
