"""Event-time windows and deduplication on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions.numeric import from_micros, micros
from canopy.operators.sequence import epoch_us, from_epoch_us
from canopy.streaming.blocks import ID_KINDS, join_ahead


def to_instant(c):
    """TIMESTAMP_NTZ wall clock -> TIMESTAMP instant, read as UTC in any session zone."""
    return F.timestamp_micros(epoch_us(c))


def to_ntz(c):
    """Inverse of :func:`to_instant`."""
    return from_epoch_us(F.unix_micros(c))


def event_time(df: DataFrame, col: str = "time") -> DataFrame:
    """Watermarks and windows need TIMESTAMP; the tables carry TIMESTAMP_NTZ.  The
    conversion goes through epoch microseconds, so windows align to UTC hours and
    results do not depend on the session time zone."""
    return df.withColumn(col, to_instant(F.col(col)))


def hourly_trend_stream(telemetry: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Mean per metric and hour; a window is emitted once the watermark passes it (append)."""
    t = event_time(telemetry).withWatermark("time", watermark)
    g = t.groupBy(F.window("time", "1 hour").alias("w"), "metric").agg(
        F.sum(micros(F.col("value"))).alias("s"), F.count(micros(F.col("value"))).alias("n"))
    return g.select(to_ntz(F.col("w.start")).alias("hour_start"), "metric",
                    from_micros(F.col("s"), F.col("n")).alias("avg_value"))


def minute_downsample_stream(telemetry: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    t = event_time(telemetry).withWatermark("time", watermark)
    g = t.groupBy(F.window("time", "1 minute").alias("w"), "device_id", "metric").agg(
        F.sum(micros(F.col("value"))).alias("s"), F.count(micros(F.col("value"))).alias("c"),
        F.count(F.lit(1)).alias("n"))
    return g.select("device_id", "metric", to_ntz(F.col("w.start")).alias("minute"),
                    from_micros(F.col("s"), F.col("c")).alias("avg_value"), "n")


def late_replay_dedup(telemetry: DataFrame, keys=("device_id", "metric", "time"),
                      watermark: str = "24 hours") -> DataFrame:
    """Edge nodes re-send up to 24 h of cached readings after an outage: keep one copy."""
    return event_time(telemetry).withWatermark("time", watermark).dropDuplicatesWithinWatermark(list(keys))


def _longest_us(spark: SparkSession, interval: str) -> int:
    """Microseconds that the interval lasts at most: its months at their longest, two days for changes of a zone's clock."""
    start = "timestamp_ntz'2003-07-01'"
    return spark.sql(f"SELECT {start} AS a, {start} + INTERVAL {interval} AS b").select(
        (epoch_us("b") - epoch_us("a")).alias("us")).first().us + 2 * 86_400_000_000


def _in_blocks(commands: DataFrame, acks: DataFrame) -> bool:
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return (kind(commands, "cmd_id") == kind(acks, "cmd_id") and kind(acks, "cmd_id") in ID_KINDS
            and kind(commands, "target") == kind(acks, "status") == "string")


def ack_join_stream(commands: DataFrame, acks: DataFrame, within: str = "30 days",
                    how: str = "inner") -> DataFrame:
    """Stream-stream join of commands and their acks (same cmd_id, ack within the window).

    Both sides carry watermarks, so state older than the window is dropped;
    ``how="left_outer"`` emits lost commands once the watermark passes them.
    The inner join keeps blocks of rows in its state (:func:`blocks.join_ahead`);
    other joins, which must know each row's matches, and other types single rows.
    """
    if how == "inner" and _in_blocks(commands, acks):
        c, a = (df.select(F.col("cmd_id").alias("id"), epoch_us("time").alias("t_us"), F.col(v).alias("value"))
                for df, v in ((commands, "target"), (acks, "status")))
        j = join_ahead(c, a, _longest_us(commands.sparkSession, within), within)
        at, ack = F.timestamp_micros("l_us"), F.timestamp_micros("r_us")
        return j.where((ack >= at) & (ack <= at + F.expr(f"INTERVAL {within}"))).select(
            F.col("id").alias("cmd_id"), F.col("l_value").alias("target"), from_epoch_us(F.col("l_us")).alias("cmd_time"),
            from_epoch_us(F.col("r_us")).alias("ack_time"), F.col("r_value").alias("status"))
    c = event_time(commands).withWatermark("time", within).alias("c")
    a = event_time(acks).withWatermark("time", within).alias("a")
    cond = F.expr(f"a.cmd_id = c.cmd_id AND a.time >= c.time AND a.time <= c.time + INTERVAL {within}")
    j = c.join(a, cond, how)
    return j.select(F.col("c.cmd_id").alias("cmd_id"), F.col("c.target").alias("target"),
                    to_ntz(F.col("c.time")).alias("cmd_time"),
                    to_ntz(F.col("a.time")).alias("ack_time"), F.col("a.status").alias("status"))
