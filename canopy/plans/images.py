"""Camera frame queries: blur score, latest frame, per-day listing, timelapse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.functions.vision import add_blur_score, blur_image_udf, make_blur_pixels_udf
from canopy.operators.latest import latest_per_key
from canopy.operators.sequence import from_epoch_us
from canopy.plans.registry import register
from canopy.sources import bindings as B
from canopy.sources.images import epoch_of, key_of, read_frames, sensor_of

WIDTH = 8                 # embeddings are read as 8x8 grey frames
TIMELAPSE_FPS = 30
ROLLING_FRAMES_S = 48 * 3600

W_I = B.with_views("image_frames")

# Relational blur over pixel rows: explode, self-join four neighbours with
# reflect-101 borders, var_pop.  Independent of the array form used by Spark.
BLUR_CTE = f"""
, px AS (
  SELECT vec_id, CAST((i - 1) // {WIDTH} AS INT) AS r, CAST((i - 1) % {WIDTH} AS INT) AS c,
         CAST(embedding[i] AS DOUBLE) AS v, CAST(len(embedding) // {WIDTH} AS INT) AS h
  FROM image_frames, range(1, 1 + len(embedding)) t(i)),
lap AS (
  SELECT p.vec_id, u.v + d.v + l.v + rt.v - 4e0 * p.v AS lap
  FROM px p
  JOIN px u ON u.vec_id = p.vec_id AND u.c = p.c AND u.r = CASE WHEN p.r = 0 THEN 1 ELSE p.r - 1 END
  JOIN px d ON d.vec_id = p.vec_id AND d.c = p.c AND d.r = CASE WHEN p.r = p.h - 1 THEN p.h - 2 ELSE p.r + 1 END
  JOIN px l ON l.vec_id = p.vec_id AND l.r = p.r AND l.c = CASE WHEN p.c = 0 THEN 1 ELSE p.c - 1 END
  JOIN px rt ON rt.vec_id = p.vec_id AND rt.r = p.r AND rt.c = CASE WHEN p.c = {WIDTH - 1} THEN {WIDTH - 2} ELSE p.c + 1 END),
blur AS (SELECT vec_id, round(var_pop(lap), 6) AS blur_score FROM lap GROUP BY vec_id),
image_metrics AS (
  SELECT f.sensor_name, f.ts_epoch AS timestamp, f.image_path, b.blur_score
  FROM image_frames f JOIN blur b ON f.vec_id = b.vec_id)
"""
W_IM = W_I + BLUR_CTE


def _score(frames: DataFrame) -> DataFrame:
    """Add ``blur_score`` (rounded) from the ``embedding`` pixels; drops the pixels."""
    return (add_blur_score(frames, "embedding", WIDTH, "__blur")
            .withColumn("blur_score", F.when(F.col("embedding").isNotNull(), F.round("__blur", 6)))
            .drop("__blur", "embedding"))


def image_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_metrics(sensor_name, timestamp, image_path, blur_score), one row per frame."""
    f = add_blur_score(B.image_frames(spark, sf_dir), "embedding", WIDTH, "__blur")
    return f.select("sensor_name", F.col("ts_epoch").alias("timestamp"), "image_path",
                    F.round("__blur", 6).alias("blur_score"))


def decoded_metrics(img: DataFrame) -> DataFrame:
    """Rows of the ``image`` source, batch or stream, as image_metrics rows; an undecodable frame scores 0.0."""
    key = key_of(F.col("image.origin"))
    return img.select(
        sensor_of(key).alias("sensor_name"), epoch_of(key).alias("timestamp"),
        key.alias("image_path"),
        blur_image_udf(F.col("image.height"), F.col("image.width"), F.col("image.nChannels"),
                       F.col("image.data")).alias("blur_score"))


def frames_from_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Image files -> image_metrics rows (the batch form of the frame pipeline)."""
    return decoded_metrics(read_frames(spark, path))


@register("blur_relational", W_IM + "SELECT * FROM image_metrics")
def blur_relational(spark, sf_dir):
    """Blur score of every frame, as column expressions (the image_metrics table)."""
    return image_metrics(spark, sf_dir)


@register("blur_udf", W_IM + "SELECT image_path, blur_score FROM image_metrics")
def blur_udf(spark, sf_dir):
    """Blur score of every frame through the Arrow-batched numpy UDF."""
    f = B.image_frames(spark, sf_dir)
    udf = make_blur_pixels_udf(WIDTH)
    return f.select("image_path", F.round(udf(F.col("embedding")), 6).alias("blur_score"))


@register("scan_image_metrics", W_IM + "SELECT sensor_name, timestamp, image_path, blur_score FROM image_metrics")
def scan_image_metrics(spark, sf_dir):
    """Full scan of image_metrics (column-pruned)."""
    return image_metrics(spark, sf_dir).select("sensor_name", "timestamp", "image_path", "blur_score")


@register("latest_image", W_IM + """
SELECT coalesce(m.image_path, NULL) AS image_path, m.blur_score, m.timestamp,
       CASE WHEN m.image_path IS NULL THEN 'empty' ELSE 'success' END AS status
FROM (SELECT 1 AS one) o LEFT JOIN
     (SELECT * FROM image_metrics ORDER BY timestamp DESC, image_path DESC LIMIT 1) m ON TRUE""")
def latest_image(spark, sf_dir):
    """Newest frame with its score; one row with status 'empty' when there is none."""
    f = B.image_frames(spark, sf_dir)
    # newest frame first (a global aggregate always yields exactly one row, NULLs when empty),
    # then the blur of that one frame only
    best = f.agg(F.max_by(F.struct("image_path", F.col("ts_epoch").alias("timestamp"), "embedding"),
                          F.struct("ts_epoch", "image_path")).alias("b"))
    scored = _score(best.select("b.*"))
    return scored.select("image_path", "blur_score", "timestamp",
                         F.when(F.col("image_path").isNull(), "empty").otherwise("success").alias("status"))


@register("media_latest", W_IM + """
SELECT DISTINCT ON (sensor_name) sensor_name, image_path, timestamp, blur_score
FROM image_metrics ORDER BY sensor_name, timestamp DESC, image_path DESC""")
def media_latest(spark, sf_dir):
    """Latest photo of each camera."""
    f = B.image_frames(spark, sf_dir).withColumnRenamed("ts_epoch", "timestamp")
    last = latest_per_key(f, ["sensor_name"], [F.col("timestamp").desc(), F.col("image_path").desc()])
    return _score(last).select("sensor_name", "image_path", "timestamp", "blur_score")  # score survivors only


@register("rolling_frames", W_I + f"""
SELECT sensor_name, ts_epoch, image_path FROM image_frames
WHERE ts_epoch >= (SELECT max(ts_epoch) FROM image_frames) - {ROLLING_FRAMES_S}""")
def rolling_frames(spark, sf_dir):
    """Frames of the last 48 h (relative to the newest frame)."""
    f = B.image_frames(spark, sf_dir).select("sensor_name", "ts_epoch", "image_path")
    newest = f.agg(F.max("ts_epoch")).first()[0]  # one scalar, like as_of
    if newest is None:
        return f.limit(0)
    return f.filter(F.col("ts_epoch") >= F.lit(newest - ROLLING_FRAMES_S))


_DAY_SQL = "CAST(to_timestamp(ts_epoch) AT TIME ZONE 'UTC' AS DATE)"


def _day(col="ts_epoch"):
    return F.to_date(from_epoch_us(F.col(col) * F.lit(1_000_000)))  # UTC day, any session zone


@register("frames_by_day", W_I + f"""
SELECT sensor_name, {_DAY_SQL} AS day, count(*) AS n_frames,
       min(ts_epoch) AS first_ts, max(ts_epoch) AS last_ts
FROM image_frames GROUP BY sensor_name, {_DAY_SQL}""")
def frames_by_day(spark, sf_dir):
    """Frames per camera and day (the timelapse input)."""
    f = B.image_frames(spark, sf_dir)
    return f.groupBy("sensor_name", _day().alias("day")).agg(
        F.count(F.lit(1)).alias("n_frames"), F.min("ts_epoch").alias("first_ts"),
        F.max("ts_epoch").alias("last_ts"))


@register("timelapse_manifest", W_I + f"""
SELECT sensor_name, {_DAY_SQL} AS day, image_path,
  row_number() OVER (PARTITION BY sensor_name, {_DAY_SQL} ORDER BY ts_epoch, image_path) AS frame_no,
  (row_number() OVER (PARTITION BY sensor_name, {_DAY_SQL} ORDER BY ts_epoch, image_path) - 1)
    / {TIMELAPSE_FPS}e0 AS pts_s
FROM image_frames""")
def timelapse_manifest(spark, sf_dir):
    """Frame order and presentation time of a 30 fps timelapse per camera-day."""
    f = B.image_frames(spark, sf_dir).withColumn("day", _day())
    w = Window.partitionBy("sensor_name", "day").orderBy("ts_epoch", "image_path")
    rn = F.row_number().over(w)
    return f.select("sensor_name", "day", "image_path", rn.alias("frame_no"),
                    ((rn - 1) / F.lit(float(TIMELAPSE_FPS))).alias("pts_s"))


@register("sink_frames_dedup", W_I + """
SELECT DISTINCT ON (image_path) image_path, sensor_name, ts_epoch
FROM image_frames ORDER BY image_path, vec_id DESC""")
def sink_frames_dedup(spark, sf_dir):
    """Object-store semantics: a key written twice keeps the last write."""
    f = B.image_frames(spark, sf_dir)
    return latest_per_key(f, ["image_path"], [F.col("vec_id").desc()]) \
        .select("image_path", "sensor_name", "ts_epoch")
