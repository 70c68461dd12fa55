"""Camera frames as a table: Spark's ``image`` source plus object-key parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy import constants as C

# Object keys are ``<device>_<epoch seconds>.jpg``; the device may contain '_'.
KEY_PATTERN = r"^(.*)_([0-9]+)\.[A-Za-z0-9]+$"


def key_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def sensor_of(key: Column) -> Column:
    s = F.regexp_extract(key, KEY_PATTERN, 1)
    return F.when(s == "", F.lit(C.DEFAULT_CAMERA_ID)).otherwise(s)


def epoch_of(key: Column) -> Column:
    return F.regexp_extract(key, KEY_PATTERN, 2).cast("long")


def read_frames(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Decode frames under ``path`` (or a list of files); undecodable files stay as rows with height -1."""
    return spark.read.format("image").option("dropInvalid", "false").load(path)


IMAGE_SCHEMA = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def stream_frames(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """New files under ``path`` as a stream, decoded on the executors; undecodable ones as in :func:`read_frames`."""
    return (spark.readStream.format("image").schema(IMAGE_SCHEMA).option("dropInvalid", "false")
            .option("maxFilesPerTrigger", max_files_per_trigger).load(path))


def read_frame_bytes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Raw bytes of frames (``binaryFile``), for sinks that keep the original JPEG."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
