"""Weather API documents (batch) and the weather topic sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.plans.registry import register
from canopy.sources import bindings as B
from canopy.sources.sinks import to_topic_records

WEATHER_TOPIC = "weather_raw"
W_W = B.with_views("weather_metrics")


def weather_documents(spark, sf_dir):
    """Stored API responses: one JSON document per observation, values under ``current_weather``."""
    w = B.weather_metrics(spark, sf_dir)
    cw = F.struct(F.col("temperature"), F.col("windspeed"), F.col("weathercode"),
                  F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("time"))
    return w.select("sensor_name", F.to_json(F.struct(cw.alias("current_weather"))).alias("doc"))


def parse_weather_documents(docs):
    """API document -> weather record (the station name travels beside the document)."""
    v = F.try_parse_json(F.col("doc"))
    cw = F.try_variant_get(v, "$.current_weather", "variant")
    return docs.select(
        F.try_variant_get(cw, "$.time", "string").try_cast("timestamp_ntz").alias("time"),
        "sensor_name",
        F.try_variant_get(cw, "$.temperature", "double").alias("temperature"),
        F.try_variant_get(cw, "$.windspeed", "double").alias("windspeed"),
        F.try_variant_get(cw, "$.weathercode", "int").alias("weathercode"))


@register("src_weather_batch", W_W + "SELECT * FROM weather_metrics")
def src_weather_batch(spark, sf_dir):
    """Collected weather API documents parsed back into weather rows (round trip)."""
    return parse_weather_documents(weather_documents(spark, sf_dir))


@register("sink_weather_topic")
def sink_weather_topic(spark, sf_dir):
    """Weather rows as (key, JSON value, topic) records for a Kafka sink."""
    w = B.weather_metrics(spark, sf_dir)
    return to_topic_records(w, F.lit(WEATHER_TOPIC), key=F.col("sensor_name"))
