"""Weather table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.functions import climate
from canopy.plans.registry import register
from canopy.sources import bindings as B

W_W = B.with_views("weather_metrics")


def wx(spark, sf_dir):
    return B.weather_metrics(spark, sf_dir)


@register("scan_weather", W_W + "SELECT * FROM weather_metrics")
def scan_weather(spark, sf_dir):
    """Full scan of the weather table."""
    return wx(spark, sf_dir)


@register("count_rows", W_W + "SELECT count(*) AS n FROM weather_metrics")
def count_rows(spark, sf_dir):
    """COUNT(*) of the weather table."""
    return wx(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


@register("preview5", W_W + "SELECT * FROM weather_metrics ORDER BY time, sensor_name LIMIT 5")
def preview5(spark, sf_dir):
    """First five rows (ordered, so the preview is repeatable)."""
    return wx(spark, sf_dir).orderBy("time", "sensor_name").limit(5)


@register("vpd", W_W + f"""
SELECT time, sensor_name, temperature, weathercode AS humidity,
  round({climate.vpd_sql('temperature', 'weathercode')}, 6) AS vpd_kpa
FROM weather_metrics""")
def vpd(spark, sf_dir):
    """Vapour-pressure deficit from temperature and humidity (weathercode as RH %)."""
    w = wx(spark, sf_dir)
    return w.select("time", "sensor_name", "temperature", F.col("weathercode").alias("humidity"),
                    F.round(climate.vpd_kpa(F.col("temperature"), F.col("weathercode")), 6)
                    .alias("vpd_kpa"))


@register("unpivot_metrics", W_W + """
SELECT time, sensor_name, 'temperature' AS metric, temperature AS value FROM weather_metrics
UNION ALL SELECT time, sensor_name, 'windspeed', windspeed FROM weather_metrics
UNION ALL SELECT time, sensor_name, 'weathercode', CAST(weathercode AS DOUBLE) FROM weather_metrics""")
def unpivot_metrics(spark, sf_dir):
    """Wide weather record -> one (metric, value) row per measure."""
    w = wx(spark, sf_dir).withColumn("weathercode", F.col("weathercode").cast("double"))
    return w.unpivot(["time", "sensor_name"], ["temperature", "windspeed", "weathercode"],
                     "metric", "value")


@register("climate_trigger", W_W + f"""
SELECT time, sensor_name,
  temperature > {climate.EXTRACT_TEMP}e0 OR weathercode > {climate.EXTRACT_HUMIDITY}e0 AS extractor_on,
  temperature > {climate.STIR_TEMP}e0 AS stirring_on,
  hour(time) >= {climate.LIGHT_ON_HOUR} AND hour(time) < {climate.LIGHT_OFF_HOUR} AS light_on
FROM weather_metrics""")
def climate_trigger(spark, sf_dir):
    """Fan and grow-light decisions from temperature, humidity and clock."""
    w = wx(spark, sf_dir)
    return w.select(
        "time", "sensor_name",
        ((F.col("temperature") > climate.EXTRACT_TEMP)
         | (F.col("weathercode") > climate.EXTRACT_HUMIDITY)).alias("extractor_on"),
        (F.col("temperature") > climate.STIR_TEMP).alias("stirring_on"),
        climate.light_cycle(F.col("time")).alias("light_on"))
