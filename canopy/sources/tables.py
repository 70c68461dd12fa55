"""Parquet table access and data-derived query parameters."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

_BOUNDS: dict[str, tuple[_dt.datetime, _dt.datetime]] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_bounds(spark: SparkSession, sf_dir: str) -> tuple[_dt.datetime, _dt.datetime]:
    """(min(ts), max(ts)) of ``events``.

    One scalar aggregate; with ``spark.sql.parquet.aggregatePushdown`` it is
    answered from parquet footers.  The values become literals in later plans
    so that time predicates fold to constants and reach the parquet scan.
    """
    key = f"{id(spark)}:{sf_dir}"
    if key not in _BOUNDS:
        row = (read_table(spark, sf_dir, "events")
               .agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first())
        _BOUNDS[key] = (row["lo"], row["hi"])
    return _BOUNDS[key]


def as_of(spark: SparkSession, sf_dir: str) -> _dt.datetime:
    """The query-time 'now': latest event time, so runs are repeatable."""
    return event_bounds(spark, sf_dir)[1]


def ntz(value: _dt.datetime):
    """A TIMESTAMP_NTZ literal column."""
    text = value if isinstance(value, str) else value.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def ntz_sql(value: _dt.datetime) -> str:
    """The same literal as SQL text (valid in Spark and DuckDB)."""
    return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
