"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str
    kind: str = "batch"   # "stream": runs a Structured Streaming query (availableNow) when built


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, kind: str = "batch"):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``sql`` is the equivalent DuckDB query over the driver's tables; leave it
    out only for operators that SQL cannot express.
    """
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, (fn.__doc__ or "").strip().split("\n")[0], kind)
        return fn
    return deco
