"""Latest-row operators: DISTINCT ON, top-1, latest value per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``SELECT DISTINCT ON (keys) * ... ORDER BY keys, order``.

    ``row_number() = 1`` over ``partitionBy(keys)``: Catalyst plans a
    ``WindowGroupLimit`` below the shuffle, so every map task forwards only its
    own best row per key -- a hot key costs one row per task, not its size.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def top1(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``ORDER BY order LIMIT 1`` -> ``TakeOrderedAndProject`` (per-task top-1)."""
    return df.orderBy(*order).limit(1)


def last_value_per_key(df: DataFrame, keys: Sequence[str], value: str, time: str,
                       tiebreak: str | None = None, value_alias: str = "last_value",
                       time_alias: str = "last_time") -> DataFrame:
    """Dashboard ``lastNotNull`` per key as a hash aggregate (partial + final).

    ``max_by`` over a struct keeps the pick deterministic on equal times.
    """
    ordering = F.struct(F.col(time), F.col(tiebreak)) if tiebreak else F.col(time)
    nn = df.filter(F.col(value).isNotNull())
    return nn.groupBy(*keys).agg(
        F.max_by(F.col(value), ordering).alias(value_alias),
        F.max(F.col(time)).alias(time_alias))
