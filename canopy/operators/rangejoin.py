"""Interval joins as bucketed equi-joins.

``points.time BETWEEN intervals.start AND intervals.end`` (same key) has no
equality on time, so Catalyst can only plan a nested loop or a cartesian
product inside each key.  Here every interval is expanded to the fixed-width
time buckets it overlaps, and points join on ``(key, bucket)`` -- a hash or
sort-merge equi-join -- with the exact range check as a residual.  A point
belongs to exactly one bucket, so there are no duplicate matches.  Interval
rows grow by (length / bucket width + 1); pick the bucket near the typical
interval length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.operators.sequence import epoch_us


def _b(t_us: Column, width: int) -> Column:
    return F.floor(t_us / F.lit(width)).cast("long")


def interval_join(points: DataFrame, intervals: DataFrame, by: Sequence[str], point_time: str,
                  start: str, end: str, *, bucket_s: float = 3600.0, how: str = "inner",
                  start_inclusive: bool = True, end_inclusive: bool = True) -> DataFrame:
    """Join each point to every interval of the same key that contains it.

    ``how`` is ``inner``, ``left`` (points kept), ``left_anti`` (points in no
    interval) or ``left_semi``.  Interval columns must not clash with point
    columns except the ``by`` keys.
    """
    by = list(by)
    width = int(bucket_s * 1_000_000)
    iv = (intervals
          .withColumn("__b", F.explode(F.sequence(_b(epoch_us(start), width),
                                                  _b(epoch_us(end), width)))))
    pt = points.withColumn("__b", _b(epoch_us(point_time), width))
    pc, s, e = F.col(point_time), F.col(start), F.col(end)
    lo = pc >= s if start_inclusive else pc > s
    hi = pc <= e if end_inclusive else pc < e
    cond = [pt[k] == iv[k] for k in by] + [pt["__b"] == iv["__b"], lo, hi]
    cond_col = cond[0]
    for c in cond[1:]:
        cond_col = cond_col & c
    joined = pt.join(iv, cond_col, how)
    if how in ("left_anti", "left_semi"):
        return joined.drop("__b")
    return joined.drop(iv["__b"]).drop(pt["__b"]).drop(*[iv[k] for k in by])
