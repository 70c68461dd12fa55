"""Order-independent numeric aggregation.

Floating-point sums depend on summation order, which depends on how Spark
partitions the data -- so a re-run, a retried task or a different cluster
size can change the last bits of an average, and a threshold on it.
Averages here accumulate readings as integer micro-units (exact, order
independent) and divide once at the end.  Sensor values carry at most a few
decimals, so the quantum of 1e-6 loses nothing.  NaN and infinite readings
count as missing, in sums and in counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 1_000_000


def micros(v: Column) -> Column:
    """Value as integer micro-units (half rounds up); null for NaN and infinite values."""
    finite = F.abs(v) < F.lit(float("inf"))  # NaN orders above infinity
    return F.when(finite, F.floor(v * F.lit(float(SCALE)) + F.lit(0.5)).cast("long"))


def from_micros(total: Column, count: Column | None = None) -> Column:
    """sum / count / 1e6 as DOUBLE; null when count is 0."""
    if count is None:
        return total / F.lit(float(SCALE))
    return F.when(count > 0, total / count / F.lit(float(SCALE)))


def exact_avg(v: Column) -> Column:
    """Aggregate: average of the finite values of ``v``, order independent."""
    return from_micros(F.sum(micros(v)), F.count(micros(v)))


def exact_sum(v: Column) -> Column:
    """Aggregate: sum of ``v``, order independent."""
    return from_micros(F.sum(micros(v)))


# SQL text of the same (DuckDB oracle)
def sql_micros(v: str) -> str:
    return f"CASE WHEN isfinite(CAST({v} AS DOUBLE)) THEN CAST(floor(({v}) * 1e6 + 0.5) AS BIGINT) END"


def sql_avg(v: str, filt: str | None = None) -> str:
    f = f" FILTER (WHERE {filt})" if filt else ""
    m = sql_micros(v)
    return f"(CASE WHEN count({m}){f} > 0 THEN CAST(sum({m}){f} AS DOUBLE) / count({m}){f} / 1e6 END)"


def sql_sum(v: str) -> str:
    return f"(CAST(sum({sql_micros(v)}) AS DOUBLE) / 1e6)"
