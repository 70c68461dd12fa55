"""Dashboard expressions: live defaults, gauge geometry, colour bands, activity classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy import constants as C


def limits_df(spark: SparkSession) -> DataFrame:
    """The metric limits dimension (fixed, four rows)."""
    rows = [(m, *v) for m, v in C.METRIC_LIMITS.items()]
    return spark.createDataFrame(rows, "metric string, target double, min_ok double, "
                                       "max_ok double, min_v double, max_v double")


def limits_sql() -> str:
    vals = ", ".join(f"('{m}', {t}e0, {a}e0, {b}e0, {lo}e0, {hi}e0)"
                     for m, (t, a, b, lo, hi) in C.METRIC_LIMITS.items())
    return f"SELECT * FROM (VALUES {vals}) AS l(metric, target, min_ok, max_ok, min_v, max_v)"


def live_default(v: Column, default: float) -> Column:
    """``value || default``: missing, 0 and NaN all fall back."""
    return F.when(v.isNull() | (v == 0) | F.isnan(v), F.lit(float(default))).otherwise(v)


def live_default_sql(v: str, default: float) -> str:
    return f"CASE WHEN {v} IS NULL OR {v} = 0 OR isnan({v}) THEN {float(default)}e0 ELSE {v} END"


def gauge_columns(value: Column, min_ok: Column, max_ok: Column, lo: Column, hi: Column) -> list[Column]:
    rng = hi - lo
    cursor = (value - lo) / rng * F.lit(100.0)
    return [
        ((min_ok - lo) / rng * F.lit(100.0)).alias("green_start_pct"),
        ((max_ok - min_ok) / rng * F.lit(100.0)).alias("green_width_pct"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), cursor)).alias("cursor_pct"),
        ((value >= min_ok) & (value <= max_ok)).alias("is_ok"),
        F.format_string("%.2f", value).alias("display"),
    ]


def band(value: Column, steps: list[tuple[float, str]]) -> Column:
    """Colour of the highest step whose lower bound is <= value (first step is the base)."""
    expr = F.lit(steps[0][1])
    for lower, colour in steps[1:]:
        expr = F.when(value >= F.lit(float(lower)), F.lit(colour)).otherwise(expr)
    return expr


def band_sql(v: str, steps: list[tuple[float, str]]) -> str:
    whens = " ".join(f"WHEN {v} >= {float(lo)}e0 THEN '{c}'" for lo, c in reversed(steps[1:]))
    return f"CASE {whens} ELSE '{steps[0][1]}' END"


def activity_class(count: Column) -> Column:
    """0 -> empty, <3 -> low, <6 -> mid, else high."""
    (z, z_name), *rest = C.ACTIVITY_BUCKETS
    expr = F.when(count == z, z_name)
    for bound, name in rest:
        expr = expr.when(count < bound, name)
    return expr.otherwise(C.ACTIVITY_TOP)


def activity_class_sql(c: str) -> str:
    (z, z_name), *rest = C.ACTIVITY_BUCKETS
    whens = " ".join(f"WHEN {c} < {b} THEN '{n}'" for b, n in rest)
    return f"CASE WHEN {c} = {z} THEN '{z_name}' {whens} ELSE '{C.ACTIVITY_TOP}' END"


def halo(metric: Column, avg: Column, min_ok: Column, max_ok: Column) -> Column:
    expr = F.lit("none")
    for m, (high, low) in C.HALO_COLOURS.items():
        expr = F.when((metric == m) & (avg > max_ok), high) \
                .when((metric == m) & (avg < min_ok), low).otherwise(expr)
    return expr


def halo_sql(metric: str, avg: str, min_ok: str, max_ok: str) -> str:
    parts = []
    for m, (high, low) in C.HALO_COLOURS.items():
        parts.append(f"WHEN {metric} = '{m}' AND {avg} > {max_ok} THEN '{high}'")
        parts.append(f"WHEN {metric} = '{m}' AND {avg} < {min_ok} THEN '{low}'")
    return "CASE " + " ".join(parts) + " ELSE 'none' END"
