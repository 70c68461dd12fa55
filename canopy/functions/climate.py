"""Climate expressions: vapour-pressure deficit, light and ventilation rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopy import constants as C

# Published Tetens / FAO-56 saturation vapour pressure (kPa):
# es(T) = 0.6108 * exp(17.27 * T / (T + 237.3))
TETENS_A = 0.6108
TETENS_B = 17.27
TETENS_C = 237.3

LIGHT_ON_HOUR = 6        # grow-light schedule: on from 06:00 ...
LIGHT_OFF_HOUR = 22      # ... until 22:00, when ambient light is low
LIGHT_AMBIENT_LUX = 10000.0
EXTRACT_TEMP = 28.0      # extraction fan above this air temperature
EXTRACT_HUMIDITY = 80.0  # ... or above this relative humidity
STIR_TEMP = 26.0         # stirring fan above this air temperature


def vpd_kpa(temp_c: Column, rh_pct: Column) -> Column:
    es = F.lit(TETENS_A) * F.exp(F.lit(TETENS_B) * temp_c / (temp_c + F.lit(TETENS_C)))
    return es * (F.lit(1.0) - rh_pct / F.lit(100.0))


def vpd_sql(t: str, rh: str) -> str:
    return f"({TETENS_A}e0 * exp({TETENS_B}e0 * {t} / ({t} + {TETENS_C}e0)) * (1e0 - {rh} / 100e0))"


def expected_lux(light_on: Column, louvers_pct: Column) -> Column:
    """Light model of the climate node: base + grow light + sun through louvers."""
    return (F.lit(C.LUX_BASE) + F.when(light_on, F.lit(C.LUX_GROW_LIGHT)).otherwise(F.lit(0.0))
            + F.lit(C.LUX_SUN_FULL) * (louvers_pct / F.lit(100.0)))


def light_cycle(time: Column, ambient_lux: Column | None = None) -> Column:
    on = (F.hour(time) >= LIGHT_ON_HOUR) & (F.hour(time) < LIGHT_OFF_HOUR)
    if ambient_lux is not None:
        on = on & (ambient_lux < F.lit(LIGHT_AMBIENT_LUX))
    return on


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))
