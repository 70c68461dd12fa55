"""Command normalisation: pump name aliases and the emergency stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy import constants as C

ESTOP_TARGET = "EMERGENCY_STOP"   # the dashboard sends a PULSE to this target, 0 ms
ESTOP_ACTION = "ESTOP"


def canonical_pump(name: Column) -> Column:
    """Dashboard pump names (nutri a/b/c) -> the node's names (nutri 1/2/3); others unchanged."""
    expr = name
    for alias, canon in C.PUMP_ALIASES.items():
        expr = F.when(name == alias, F.lit(canon)).otherwise(expr)
    return expr


def normalize_commands(cmds: DataFrame) -> DataFrame:
    """Canonical pump names; a PULSE to the emergency-stop target becomes action ESTOP."""
    tgt = canonical_pump(F.col("target"))
    action = F.when((F.col("action") == C.COMMAND_ACTION) & (F.col("target") == ESTOP_TARGET),
                    F.lit(ESTOP_ACTION)).otherwise(F.col("action"))
    return cmds.withColumn("target", tgt).withColumn("action", action)
