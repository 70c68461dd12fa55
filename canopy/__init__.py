"""canopy: greenhouse telemetry analytics on Spark.

Telemetry, actuator, weather, image and event tables are read as Spark
DataFrames; every query in :mod:`canopy.plans` is a declarative plan that
Catalyst optimises.  Custom sequence operators (as-of, lag/lead, trailing
range aggregates) live in :mod:`canopy.operators` and are written so that a
single hot key never ends up in a single task.
"""

__version__ = "0.1.0"
