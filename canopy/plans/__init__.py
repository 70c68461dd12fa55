"""Query plans.  Importing this package registers every query."""

from canopy.plans.registry import REGISTRY, register  # noqa: F401


def load_all() -> dict:
    """Import every plan module so that all queries are registered."""
    from canopy.plans import (telemetry, actuators, weather, images, dashboard,  # noqa: F401
                              control_queries, commands, operations, modes, messages, weather_api, config, streams)
    return REGISTRY
