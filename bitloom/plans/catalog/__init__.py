"""Runnable queries over the given tables, each with its SQL twin where one exists."""

from . import features, inventory, joins, parameters, products, sources, spatial, streams, telemetry, types  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
