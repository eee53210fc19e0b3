"""Runnable queries over the given tables, each beside the SQL it must equal."""

from . import alerts, events, profiles, scalars, streams, timeseries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
