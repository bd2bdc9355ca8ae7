"""The registered queries of the time-series operators and their SQL."""

from __future__ import annotations

from pairflow.catalog import classes, lags, pairs, places, selections, series  # noqa: F401
from pairflow.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
