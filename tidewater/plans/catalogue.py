"""Every query of the library with its SQL."""

from __future__ import annotations

from tidewater.plans import calendar, chains, details, exchange, indicators, live, signals, strategies, windows  # noqa: F401  register their queries
from tidewater.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
