"""All registered queries."""

from __future__ import annotations

from . import alerting, flowing, ingesting, measuring, modelling, policing, streamed, windows  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
