"""Registered queries over the given tables, each with its SQL twin."""

from __future__ import annotations

from . import cleaning, files, profiling, records, shaping, versioning  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
