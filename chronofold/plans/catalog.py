"""All registered queries."""

from __future__ import annotations

from chronofold.plans import domain, relational, scalars, scans, streams  # noqa: F401
from chronofold.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
