"""All registered queries; importing a family registers it."""

from __future__ import annotations

from loadlens.plans import (  # noqa: F401
    compute,
    files,
    frames,
    latency,
    records,
    relational,
    reports,
    search,
    streams,
)
from loadlens.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
