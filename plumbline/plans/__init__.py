"""Registered queries, one module for each area."""

from __future__ import annotations

from plumbline.plans import aggregates, frames, functions, hits, joins, more, scans, setops, subqueries, tpch, windows  # noqa: F401
from plumbline.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
