"""Collects every registered query."""

from __future__ import annotations

import importlib

from wayscore.plans.registry import OPERATORS, ORACLES, QUERIES

MODULES = (
    "trajectory_queries",
    "detection_queries",
    "track_queries",
    "distribution_queries",
    "caption_queries",
    "motion_queries",
    "raster_queries",
    "instance_queries",
    "association_queries",
)

GROUPS: dict[str, str] = {}
for _m in MODULES:
    _before = set(QUERIES)
    importlib.import_module(f"wayscore.plans.{_m}")
    for _n in set(QUERIES) - _before:
        GROUPS[_n] = _m

__all__ = ["QUERIES", "ORACLES", "OPERATORS", "GROUPS"]
