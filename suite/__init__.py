"""Queries over the driver's tables, and the SQL each must agree with.

Every module has `QUERIES` (name -> function of session and folder) and
`ORACLES` (name -> SQL for the same tables).
"""

from __future__ import annotations

import importlib

MODULES = ["durations", "traces", "states", "usage", "workload", "functions", "documents", "streams"]

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"suite.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)


def flagship(spark, sf):
    return QUERIES["A1_duration_stats"](spark, sf)
