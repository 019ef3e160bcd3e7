"""Registered queries: each is a Spark plan over the given tables with the SQL it is checked against, if SQL can say it."""

from __future__ import annotations

import importlib

MODULES = ("alerting", "scalars", "fusion", "evaluation", "health", "reporting", "streams", "calibration")


def registry() -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(importlib.import_module(f"sightgrid.plans.{name}").QUERIES)
    return out
