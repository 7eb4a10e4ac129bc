"""Registered queries over the given tables."""

from __future__ import annotations

import importlib

from tidemark.catalog.registry import ORACLE, QUERIES

MODULES = (
    "primitives", "money", "identity", "usage", "scores", "purchase", "experiment", "allocation", "reconcile",
    "audience", "dispatch", "tracking", "reporting", "sizing", "backtest", "checks", "sinks", "streams", "build",
)


def load():
    for name in MODULES:
        try:
            importlib.import_module(f"tidemark.catalog.{name}")
        except ModuleNotFoundError as error:
            if error.name != f"tidemark.catalog.{name}":
                raise
    return QUERIES, ORACLE
