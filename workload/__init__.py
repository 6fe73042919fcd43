"""Registered queries over the driver tables, each next to the SQL that must give the same rows."""

from __future__ import annotations

import importlib

MODULES = ["q_serving", "q_scalars", "q_archive", "q_feed", "q_runs", "q_curves", "q_text", "q_sinks"]


def load():
    """(queries, sql) of all modules."""
    from workload import registry

    for name in MODULES:
        importlib.import_module(f"workload.{name}")
    return registry.QUERIES, registry.SQL
