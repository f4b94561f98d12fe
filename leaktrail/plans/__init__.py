"""Registered queries, grouped by subject."""

from importlib import import_module

MODULES = ["flow_queries", "scalar_queries", "rate_queries", "stat_queries", "run_queries", "redaction_queries", "source_queries"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"leaktrail.plans.{name}")
