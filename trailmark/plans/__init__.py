"""Runnable queries over the given tables."""

from importlib import import_module

MODULES = ["sessions", "ingest", "tables", "replay", "governance", "signals", "insights", "streams"]


def load():
    """All queries and their SQL equivalents."""
    from trailmark.plans import catalog

    for name in MODULES:
        import_module(f"trailmark.plans.{name}")
    return dict(catalog.RUNS), dict(catalog.SQL)
