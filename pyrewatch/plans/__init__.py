"""Named queries over the test tables."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("detection", "correlation", "ingest", "profile", "retrieve", "grounded", "files")


def load_queries():
    """Import every query module once and return the registry."""
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
    from pyrewatch.plans.registry import REGISTRY

    return REGISTRY
