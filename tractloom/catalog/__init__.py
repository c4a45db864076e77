"""Registered queries: each operator on the whole given tables, next to an independent SQL statement of its result."""

from __future__ import annotations

from importlib import import_module

MODULES = ["features", "joins", "evaluation", "serving", "textual", "sources", "modelling", "streams"]


def load():
    """All registered queries by name."""
    from .registry import REGISTRY

    for m in MODULES:
        import_module(f"{__name__}.{m}")
    return REGISTRY
