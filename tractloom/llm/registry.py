"""Queries of this package by name: the build function and, where SQL can express it, an independent statement."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return keep
