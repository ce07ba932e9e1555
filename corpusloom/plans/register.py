"""The register that query modules add to."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None, *parts: str):
    """Register a query under its function's name, without _query or _stub at its end; parts: table expressions that its SQL starts with."""

    def add(function: Callable) -> Callable:
        text = f"WITH {', '.join(parts)} {sql}" if sql and parts else sql
        QUERIES[function.__name__.removesuffix("_query").removesuffix("_stub")] = (function, text)
        return function

    return add
