"""Registered queries over the given tables."""

from __future__ import annotations

from millrace.registry.core import CHECKS, QUERIES, Query


def _load() -> None:
    from millrace.registry import grouped, rows, sources, stateful, streams  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def checks() -> dict[str, str]:
    _load()
    return dict(CHECKS)
