"""All queries of the engine and their SQL."""

from __future__ import annotations

from . import companions, corpus, files, fixtures, learned, rules, service  # noqa: F401  they register their queries
from .registry import REGISTRY, Query


def queries() -> dict[str, Query]:
    return {name: function for name, (function, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
