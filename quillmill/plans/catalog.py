"""The catalog of core queries; importing it imports every query module."""

from __future__ import annotations

from quillmill.plans.registry import Query, core

_MODULES: tuple[str, ...] = ("text_queries", "retrieval_queries", "sampling_queries", "dedup_queries", "pool_queries", "scoring_queries", "tool_queries", "audit_queries", "source_queries", "selection_queries")


def _load() -> None:
    import importlib

    for m in _MODULES:
        importlib.import_module(f"quillmill.plans.{m}")


def queries() -> dict[str, Query]:
    """All core queries by name."""
    _load()
    return dict(core.queries)


def oracle_sql() -> dict[str, str]:
    """The SQL equivalents of the core queries that have one."""
    _load()
    return dict(core.oracles)
