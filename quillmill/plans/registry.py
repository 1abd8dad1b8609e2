"""Collects the queries of the core modules and, where present, of optional subpackages."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, update_wrapper

from pyspark.sql import DataFrame, SparkSession

from quillmill.functions.text import normalize_exact

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Named queries, each with the equivalent SQL where SQL can express it."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Register the decorated function under ``name``; a name is used once."""

        def add(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return add

    def exact(self, f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        """Register a query that takes the ``form`` of normalisation a second time, as ``NAME_nfkc`` in the exact form.

        The query itself keeps the JVM-side form, which its SQL follows; DuckDB has no NFKC, so the exact one has no SQL.
        """
        self.query(f"{f.__name__}_nfkc")(update_wrapper(partial(f, form=normalize_exact), f))
        return f


core = Registry()
