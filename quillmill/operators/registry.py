"""Registries of named parts, plug-in modules and their listing (survey section N)."""

from __future__ import annotations

import importlib
import inspect
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quillmill.operators import retrieval, scoring


class Parts:
    """Factories by name; a keyword is forwarded only to a factory that declares it."""

    def __init__(self, kind: str) -> None:
        self.kind = kind
        self.parts: dict[str, Callable[..., Any]] = {}

    def register(self, name: str) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
        """Adds the decorated factory; a name is used once."""

        def add(f: Callable[..., Any]) -> Callable[..., Any]:
            if name in self.parts:
                raise ValueError(f"{self.kind} {name} is registered twice")
            self.parts[name] = f
            return f

        return add

    def make(self, name: str, **options: Any) -> Any:
        """Calls a factory with those of the options that it declares."""
        if name not in self.parts:
            raise KeyError(f"there is no {self.kind} {name}; there are {', '.join(sorted(self.parts))}")
        declared = inspect.signature(self.parts[name]).parameters
        return self.parts[name](**{k: v for k, v in options.items() if k in declared})


retrievers, scorers, providers = Parts("retriever"), Parts("scorer"), Parts("provider")


@retrievers.register("bm25")
def bm25(k: int = 10, k1: float = 1.5, b: float = 0.75) -> Callable[..., DataFrame]:
    """Okapi BM25 over (query_id, text) and (item_id, text)."""
    return lambda queries, items: retrieval.catalog_top_k(queries, items, "query_id", "text", "item_id", "text", k, k1, b)


@retrievers.register("tfidf")
def tfidf(k: int = 10) -> Callable[..., DataFrame]:
    """Cosine of tf-idf vectors over (query_id, text) and (item_id, text)."""
    return lambda queries, items: retrieval.top_k(retrieval.tfidf_scores(queries, items, "query_id", "text", "item_id", "text"), k)


@retrievers.register("dense")
def dense(k: int = 10) -> Callable[..., DataFrame]:
    """Cosine over (query_id, vector) and (item_id, vector), whole-number ids."""
    return lambda queries, items: retrieval.dense_top_k(queries, items, "query_id", "vector", "item_id", "vector", k)


for _name in ("toolqa", "logicbench", "medcalcbench"):
    scorers.register(_name)(lambda: scoring.native_details)
scorers.register("theoremqa")(lambda: scoring.theorem_details)


def load_plugins(modules: list[str]) -> None:
    """Imports modules that register parts of their own."""
    for m in modules:
        importlib.import_module(m)


def listing(spark: SparkSession, *registries: Parts) -> DataFrame:
    """(kind, name, parameters, about) of all registered parts."""
    rows = [(r.kind, n, str(inspect.signature(f)), (inspect.getdoc(f) or "").split("\n")[0]) for r in registries for n, f in sorted(r.parts.items())]
    return spark.createDataFrame(rows, "kind string, name string, parameters string, about string")


def apply_rows(rows: DataFrame, key: str, value: str, f: Callable[[str], str]) -> DataFrame:
    """(key, value, error) of a function applied row by row: failures and empty results become errors."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            values, errors = [], []
            for x in pdf[value]:
                try:
                    v = f(x)
                    values.append(v or None)
                    errors.append(None if v else "empty result")
                except Exception as e:  # a failing row must not fail the others
                    values.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf[[key]].assign(value=values, error=errors)

    return rows.select(key, value).mapInPandas(run, f"`{key}` {kind}, value string, error string")
