"""Table tools over string tables: load, filter, get values, SQL, calculator, and the dispatcher (survey D1, D2, L)."""

from __future__ import annotations

import re
import threading
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.answers import calculate_text

OBSERVATION_CHARS = 3000
_OPERATORS = (">=", "<=", ">", "<", "=")


def as_strings(df: DataFrame) -> DataFrame:
    """Every column as a string; missing cells stay null."""
    return df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns))


def parse_condition(text: str) -> tuple[str, str, str] | None:
    """(column, operator, value) of one conjunct; null without operator. Quotes around the value are dropped."""
    for op in _OPERATORS:
        if op in text:
            column, value = text.split(op, 1)
            value = value.strip()
            if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
                value = value[1:-1]
            return column, op, value
    return None


def condition(column: Column, op: str, value: str) -> Column:
    """Comparison of strings, character by character; null never satisfies one."""
    v = F.lit(value)
    return {">=": column >= v, "<=": column <= v, ">": column > v, "<": column < v, "=": column == v}[op]


def filter_columns(df: DataFrame, argument: str) -> DataFrame:
    """All conjuncts of "c1, c2" as one filter that reaches the scan; raises for an unknown column."""
    for part in argument.split(", "):
        parsed = parse_condition(part)
        if parsed:
            column, op, value = parsed
            if column not in df.columns:
                raise ValueError(f"no column {column!r}")
            df = df.where(condition(F.col(f"`{column}`"), op, value))
    return df


def get_value(df: DataFrame, column: str, order: str) -> DataFrame:
    """One row: the values of a column in row order, joined by ", " (D2); null cells are an error in a tool call."""
    items = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("v"))))
    return df.agg(F.array_join(F.transform(items, lambda x: x["v"]), ", ").alias("value"))


@dataclass
class ToolSession:
    """State of one instance: a loaded table and its filters. Tables and views are shared, filters are not."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    seconds: int = 30
    data: DataFrame | None = None
    graphs: dict[str, object] = field(default_factory=dict)

    def load(self, name: str) -> str:
        """LoadDB: binds the table and registers it as a view."""
        if name not in self.tables:
            return f"There is no table {name}."
        self.data = as_strings(self.tables[name])
        self.data.createOrReplaceTempView(f"{name}_data")
        return "Loaded the table with the columns: " + ", ".join(self.data.columns)

    def filter(self, argument: str) -> str:
        """FilterDB: an empty result restores the state before the call; an error keeps what came before it."""
        if self.data is None:
            return "No table is loaded."
        before = self.data
        for part in argument.split(", "):
            try:
                narrowed = filter_columns(self.data, part)
            except ValueError:
                return f"The condition {part} failed."
            if narrowed.isEmpty():
                self.data = before
                return f"The condition {part} leaves no row."
            self.data = narrowed
        return f"Filtered the table ({self.data.count()} rows)."

    def value(self, column: str) -> str:
        """GetValue: at most the observation's characters are gathered, not the column of a large table."""
        if self.data is None:
            return "No table is loaded."
        if column not in self.data.columns:
            return f"There is no column {column}."
        rows = self.data.select(F.col(f"`{column}`").alias("v")).limit(OBSERVATION_CHARS + 1).collect()
        if any(r["v"] is None for r in rows):
            return f"The column {column} has missing cells."
        return ", ".join(r["v"] for r in rows)

    def sql(self, query: str) -> str:
        """SQLInterpreter: a read-only query over the registered tables within its time (L3)."""
        q = re.sub(r"\b\w+\.(\w+_data)\b", r"\1", query.strip().rstrip(";"))
        if not re.match(r"(?is)^\s*(?:select|with|values)\b", q):
            return "Only queries are allowed."
        group = f"tool-{threading.get_ident()}-{id(q)}"
        sc = self.spark.sparkContext
        timer = threading.Timer(self.seconds, lambda: sc.cancelJobGroup(group))
        sc.setJobGroup(group, "tool query", interruptOnCancel=True)
        timer.start()
        try:
            df = self.spark.sql(q)
            rows = as_strings(df.toDF(*[f"c{i}" for i in range(len(df.columns))])).limit(OBSERVATION_CHARS).collect()
            return "\n".join(", ".join(f"{c}: {v}" for c, v in zip(df.columns, r)) for r in rows)
        except Exception as e:  # the tool reports any failure of a query as its observation
            return "The query failed: " + str(e).splitlines()[0][:200]
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)

    def act(self, action: str | None) -> str:
        """The dispatcher: one action "Kind[argument]" to its observation, cut to its length."""
        text = (action or "").strip()
        if not text:
            return "The action is empty."
        if re.search(r"\][,;]?\s+\w+\[", text) and not text.startswith("SQLInterpreter["):
            return "Only one action at a time."
        m = re.match(r"(?s)^(\w+)\[(.*)\]$", text)
        if not m:
            return "The action can't be read."
        kind, argument = m.groups()
        run = {"LoadDB": self.load, "FilterDB": self.filter, "GetValue": self.value, "SQLInterpreter": self.sql, "Calculate": lambda a: calculate_text(a) or "The expression can't be computed.", "Finish": lambda a: a}.get(kind)
        if run is None:
            graph = self.graphs.get(kind)
            out = graph(argument) if callable(graph) else f"There is no action {kind}."
        else:
            out = run(argument)
        return out if len(out) <= OBSERVATION_CHARS else out[:OBSERVATION_CHARS] + "..."
