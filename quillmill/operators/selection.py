"""Selections and gates (survey B26, D8, D11 to D14, D17, D18, F22, A35)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import normalize_exact

PASSAGE_LEAST, PASSAGE_SHOWN, QUESTION_LEAST = 300, 1200, 10


def exclude_held_out(candidates: DataFrame, held_out: DataFrame, text: str, held_text: str, norm: Callable[[Column | str], Column] = normalize_exact) -> DataFrame:
    """Candidates whose normalised question is in no held-out slice; those without words are kept."""
    norms = held_out.select(norm(held_text).alias("__n")).where("__n <> ''").distinct()
    tagged = candidates.withColumn("__n", F.coalesce(norm(text), F.lit("")))
    return tagged.join(norms, "__n", "left_anti").drop("__n")


def unquoted(c: Column) -> Column:
    """Without white space and quotation marks at both ends."""
    return F.regexp_replace(c, r"""^[\s"']+|[\s"']+$""", "")


def admissible_question(c: Column, least: int = QUESTION_LEAST) -> Column:
    """Long enough once unquoted (D11); false for null."""
    return F.length(unquoted(F.coalesce(c, F.lit("")))) >= least


def passage(c: Column, least: int = PASSAGE_LEAST, shown: int = PASSAGE_SHOWN) -> Column:
    """The head of a text that is long enough to quote from, null for others."""
    return F.when(F.length(c) >= least, F.substring(c, 1, shown))


def select_skills(skills: DataFrame, datasets: list[str] | None = None, names: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    """Skills of some datasets, names or a prefix, all conditions together; an unknown name is an error."""
    out = skills
    if names is not None:
        known = {r[0] for r in skills.where(F.col("skill_id").isin(names)).select("skill_id").distinct().collect()}  # at most the names asked for
        if missing := [n for n in dict.fromkeys(names) if n not in known]:
            raise ValueError(f"unknown skills: {', '.join(missing)}")
        out = out.where(F.col("skill_id").isin(names))
    if datasets is not None:
        out = out.where(F.regexp_replace("skill_id", "_[^_]*$", "").isin(datasets))
    return out if prefix is None else out.where(F.col("skill_id").startswith(prefix))


def check_paths(inputs: list[str], outputs: list[str], roots: list[str], forbidden: str = "bench") -> None:
    """Refuses inputs derived from the benchmark and outputs outside of the shared roots."""
    for p in inputs:
        if forbidden in p.rstrip("/").rsplit("/", 1)[-1]:
            raise ValueError(f"{p} is made from test material")
    for p in outputs:
        if ".." in p.split("/") or not any(p == r.rstrip("/") or p.startswith(r.rstrip("/") + "/") for r in roots):
            raise ValueError(f"{p} lies outside of {', '.join(roots)}")


def artifact_path(root: str, dataset: str, stage: str, name: str) -> str:
    """Where an artifact of a stage lies, in the partitioned layout that prunes by dataset and stage."""
    return f"{root.rstrip('/')}/dataset={dataset}/stage={stage}/{name}"


def first_value(df: DataFrame, order: str) -> tuple[str, str | None] | None:
    """The first column that is no id or index, and its value in the first row; null without such a column."""
    names = [c for c in df.columns if c.lower() not in ("id", "_id", "index") and len(c) > 1 and c != order]
    if not names:
        return None
    row = df.orderBy(order).select(F.col(names[0]).cast("string")).limit(1).collect()
    return names[0], row[0][0] if row else None


def missing_demos(mentioned: Column, shown: Column, loaders: dict[str, str]) -> Column:
    """Tools mentioned without a demonstration, in order, each loader before the first tool that needs it."""
    lack = F.array_except(mentioned, shown)
    need = F.create_map(*(F.lit(x) for kv in loaders.items() for x in kv)) if loaders else F.create_map().cast("map<string,string>")
    pairs = F.flatten(F.transform(lack, lambda t: F.filter(F.array(F.try_element_at(need, t), t), lambda x: x.isNotNull())))
    return F.array_distinct(F.filter(pairs, lambda x: ~F.array_contains(shown, x)))


def parse_options(items: list[str]) -> dict[str, object]:
    """KEY=VALUE items as nested options by dotted keys; values as JSON, else as text."""
    out: dict[str, object] = {}
    for item in items:
        m = re.fullmatch(r"([\w.-]+)=(.*)", item, re.S)
        if not m:
            raise ValueError(f"{item!r} is not of the form key=value")
        *path, last = m.group(1).split(".")
        try:
            value = json.loads(m.group(2))
        except ValueError:
            value = m.group(2)
        at = out
        for k in path:
            at = at.setdefault(k, {})
        at[last] = value
    return out


def ordered(rows: DataFrame, position: str) -> DataFrame:
    """Rows in the order of publication, a range-partitioned sort."""
    return rows.orderBy(position)
