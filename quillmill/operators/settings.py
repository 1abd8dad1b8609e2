"""Scoped settings, experiment grids and completion (survey section O)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scopes from weak to strong; a stronger one wins.
SCOPES = ("protocol", "defaults", "model", "dataset", "skill", "flags")


def resolve(settings: DataFrame, targets: DataFrame) -> DataFrame:
    """(model, dataset, skill_id, key, value): the strongest setting that applies to each target (O1).

    ``settings`` holds (scope, name, key, value); name is the model, dataset or skill that a scope is for, null for
    the others. ``targets`` holds (model, dataset, skill_id). Settings are a configuration, joined scope by scope.
    """
    strength = F.element_at(F.create_map(*(x for i, s in enumerate(SCOPES) for x in (F.lit(s), F.lit(i)))), F.col("scope"))
    s = settings.withColumn("strength", strength)
    general = s.where(F.col("scope").isin("protocol", "defaults", "flags")).select("key", "value", "strength")
    parts = targets.join(F.broadcast(general))  # a few rows of configuration, not data
    for scope, column in (("model", "model"), ("dataset", "dataset"), ("skill", "skill_id")):
        own = s.where(F.col("scope") == scope).select(F.col("name").alias(column), "key", "value", "strength")
        parts = parts.unionByName(targets.join(own, column))
    return parts.groupBy("model", "dataset", "skill_id", "key").agg(F.max_by("value", "strength").alias("value"))


def grid(datasets: list[str], providers: list[str], engines: list[str], override: dict[str, str], spark) -> DataFrame:
    """(dataset, method, provider, engine): the cells of an experiment, a dataset's own engine in place of the rest."""
    cells = {(d, f"{p}+{override.get(d, e)}", p, override.get(d, e)) for d in datasets for p in providers for e in engines}
    return spark.createDataFrame(sorted(cells), "dataset string, method string, provider string, engine string")


def open_jobs(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """(job_id, content_hash, state): new, or stale if finished with other content; finished ones are left out."""
    d = done.select("job_id", F.col("content_hash").alias("__h")).distinct()
    j = jobs.join(d, "job_id", "left").where(F.col("__h").isNull() | (F.col("__h") != F.col("content_hash")))
    return j.select("job_id", "content_hash", F.when(F.col("__h").isNull(), "new").otherwise("stale").alias("state"))


def profile_of(methods: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds profile: that of the first suffix rule that fits the method, else the method itself."""
    chain = F.lit(None).cast("string")
    for suffix, profile in rules:
        chain = F.coalesce(chain, F.when(F.col("method").endswith(suffix), profile))
    return methods.withColumn("profile", F.coalesce(chain, F.col("method")))


# Most tokens a reply may have, by stage and dataset.
TOKEN_LIMITS = {
    ("generate", "theoremqa"): 10240,
    ("generate", "medcalcbench"): 8192,
    ("generate", "logicbench"): 8192,
    ("generate", "toolqa"): 6144,
    ("infer", "theoremqa"): 10240,
    ("infer", "medcalcbench"): 8192,
    ("infer", "logicbench"): 8192,
    ("infer", "toolqa"): 16384,
}


def token_limits(spark) -> DataFrame:
    """(stage, dataset, max_tokens)."""
    return spark.createDataFrame([(s, d, n) for (s, d), n in sorted(TOKEN_LIMITS.items())], "stage string, dataset string, max_tokens bigint")
