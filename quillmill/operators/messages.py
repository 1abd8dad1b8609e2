"""Chat samples: export, skill blocks, last turns and per-turn samples (survey A21, B15, F24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.strings import without_skills

MESSAGE = "array<struct<role: string, content: string>>"


def message(role: str, content: Column) -> Column:
    """struct(role, content)."""
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_lines(samples: DataFrame, system: str, messages: str, strip_skills: bool = False) -> DataFrame:
    """(value): one JSON line {"messages": [...]} a sample, the system message first if there is one."""
    m = F.col(messages)
    if strip_skills:
        m = F.transform(m, lambda x: F.struct(x["role"].alias("role"), F.when(x["role"] == "user", without_skills(x["content"])).otherwise(x["content"]).alias("content")))
    head = F.when(F.coalesce(system, F.lit("")) != "", F.array(message("system", F.col(system)))).otherwise(F.array().cast(MESSAGE))
    return samples.select(F.to_json(F.struct(F.concat(head, m).alias("messages"))).alias("value"))


def last_assistant(messages: Column) -> Column:
    """The content of the last assistant message, the one that training counts; null without one."""
    own = F.filter(messages, lambda x: x["role"] == "assistant")
    return F.try_element_at(own, F.lit(-1))["content"]


def per_turn(samples: DataFrame, messages: str) -> DataFrame:
    """One row for each assistant message: the messages up to it (turn, context)."""
    e = samples.withColumn("__m", F.col(messages)).select("*", F.posexplode("__m").alias("__p", "__x")).where(F.col("__x.role") == "assistant")
    return e.withColumn("turn", F.col("__p") + 1).withColumn("context", F.slice("__m", F.lit(1), F.col("__p") + 1)).drop("__m", "__p", "__x")


def steps_to_messages(question: Column, reply: Column) -> Column:
    """A reply in steps as alternating messages: the question, then thoughts and actions, observations as user."""
    parts = F.split(reply, r"\n(?=Observation \d+:|Thought \d+:)")
    turns = F.transform(parts, lambda p: F.when(p.startswith("Observation"), message("user", p)).otherwise(message("assistant", p)))
    return F.concat(F.array(message("user", F.coalesce(question, F.lit("")))), turns)
