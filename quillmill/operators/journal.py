"""Append-only journals, resumption and completion (survey sections F4, D6, E15, E16, M)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_INK = r"[^\s\p{Z}]"  # anything but white space


def latest_attempt(journal: DataFrame, key: str, attempt: str, line: str, statuses: list[str], status: str = "status") -> DataFrame:
    """The row of the highest attempt of each key, the later line among equals.

    Rows of an unknown status or an attempt below 1 are malformed and don't count. A hot key is aggregated in
    every task before it moves, since only the largest (attempt, line) is kept.
    """
    good = journal.where(F.col(status).isin(statuses) & (F.col(attempt) >= 1))
    row = F.struct(*(c for c in good.columns if c != key))
    best = good.groupBy(key).agg(F.max_by(row, F.struct(F.col(attempt), F.col(line))).alias("__row"))
    return best.select(key, "__row.*")


def resume(rows: DataFrame, key: str, line: str, ok: Column) -> DataFrame:
    """First kept row of each key before the first malformed line; retryable failures are dropped (M1).

    ``ok`` is true for a good row, false for a failure to try again, null for a malformed line; a malformed last
    line is a partial write and hides nothing before it.
    """
    tagged = rows.withColumn("__ok", ok)
    first_bad = tagged.where("__ok is null").agg(F.min(line).alias("__bad"))
    kept = tagged.join(F.broadcast(first_bad)).where(F.col("__ok") & (F.col("__bad").isNull() | (F.col(line) < F.col("__bad"))))  # one row
    best = kept.groupBy(key).agg(F.min_by(F.struct(*(c for c in rows.columns if c != key)), line).alias("__row"))
    return best.select(key, "__row.*")


def pending(tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Tasks without a finished row."""
    return tasks.join(done.select(key), key, "left_anti")


def recent(rows: DataFrame, key: str, order: str, text: str, n: int) -> DataFrame:
    """(key, recent): the last n texts of each key, the newest last (M5)."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    last = rows.withColumn("__r", r).where(F.col("__r") <= n)
    lists = last.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("l"))
    return lists.select(key, F.transform("l", lambda x: x["t"]).alias("recent"))


def usable(answer: Column, error: Column, finish: Column) -> Column:
    """An answer without error that ended by itself."""
    return F.coalesce(answer, F.lit("")).rlike(_INK) & (F.coalesce(error, F.lit("")) == "") & (finish == "stop")


def retryable(answer: Column, error: Column) -> Column:
    """Missing, empty or failed; an answer cut off at its limit is final, not usable and not to be tried again."""
    return ~F.coalesce(answer, F.lit("")).rlike(_INK) | (F.coalesce(error, F.lit("")) != "")


def completeness(assigned: DataFrame, answers: DataFrame, key: str, group: str, answer: str, error: str, finish: str) -> DataFrame:
    """(group, assigned, usable, retryable, complete) of the assigned rows joined with their answers."""
    a = answers.select(F.col(key).alias("__k"), F.col(answer).alias("__a"), F.col(error).alias("__e"), F.col(finish).alias("__f"))
    j = assigned.join(a, F.col(key) == F.col("__k"), "left")
    again = retryable(F.col("__a"), F.col("__e"))
    return j.groupBy(group).agg(
        F.count(F.lit(1)).alias("assigned"),
        F.count(F.when(usable(F.col("__a"), F.col("__e"), F.coalesce("__f", F.lit(""))), 1)).alias("usable"),
        F.count(F.when(again, 1)).alias("retryable"),
        (~F.bool_or(again)).alias("complete"),
    )


def next_round(accepted: DataFrame, targets: DataFrame, key: str, rate: float) -> DataFrame:
    """(key, missing, ask): what a key lacks to its target, and how many to ask for at an acceptance rate."""
    have = accepted.groupBy(key).agg(F.count(F.lit(1)).alias("__have"))
    j = targets.join(have, key, "left")
    missing = F.greatest(F.lit(0), F.col("target") - F.coalesce("__have", F.lit(0)))
    return j.select(key, missing.cast("bigint").alias("missing"), F.ceil(missing / F.lit(rate)).cast("bigint").alias("ask"))


def drop_stale(rows: DataFrame, assignment: DataFrame, key: str, shard: str) -> DataFrame:
    """Rows whose shard is still the one that the assignment gives their key (M6)."""
    return rows.join(assignment.select(key, shard).distinct(), [key, shard], "left_semi")
