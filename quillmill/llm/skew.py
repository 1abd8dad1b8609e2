"""Joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 100_000  #: a key with more rows is joined apart


def join_hot(left: DataFrame, left_key: str, right: DataFrame, right_key: str, size: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The inner join of ``left`` with ``right``, which has one row a key and in ``size`` how many rows of left have it.

    Keys of more than ``hot_rows`` rows are at most rows / hot_rows many; they are broadcast, so that none of their
    rows moves. All others are joined by a shuffle. The right key's column is dropped.
    """
    r = right.withColumnRenamed(right_key, "__key")
    hot, rest = r.where(F.col(size) > hot_rows), r.where(F.col(size) <= hot_rows)
    on = F.col(left_key) == F.col("__key")
    few = F.broadcast(hot.select("__key"))
    out = left.join(F.broadcast(hot), on).unionByName(left.join(few, on, "left_anti").join(rest, on))
    return out.drop("__key", size)
