"""Orders by a keyed hash, and ranks within a key without sending a key to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int | str, *parts: Column) -> Column:
    """A hex string whose order is random but the same on any cluster: SHA-256 of seed and parts."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *parts), 256)


def hash_pick(size: Column, *parts: Column) -> Column:
    """A 0-based place below ``size``, the same for the same parts."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("bigint"), size.cast("bigint"))


def rank_within(df: DataFrame, key: str, order: str, bucket: Column, rank_col: str = "rank") -> DataFrame:
    """Adds the 0-based rank of each row among the rows of its ``key``, in the order (bucket, order).

    A key may hold any share of all rows: its rows are ranked inside (key, bucket) and moved up by the sizes of
    the buckets before. ``order`` must tell the rows of a key apart. Null is a key of its own.
    """
    part = df.withColumn("__b", bucket)
    sizes = part.groupBy(key, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(key).alias("__k"), F.col("__b").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__at"))
    inner = F.row_number().over(Window.partitionBy(key, "__b").orderBy(order)) - 1
    ranked = part.withColumn("__i", inner)
    joined = ranked.join(starts, (ranked["__b"] == starts["__s"]) & ranked[key].eqNullSafe(starts["__k"]))
    return joined.withColumn(rank_col, F.col("__i") + F.col("__at")).drop("__b", "__s", "__k", "__i", "__at")


def hash_rank(df: DataFrame, key: Column | None, seed: int | str, *parts: Column, rank_col: str = "rank") -> DataFrame:
    """Adds the 1-based rank of each row in hash order, within ``key`` or over all rows.

    The first two hex digits are the bucket, so the 256 buckets of a key follow the order itself and the rank is
    that of one sort over the whole key.
    """
    tagged = df.withColumn("__key", F.lit(0) if key is None else key).withColumn("__o", hash_order(seed, *parts))
    return rank_within(tagged, "__key", "__o", F.substring("__o", 1, 2), rank_col).withColumn(rank_col, F.col(rank_col) + 1).drop("__key", "__o")
