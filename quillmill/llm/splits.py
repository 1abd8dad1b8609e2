"""Splits that keep related records together: components of shared keys, then greedy assignment.

Records that share a skill or a source, directly or through others, form a group (distributed union-find over
the keys, see components). Groups go largest first to the split furthest below its target. The greedy order
depends only on sizes, so it is computed on the histogram of group sizes; groups then take their split by rank
within their size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.components import forests, merge_forests
from quillmill.llm.skew import join_hot
from quillmill.operators.ranking import rank_within
from quillmill.session import cut

_EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
SOURCE_ID = r"^task_[0-9a-f]{20}$"
BUCKET_ROWS = 50_000


def clean_ids(c: Column, pattern: str | None = None) -> Column:
    """Distinct trimmed, lower-cased elements; without null, blank and, given a pattern, other ones."""
    tidy = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.regexp_replace(x, _EDGE_SPACE, "")))
    good = F.filter(tidy, lambda x: x.isNotNull() & ((x != "") if pattern is None else x.rlike(pattern)))
    return F.array_distinct(good)


def key_hashes(skills: Column, sources: Column) -> Column:
    """64-bit node ids of a record's keys, sources first."""
    tag = lambda kind, c: F.transform(c, lambda x: F.xxhash64(F.lit(kind), x))
    return F.concat(tag("source", sources), tag("skill", skills))


def key_forests(records: DataFrame) -> DataFrame:
    """(node, root) of the local forests of the records' keys (column keys); the records need no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for b in batches:
                offsets = b.column(0).offsets.to_numpy().astype(np.int64)
                keys = b.column(0).values.to_numpy()[offsets[0] : offsets[-1]]
                n = np.diff(offsets)
                first = np.repeat(keys[(offsets[:-1] - offsets[0])[n > 0]], n[n > 0])
                yield first, keys  # a record's keys all hang on its first one

        yield from forests(edges())

    return records.select("keys").where(F.size("keys") > 0).mapInArrow(run, "node bigint, root bigint")


def groups(tasks: DataFrame, id_col: str, skills_col: str, sources_col: str) -> DataFrame:
    """(id, group_id): one row an id; group_id is the smallest skill of the group, else its smallest id.

    Null and empty arrays link nothing; a record without keys is a group of its own. Rows with a repeated id
    count once if equal; if they differ, all their keys count and are taken for linked only where they share
    one. A null id is left out. Extra columns are ignored.
    """
    skills, sources = clean_ids(F.col(skills_col)), clean_ids(F.col(sources_col), SOURCE_ID)
    base = tasks.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), skills.alias("skills"), sources.alias("sources"))
    records = cut(base.select("__id", F.array_min("skills").alias("skill"), key_hashes(F.col("skills"), F.col("sources")).alias("keys")).distinct(), "records")
    labels = merge_forests(key_forests(records), partitions=64)
    keyed = records.where(F.size("keys") > 0).select("__id", "skill", F.element_at("keys", 1).alias("__node"))
    rooted = cut(keyed.join(labels, keyed["__node"] == labels["node"]).select("__id", "skill", "root"), "rooted")
    names = cut(rooted.groupBy("root").agg(F.coalesce(F.min("skill"), F.min("__id")).alias("group_id"), F.count(F.lit(1)).alias("__n")), "group-names")
    linked = join_hot(rooted, "root", names, "root", "__n").select("__id", "group_id")
    alone = records.where(F.size("keys") == 0).select("__id", F.col("__id").alias("group_id"))
    # an id delivered again with the same keys has one group; min makes the row unique in any case
    return linked.unionByName(alone).groupBy(F.col("__id").alias(id_col)).agg(F.min("group_id").alias("group_id"))


def greedy_counts(histogram: dict[int, int], shares: dict[str, float]) -> list[tuple[int, int, int, str]]:
    """Runs (size, first rank, groups, split) of greedy largest-first assignment over a histogram of sizes.

    Each group goes to the split whose target (share of all records) is furthest above what it holds; ties go to
    the larger share, then the smaller name. For equal sizes the greedy takes the largest values of d - i*size
    over the splits' deficits d, which a bisection finds without walking over the groups.
    """
    names = sorted(shares, key=lambda s: (-shares[s], s))
    exact = {s: Fraction(str(x)) for s, x in shares.items()}
    if not names or min(exact.values()) < 0 or not sum(exact.values()):
        raise ValueError("the shares must not be negative, and one of them positive")
    total = sum(s * c for s, c in histogram.items())
    targets = [exact[s] / sum(exact.values()) * total for s in names]
    unit = math.lcm(*(t.denominator for t in targets))  # whole numbers from here on, so ties are ties
    deficit = [int(t * unit) for t in targets]
    out = []
    for size in sorted(histogram, reverse=True):
        left, step = histogram[size], size * unit
        # the smallest bound above which there are no more values than groups left
        lo, hi = min(deficit) - step * (left + 1), max(deficit)
        above = lambda x: [(d - x - 1) // step + 1 if d > x else 0 for d in deficit]  # noqa: B023, E731
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if sum(above(mid)) <= left else (mid + 1, hi)
        taken = above(hi)
        for _ in range(left - sum(taken)):  # equal values, fewer than splits
            k = max(range(len(names)), key=lambda k: (deficit[k] - step * taken[k], -k))
            taken[k] += 1
        rank = 0
        for k, n in enumerate(taken):
            if n:
                out.append((size, rank, n, names[k]))
                rank += n
            deficit[k] -= step * n
    return out


def assign(members: DataFrame, id_col: str, shares: dict[str, float]) -> DataFrame:
    """(id, split) of grouped records (id, group_id): every group wholly in one split, near the shares.

    ``members`` is read three times, so it should be a written table. At most sqrt(2 N) rows, one for each
    distinct group size, reach the driver.
    """
    spark = members.sparkSession
    sizes = cut(members.groupBy("group_id").agg(F.count(F.lit(1)).alias("size")), "group-sizes")
    histogram = {r["size"]: r["n"] for r in sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = greedy_counts(histogram, shares) if histogram else []
    plan = spark.createDataFrame(runs, "__size bigint, first_rank bigint, n bigint, split string")
    buckets = max(1, max(histogram.values(), default=0) // BUCKET_ROWS)
    ranked = rank_within(sizes, "size", "group_id", F.pmod(F.xxhash64("group_id"), F.lit(buckets)).cast("int"))
    fits = (ranked["size"] == plan["__size"]) & (ranked["rank"] >= plan["first_rank"]) & (ranked["rank"] < plan["first_rank"] + plan["n"])
    placed = cut(ranked.join(plan, fits).select("group_id", "split", F.col("size").alias("__n")), "group-splits")
    return join_hot(members, "group_id", placed, "group_id", "__n").select(id_col, "split")
