"""Filling containers of a fixed capacity: a plan over the histogram of lengths, then slots by rank.

Best-fit decreasing needs only how many items each length has. The plan is made on the histogram, which has
at most ``capacity`` entries however many items there are; every planned run says "the items of length L and
rank r0 .. r0+n-1 go to containers c0 .. c0+n-1". Items then take their slots by joining on (length, rank).
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.operators.ranking import rank_within

RUNS = "size bigint, first_rank bigint, n bigint, first_container bigint"
BUCKET_ROWS = 50_000  #: aimed number of items in a bucket when ranking inside a length


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best-fit decreasing over counts: runs (size, first rank, items, first container), and containers used.

    Lengths from long to short; each item goes to the fullest container that still takes it, else opens one.
    Containers of equal room are held as ranges, so a step places a whole run of items at once.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    rooms: list[int] = []  # distinct rooms left, ascending
    held: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> heap of ranges (first, n)
    runs: list[tuple[int, int, int, int]] = []
    used = 0

    def put(room: int, first: int, n: int) -> None:
        if room <= 0 or n <= 0:
            return
        if not held[room]:
            insort(rooms, room)
        heapq.heappush(held[room], (first, n))

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        if not 0 < size <= capacity:
            raise ValueError("lengths must lie between 1 and the capacity")
        while left:
            i = bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                first, n = heapq.heappop(held[room])
                if not held[room]:
                    rooms.pop(i)
            else:
                # new containers, filled one after the other: full ones alike, the last with the rest
                each = capacity // size
                full, rest = divmod(left, each)
                for first, n, items in ((used, full, each), (used + full, 1, rest)):
                    if n and items:
                        for _ in range(items):
                            runs.append((size, rank, n, first))
                            rank += n
                        put(capacity - items * size, first, n)
                used += full + (rest > 0)
                break
            take = min(n, left)
            runs.append((size, rank, take, first))
            rank, left = rank + take, left - take
            put(room - size, first, take)
            put(room, first + take, n - take)
    return runs, used


def pieces(sizes: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(id, piece, begin, size): items of at most the capacity as one piece, larger ones cut in full pieces.

    Items of size 0 or null take no room and give no piece.
    """
    size = F.col(size_col).cast("bigint")
    n = F.ceil(size / F.lit(capacity)).cast("bigint")
    cut = sizes.where(size > 0).select(F.col(id_col), size.alias("__s"), F.posexplode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("piece", "__i"))
    begin = F.col("__i") * F.lit(capacity)
    return cut.select(id_col, "piece", begin.alias("begin"), F.least(F.lit(capacity).cast("bigint"), F.col("__s") - begin).alias("size"))


def pack(sizes: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(container, id, piece, begin, size): where each item or piece goes; no container exceeds the capacity.

    ``sizes`` must be cheap to read twice (a written table); its ids are unique. Only items larger than the
    capacity are cut. Items without size have no row. An empty input gives no row.
    """
    spark = sizes.sparkSession
    parts = pieces(sizes, id_col, size_col, capacity)
    # At most `capacity` rows reach the driver.
    histogram = {r["size"]: r["n"] for r in parts.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan(histogram, capacity)
    planned = spark.createDataFrame(runs, RUNS) if runs else spark.createDataFrame([], RUNS)
    buckets = max(1, max(histogram.values(), default=0) // BUCKET_ROWS)
    keyed = parts.withColumn("__o", F.struct(id_col, "piece"))
    ranked = rank_within(keyed, "size", "__o", F.pmod(F.xxhash64("__o"), F.lit(buckets)).cast("int")).drop("__o")
    p = planned.withColumnRenamed("size", "__size")
    slot = ranked.join(p, (ranked["size"] == p["__size"]) & (ranked["rank"] >= p["first_rank"]) & (ranked["rank"] < p["first_rank"] + p["n"]))
    container = F.col("first_container") + F.col("rank") - F.col("first_rank")
    return slot.select(container.alias("container"), id_col, "piece", "begin", "size")


def split_items(packed: DataFrame, id_col: str) -> DataFrame:
    """Ids of the items that the packing cut into more than one piece."""
    return packed.where(F.col("piece") > 0).select(id_col).distinct()
