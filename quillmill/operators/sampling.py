"""Deterministic splits, shards, samples and quotas (survey section I); every random choice is a hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.operators.ranking import hash_order, hash_pick, hash_rank


def train_val_split(rows: DataFrame, key: Column, id_col: str, seed: int, n_train: int, offset: int, n_val: int) -> DataFrame:
    """Adds part: the first n_train rows of a key in hash order train, rows offset+1 .. offset+n_val val.

    Larger training budgets contain smaller ones; the validation rows don't move with the budget. A row in
    neither part has a null part.
    """
    if offset < n_train:
        raise ValueError("the validation window must lie behind the training rows")
    r = F.col("rank")
    ranked = hash_rank(rows, key, seed, F.col(id_col))
    return ranked.withColumn("part", F.when(r <= n_train, "train").when((r > offset) & (r <= offset + n_val), "val")).drop("rank")


def stratified_dev(rows: DataFrame, key: Column, id_col: str, seed: int, ratio: float) -> DataFrame:
    """Adds dev: in each stratum the first max(1, n * ratio, rounded half to even) rows in hash order."""
    tagged = rows.withColumn("__stratum", key)
    n = tagged.groupBy(F.col("__stratum").alias("__s")).agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * ratio)).cast("bigint").alias("__dev"))
    ranked = hash_rank(tagged, F.col("__stratum"), seed, F.col(id_col))
    joined = ranked.join(n, F.col("__stratum").eqNullSafe(F.col("__s")))
    return joined.withColumn("dev", F.col("rank") <= F.col("__dev")).drop("__stratum", "__s", "__dev", "rank")


def hard_negative(ranked: DataFrame, gold: DataFrame, seed: int) -> DataFrame:
    """(query_id, negative_id): one of the ranked items that are not gold, by hash; none if all are gold."""
    pool = ranked.join(gold.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti").groupBy("query_id")
    lists = pool.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias("l"))
    return lists.select("query_id", F.get("l", hash_pick(F.size("l"), F.lit(str(seed)), F.col("query_id")).cast("int")).alias("negative_id"))


def stride_shard(rows: DataFrame, id_col: str, seed: int, n: int) -> DataFrame:
    """Adds shard: hash ranks dealt out to n shards in turn, so sizes differ by one at most."""
    return hash_rank(rows, None, seed, F.col(id_col)).withColumn("shard", F.pmod(F.col("rank") - 1, F.lit(n))).drop("rank")


def waves(rows: DataFrame, id_col: str, seed: int, size: int) -> DataFrame:
    """Adds wave: hash ranks in runs of ``size``."""
    return hash_rank(rows, None, seed, F.col(id_col)).withColumn("wave", F.floor((F.col("rank") - 1) / size)).drop("rank")


def balanced_shards(sizes: dict[str, int], singles: list[str], n: int) -> dict[str, int]:
    """Groups, largest first, to the least loaded shard, then single rows one by one (I8).

    The groups are adapters of a catalog, a few hundred names with their row counts, not rows of data.
    """
    load = [0] * n
    out = {}
    for name, size in [*sorted(sizes.items(), key=lambda x: (-x[1], x[0])), *((s, 1) for s in sorted(singles))]:
        k = min(range(n), key=lambda i: (load[i], i))
        out[name] = k
        load[k] += size
    return out


def epoch_order(rows: DataFrame, id_col: str, gold: Column, seed: int, epoch: int, batch: int) -> DataFrame:
    """Adds (position, positive): hash order of the epoch and its gold item in turn; the last batch wraps.

    Rows that fill up the last batch come from the front of the order again, so they have two rows.
    """
    ranked = hash_rank(rows, None, seed + epoch, F.col(id_col)).withColumn("positive", F.get(gold, F.pmod(F.lit(epoch - 1), F.size(gold))))
    total = rows.agg(F.count(F.lit(1)).alias("__n"))
    joined = ranked.join(F.broadcast(total))  # one row
    missing = F.pmod(-F.col("__n"), F.lit(batch))
    again = joined.where(F.col("rank") <= missing).withColumn("rank", F.col("rank") + F.col("__n"))
    return joined.unionByName(again).withColumnRenamed("rank", "position").drop("__n")


def first_n(rows: DataFrame, key: Column, order: str, n: int) -> DataFrame:
    """The first n rows of each key by ``order`` (I11); a hot key sends n rows a task at most."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("__r", r).where(F.col("__r") <= n).drop("__r")


def quota(rows: DataFrame, key: str, kind: str, rank: str, near: int, offset: int, random: int) -> DataFrame:
    """near[:near] and random[offset:offset+random] of one ordered list."""
    r = F.col(rank)
    return rows.where(((F.col(kind) == "near") & (r <= near)) | ((F.col(kind) == "random") & (r > offset) & (r <= offset + random)))


def sample_n(rows: DataFrame, id_col: str, seed: int, n: int) -> DataFrame:
    """n rows by hash, a stable sample."""
    return rows.withColumn("__o", hash_order(seed, F.col(id_col))).orderBy("__o").limit(n).drop("__o")


def shuffled(items: Column, key: Column) -> Column:
    """The elements of an array of strings in the hash order of (key, element)."""
    return F.transform(F.sort_array(F.transform(items, lambda x: F.struct(F.md5(F.concat(key, x)).alias("o"), x.alias("x")))), lambda s: s["x"])


def difficulty(rows: DataFrame, key: Column, id_col: str, seed: int) -> DataFrame:
    """Adds level: about 30 % easy, 40 % medium, 30 % hard of each key, in hash order.

    One row is medium, two are easy and hard; shares are rounded half to even and none is empty.
    """
    tagged = rows.withColumn("__group", key)
    n = F.col("__n")
    third = F.greatest(F.lit(1), F.bround(n * 0.3)).cast("bigint")
    easy = F.when(n == 1, 0).when((n - 2 * third < 1) & (third > 1), third - 1).otherwise(third)
    medium = F.when(n == 1, 1).when(n == 2, 0).otherwise(F.greatest(F.lit(1), n - 2 * third))
    plan = tagged.groupBy(F.col("__group").alias("__k")).agg(F.count(F.lit(1)).alias("__n")).select("__k", easy.alias("__easy"), medium.alias("__medium"))
    joined = hash_rank(tagged, F.col("__group"), seed, F.col(id_col)).join(plan, F.col("__group").eqNullSafe(F.col("__k")))
    level = F.when(F.col("rank") <= F.col("__easy"), "easy").when(F.col("rank") <= F.col("__easy") + F.col("__medium"), "medium").otherwise("hard")
    return joined.withColumn("level", level).drop("__group", "__k", "__easy", "__medium", "rank")


def median_pick(rows: DataFrame, key: str, size: str, id_col: str, cap: int, take: int = 2) -> DataFrame:
    """(key, rank, id): the rows around the median size, from place (n - 2) // 2 on, over-long ones skipped (F16)."""
    w = Window.partitionBy(key).orderBy(size, id_col)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    placed = rows.withColumn("__r", F.row_number().over(w) - 1).withColumn("__n", n)
    start = F.greatest(F.lit(0), F.floor((F.col("__n") - 2) / 2))
    late = placed.where((F.col("__r") >= start) & (F.col(size) <= cap))
    return late.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= take).select(key, "rank", id_col)


def anchors(ranked: DataFrame, gold: DataFrame, skills: DataFrame, n_near: int, n_random: int, oversample: float, seed: int) -> DataFrame:
    """(skill_id, kind, rank, query_id): near misses and random negatives of each skill.

    ``ranked`` holds (query_id, rank, item_id), ``gold`` (query_id, item_id). Near: queries that rank the skill
    first but don't have it as gold, then those that rank it lower, in hash order, up to n_near * oversample.
    Random: queries that neither rank nor have it, taken in hash order from a place of the skill's own, so that
    skills are never crossed with the pool: a skill looks at as many places as it needs even if all its ranked
    and gold queries lay there.
    """
    queries = gold.select("query_id").unionByName(ranked.select("query_id")).distinct()
    own = gold.select("query_id", F.col("item_id").alias("skill_id")).where("item_id is not null").distinct()
    hits = ranked.select("query_id", F.col("item_id").alias("skill_id"), "rank").join(own, ["query_id", "skill_id"], "left_anti")
    want = -int(-n_near * oversample // 1)
    w = Window.partitionBy("skill_id").orderBy(F.when(F.col("rank") == 1, 0).otherwise(1), hash_order(seed, F.col("skill_id"), F.col("query_id")))
    near = hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= want).select("skill_id", F.lit("near").alias("kind"), F.col("r").alias("rank"), "query_id")
    placed = hash_rank(queries, None, seed, F.col("query_id"), rank_col="place")
    taken = ranked.select("query_id", F.col("item_id").alias("skill_id")).unionByName(own).distinct()
    used = taken.groupBy("skill_id").agg(F.count(F.lit(1)).alias("used"))
    total = queries.agg(F.count(F.lit(1)).alias("n"))
    start = F.conv(F.substring(hash_order(seed, F.col("skill_id")), 1, 8), 16, 10).cast("bigint")
    need = F.least(F.col("n"), F.lit(n_random) + F.coalesce("used", F.lit(0)))
    looks = skills.select("skill_id").distinct().join(used, "skill_id", "left").join(F.broadcast(total)).where("n > 0")  # one row
    looks = looks.select("skill_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), need - 1)).alias("i"), start.alias("start"))
    looks = looks.select("skill_id", "i", (F.pmod(F.col("start") + F.col("i"), F.col("n")) + 1).alias("place"))
    free = looks.join(placed, "place").join(taken, ["skill_id", "query_id"], "left_anti")
    v = Window.partitionBy("skill_id").orderBy("i")
    random = free.withColumn("r", F.row_number().over(v)).where(F.col("r") <= n_random).select("skill_id", F.lit("random").alias("kind"), F.col("r").alias("rank"), "query_id")
    return near.unionByName(random)


def mismatch_routes(instances: DataFrame, skills: DataFrame, seed: int) -> DataFrame:
    """(query_id, route): a skill of the same dataset that is not gold, the first in hash order.

    ``instances`` holds (query_id, dataset, gold array), ``skills`` (skill_id, dataset), a fixed catalog.
    """
    j = instances.join(skills, "dataset").where(~F.array_contains(F.coalesce("gold", F.array().cast("array<string>")), F.col("skill_id")))
    return j.groupBy("query_id").agg(F.min_by("skill_id", hash_order(seed, F.col("query_id"), F.col("skill_id"))).alias("route"))
