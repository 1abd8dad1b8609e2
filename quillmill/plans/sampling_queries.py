"""Queries of splits, shards, samples and quotas (survey section I)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import retrieval as R
from quillmill.operators import sampling as P
from quillmill.plans.registry import core
from quillmill.plans.retrieval_queries import POOL, SKILLS, _skills, bm25_sql, counts_sql
from quillmill.session import cut, table

T = "t as (select distinct instance_id, gold_skill_ids[1] as skill, gold_skill_ids as gold, dataset, question from synthetic_task)"


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "synthetic_task")
    return t.select("instance_id", F.get("gold_skill_ids", F.lit(0)).alias("skill"), F.col("gold_skill_ids").alias("gold"), "dataset", "question").distinct()


def h(*parts: str, seed: str = "7") -> str:
    """Hash order in SQL."""
    return f"sha256('{seed}|' || " + " || '|' || ".join(parts) + ")"


@core.query(
    "train_val_split",
    f"with {T}, r as (select instance_id, skill, row_number() over (partition by skill order by {h('instance_id')}) as r from t) select instance_id, case when r <= 8 then 'train' when r > 20 and r <= 24 then 'val' end as part from r",
)
def train_val_split(spark: SparkSession, d: str) -> DataFrame:
    """I1 of the tasks of each skill."""
    return P.train_val_split(_tasks(spark, d), F.col("skill"), "instance_id", 7, 8, 20, 4).select("instance_id", "part")


@core.query(
    "dev_split",
    f"with {T}, r as (select instance_id, row_number() over (partition by skill order by {h('instance_id')}) as r, count(*) over (partition by skill) as n from t) select instance_id, r <= greatest(1, round_even(n * 0.1, 0)) as dev from r",
)
def dev_split(spark: SparkSession, d: str) -> DataFrame:
    """I2, skills as strata."""
    return P.stratified_dev(_tasks(spark, d), F.col("skill"), "instance_id", 7, 0.1).select("instance_id", "dev")


POOL_GOLD = "g as (select distinct instance_id as query_id, unnest(gold_skill_ids) as item_id from synthetic_task)"


def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pool = table(spark, d, "synthetic_task").select(F.col("instance_id").alias("query_id"), F.col("question").alias("text")).distinct()
    gold = table(spark, d, "synthetic_task").select(F.col("instance_id").alias("query_id"), F.explode("gold_skill_ids").alias("item_id")).distinct()
    return cut(R.catalog_top_k(pool, _skills(spark, d), "query_id", "text", "item_id", "text", 5), "pool-ranking"), gold


@core.query(
    "hard_negatives",
    f"""with {POOL}, {SKILLS}, {POOL_GOLD}, {counts_sql()}, {bm25_sql(5)},
    l as (select query_id, list(item_id order by rank) as l from bm25 b where not exists (select 1 from g where g.query_id = b.query_id and g.item_id = b.item_id) group by 1)
    select query_id, l[cast(cast('0x' || substr(sha256('7|' || query_id), 1, 8) as bigint) % len(l) as bigint) + 1] as negative_id from l""",
)
def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """I3."""
    ranked, gold = _ranked(spark, d)
    return P.hard_negative(ranked, gold, 7)


@core.query(
    "anchor_assign",
    f"""with {POOL}, {SKILLS}, {POOL_GOLD}, {counts_sql()}, {bm25_sql(5)},
    own as (select query_id, item_id as skill_id from g where item_id is not null),
    hits as (select query_id, item_id as skill_id, rank from bm25 b where not exists (select 1 from own o where o.query_id = b.query_id and o.skill_id = b.item_id)),
    near as (select skill_id, 'near' as kind, row_number() over (partition by skill_id order by case when rank = 1 then 0 else 1 end, {h('skill_id', 'query_id')}) as rank, query_id from hits qualify rank() over (partition by skill_id order by case when hits.rank = 1 then 0 else 1 end, {h('skill_id', 'query_id')}) <= 6),
    qs as (select query_id from g union select query_id from bm25),
    pl as (select query_id, row_number() over (order by {h('query_id')}) as place, count(*) over () as n from qs),
    taken as (select query_id, item_id as skill_id from bm25 union select query_id, skill_id from own),
    starts as (select distinct skill_id, cast('0x' || substr({h('skill_id')}, 1, 8) as bigint) as start from skill_corpus),
    fr as (select skill_id, query_id, (place - 1 - start % n + n) % n as i from starts st, pl where not exists (select 1 from taken t where t.skill_id = st.skill_id and t.query_id = pl.query_id)),
    rnd as (select skill_id, 'random' as kind, row_number() over (partition by skill_id order by i) as rank, query_id from fr qualify row_number() over (partition by skill_id order by i) <= 4)
    select skill_id, kind, rank, query_id from near union all select skill_id, kind, rank, query_id from rnd""",
)
def anchor_assign(spark: SparkSession, d: str) -> DataFrame:
    """Four near misses (half as many again in reserve) and four random negatives a skill."""
    ranked, gold = _ranked(spark, d)
    a = P.anchors(ranked, gold, table(spark, d, "skill_corpus"), 4, 4, 1.5, 7)
    return a.select("skill_id", "kind", F.col("rank").cast("bigint").alias("rank"), "query_id")


@core.query("stride_shards", f"with {T}, r as (select instance_id, row_number() over (order by {h('instance_id')}) as r from (select distinct instance_id from t)) select instance_id, (r - 1) % 4 as shard from r")
def stride_shards(spark: SparkSession, d: str) -> DataFrame:
    """I7 in four shards."""
    return P.stride_shard(_tasks(spark, d).select("instance_id").distinct(), "instance_id", 7, 4).select("instance_id", F.col("shard").cast("bigint").alias("shard"))


@core.query("waves", f"with {T}, r as (select instance_id, row_number() over (order by {h('instance_id')}) as r from (select distinct instance_id from t)) select instance_id, cast(floor((r - 1) / 100) as bigint) as wave from r")
def waves(spark: SparkSession, d: str) -> DataFrame:
    """I9 in runs of a hundred."""
    return P.waves(_tasks(spark, d).select("instance_id").distinct(), "instance_id", 7, 100).select("instance_id", "wave")


@core.query("affine_shards")
def affine_shards(spark: SparkSession, d: str) -> DataFrame:
    """I8: the gold skills of the test items over four shards; at most one row a skill reaches the driver."""
    rows = table(spark, d, "bench_instance").groupBy(F.get("skill_annotations", F.lit(0)).alias("skill")).agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["skill"]: r["n"] for r in rows.collect() if r["skill"]}
    return spark.createDataFrame(sorted(P.balanced_shards(sizes, [], 4).items()), "skill string, shard int")


@core.query(
    "epoch_order",
    f"""with {T}, u as (select instance_id, any_value(gold) as gold from t where len(gold) > 0 group by 1), r as (select instance_id, gold, row_number() over (order by {h('instance_id', seed='9')}) as r, count(*) over () as n from u),
    w as (select instance_id, gold, r from r union all select instance_id, gold, r + n from r where r <= (64 - n % 64) % 64)
    select instance_id, r as position, gold[1 % len(gold) + 1] as positive from w""",
)
def epoch_order(spark: SparkSession, d: str) -> DataFrame:
    """The second epoch in batches of 64."""
    t = _tasks(spark, d).where(F.size("gold") > 0).select("instance_id", "gold").dropDuplicates(["instance_id"])
    return P.epoch_order(t, "instance_id", F.col("gold"), 7, 2, 64).select("instance_id", "position", "positive")


@core.query("domain_limit", f"with {T}, u as (select distinct instance_id, dataset from t) select instance_id, dataset from u qualify row_number() over (partition by dataset order by instance_id) <= 25")
def domain_limit(spark: SparkSession, d: str) -> DataFrame:
    """I11."""
    return P.first_n(_tasks(spark, d).select("instance_id", "dataset").distinct(), F.col("dataset"), "instance_id", 25)


@core.query(
    "sampled_tasks",
    f"with {T}, u as (select distinct instance_id from t) select instance_id from u order by {h('instance_id')} limit 50",
)
def sampled_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Fifty of all tasks."""
    t = _tasks(spark, d).select("instance_id").distinct()
    return P.sample_n(t, "instance_id", 7, 50)


@core.query(
    "shuffled_lists",
    "with e as (select instance_id, unnest(skill_annotations) as s from bench_instance) select instance_id, string_agg(s, ',' order by md5(instance_id || s), s) as skills from e group by 1",
)
def shuffled_lists(spark: SparkSession, d: str) -> DataFrame:
    """I5."""
    t = table(spark, d, "bench_instance").where(F.size("skill_annotations") > 0)
    return t.select("instance_id", F.array_join(P.shuffled(F.col("skill_annotations"), F.col("instance_id")), ",").alias("skills"))


@core.query(
    "difficulty_split",
    f"""with {T}, u as (select distinct instance_id, skill from t), r as (select instance_id, row_number() over (partition by skill order by {h('instance_id')}) as r, count(*) over (partition by skill) as n from u),
    p as (select *, cast(greatest(1, round_even(n * 0.3, 0)) as bigint) as k from r),
    q as (select *, case when n = 1 then 0 when n - 2 * k < 1 and k > 1 then k - 1 else k end as easy, case when n = 1 then 1 when n = 2 then 0 else greatest(1, n - 2 * k) end as medium from p)
    select instance_id, case when r <= easy then 'easy' when r <= easy + medium then 'medium' else 'hard' end as level from q""",
)
def difficulty_split(spark: SparkSession, d: str) -> DataFrame:
    """C23."""
    return P.difficulty(_tasks(spark, d).select("instance_id", "skill").distinct(), F.col("skill"), "instance_id", 7).select("instance_id", "level")


@core.query(
    "median_demos",
    """with u as (select distinct instance_id, dataset, length(question) as len from synthetic_task where question is not null and dataset is not null),
    p as (select *, row_number() over (partition by dataset order by len, instance_id) - 1 as r, count(*) over (partition by dataset) as n from u)
    select dataset, row_number() over (partition by dataset order by len, instance_id) as rank, instance_id from p where r >= greatest(0, floor((n - 2) / 2)) and len <= 400
    qualify row_number() over (partition by dataset order by len, instance_id) <= 2""",
)
def median_demos(spark: SparkSession, d: str) -> DataFrame:
    """F16: two questions of middling length a dataset."""
    u = table(spark, d, "synthetic_task").where("question is not null and dataset is not null").select("instance_id", "dataset", F.length("question").alias("len")).distinct()
    return P.median_pick(u, "dataset", "len", "instance_id", 400).select("dataset", F.col("rank").cast("bigint").alias("rank"), "instance_id")


@core.query(
    "mismatch_routes",
    f"""with s as (select skill_id, regexp_replace(skill_id, '_[^_]*$', '') as dataset from skill_corpus)
    select b.instance_id as query_id, min_by(s.skill_id, {h('b.instance_id', 's.skill_id')}) as route from bench_instance b join s using (dataset)
    where not coalesce(list_contains(b.skill_annotations, s.skill_id), false) group by 1""",
)
def mismatch_routes(spark: SparkSession, d: str) -> DataFrame:
    """I13."""
    inst = table(spark, d, "bench_instance").select(F.col("instance_id").alias("query_id"), "dataset", F.col("skill_annotations").alias("gold"))
    skills = table(spark, d, "skill_corpus").select("skill_id", F.regexp_replace("skill_id", "_[^_]*$", "").alias("dataset"))
    return P.mismatch_routes(inst, skills, 7)
