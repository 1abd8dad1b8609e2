"""Queries of duplicates, decontamination and journals (survey sections D, F18, H and M)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.text import normalize_native
from quillmill.operators import dedup as D
from quillmill.operators import journal as J
from quillmill.operators.dedup import Norm
from quillmill.plans.registry import core
from quillmill.plans.sqltext import norm, words
from quillmill.session import table

T = "t as (select distinct instance_id, question, gold_skill_ids, dataset, lower(trim(split)) as split from synthetic_task where question is not null)"


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "synthetic_task").where("question is not null")
    return t.select("instance_id", "question", "gold_skill_ids", "dataset", F.lower(F.trim("split")).alias("split")).distinct()


def grams_sql(x: str, name: str, source: str, key: str) -> str:
    """CTE (id, n, g): hashed grams of a text."""
    w, flat, k = f"{name}_w", "array_to_string(w, '')", "least(8, greatest(3, length(array_to_string(w, ''))))"
    return f"""{w} as (select distinct {key} as id, {words(x)} as w from {source} where {norm(x)} <> ''),
    {name}_l as (select id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
      else list_distinct(list_transform(range(1, greatest(length({flat}) - {k} + 1, 1) + 1), lambda i: substr({flat}, i, {k}))) end as l from {w}),
    {name} as (select id, len(l) as n, unnest(l) as g from {name}_l)"""


def overlap_sql(a: str, b: str, t: float, name: str) -> str:
    """CTE (a, b, similarity) of near pairs of two gram CTEs."""
    return f"""{name}_c as (select x.id as a, y.id as b, any_value(x.n) as na, any_value(y.n) as nb, count(*) as c from {a} x join {b} y using (g) group by 1, 2),
    {name} as (select a, b, c / (na + nb - c) as similarity from {name}_c where c / (na + nb - c) >= {t} - 1e-12)"""


@core.exact
@core.query("exact_dedup", f"with {T} select instance_id, question from t where {norm('question')} <> '' qualify row_number() over (partition by {norm('question')} order by instance_id) = 1")
def exact_dedup(spark: SparkSession, d: str, form: Norm = normalize_native) -> DataFrame:
    """H1."""
    return D.exact_dedup(_tasks(spark, d).select("instance_id", "question").distinct(), "question", "instance_id", form)


NEAR = f"with {T}, {grams_sql('question', 'ga', 'bench_instance', 'instance_id')}, {grams_sql('question', 'gb', 't', 'instance_id')}, {overlap_sql('ga', 'gb', 0.3, 'o')} select a, b, round(similarity, 6) as similarity from o"


@core.exact
@core.query("near_pairs", NEAR)
def near_pairs(spark: SparkSession, d: str, form: Norm = normalize_native) -> DataFrame:
    """Test items against generated tasks."""
    bench = table(spark, d, "bench_instance")
    return D.near_overlap(bench, _tasks(spark, d), "instance_id", "question", "instance_id", "question", 0.3, form).select("a", "b", F.round("similarity", 6).alias("similarity"))


@core.exact
@core.query("near_pairs_prefix", NEAR)
def near_pairs_prefix(spark: SparkSession, d: str, form: Norm = normalize_native) -> DataFrame:
    """H4: the same pairs by prefix filtering."""
    bench = table(spark, d, "bench_instance")
    return D.near_overlap_prefix(bench, _tasks(spark, d), "instance_id", "question", "instance_id", "question", 0.3, form).select("a", "b", F.round("similarity", 6).alias("similarity"))


@core.exact
@core.query(
    "decontaminate",
    f"""with {T}, {grams_sql('question', 'ga', 'bench_instance', 'instance_id')}, {grams_sql('question', 'gb', 't', 'instance_id')}, {overlap_sql('ga', 'gb', 0.5, 'o')},
    bad as (select b as instance_id from o union select instance_id from t where {norm('question')} in (select {norm('question')} from bench_instance where question is not null) and {norm('question')} <> ''
      union select instance_id from t where split is null)
    select instance_id, 'blocked' as state from bad union all select distinct instance_id, 'clean' from t where instance_id not in (select instance_id from bad)""",
)
def decontaminate(spark: SparkSession, d: str, form: Norm = normalize_native) -> DataFrame:
    """Clean and blocked tasks; those without a split were blocked before."""
    all_tasks = _tasks(spark, d)
    t = all_tasks.select("instance_id", "question").distinct()
    clean, blocked = D.decontaminate(t, table(spark, d, "bench_instance"), all_tasks.where("split is null"), "instance_id", "question", "instance_id", "question", 0.5, form)
    state = lambda df, s: df.select("instance_id", F.lit(s).alias("state")).distinct()
    return state(clean, "clean").unionByName(state(blocked, "blocked"))


@core.query("decontamination_loop")
def decontamination_loop(spark: SparkSession, d: str) -> DataFrame:
    """H6: repeated until clean."""
    t = _tasks(spark, d).select("instance_id", "question").distinct()
    clean, blocked, ok = D.decontaminate_until_clean(t, table(spark, d, "bench_instance"), t.limit(0), "instance_id", "question", "instance_id", "question", 3, 0.5)
    count = lambda df, s: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("state"), "n", F.lit(ok).alias("settled"))
    return count(clean, "clean").unionByName(count(blocked, "blocked"))


@core.exact
@core.query(
    "train_dev_near_excl",
    f"""with {T}, tr as (select distinct instance_id, question from t where split in ('train', 'training')), dv as (select distinct instance_id, question from t where split in ('val', 'validation', 'dev')),
    {grams_sql('question', 'ga', 'dv', 'instance_id')}, {grams_sql('question', 'gb', 'tr', 'instance_id')}, {overlap_sql('ga', 'gb', 0.5, 'o')}
    select instance_id from tr where instance_id not in (select b from o)""",
)
def train_dev_near_excl(spark: SparkSession, d: str, form: Norm = normalize_native) -> DataFrame:
    """H7."""
    t = _tasks(spark, d).select("instance_id", "question", "split").distinct()
    train, dev = t.where(F.col("split").isin("train", "training")), t.where(F.col("split").isin("val", "validation", "dev"))
    return D.exclude_near(train, dev, "instance_id", "question", 0.5, form).select("instance_id")


@core.query("near_admission")
def near_admission(spark: SparkSession, d: str) -> DataFrame:
    """H2 within the first gold skill of each task."""
    t = _tasks(spark, d).select("instance_id", "question", F.get("gold_skill_ids", F.lit(0)).alias("skill"))
    return D.near_admission(t.where("skill is not null"), "skill", "instance_id", "question").select("instance_id", "skill")


@core.exact
@core.query(
    "duplicate_issues",
    f"""with u as (select distinct instance_id, question, coalesce(dataset, '?') as path from synthetic_task union all select instance_id, question, 'bench' from bench_instance),
    m as (select *, {norm('question')} as n from u),
    w as (select *, row_number() over (partition by instance_id order by path, n nulls first) as ri, first_value(path) over (partition by instance_id order by path, n nulls first) as pi,
      row_number() over (partition by n order by path, instance_id) as rt, first_value(path) over (partition by n order by path, instance_id) as pt from m)
    select 'duplicate_id' as issue, path, instance_id as id, pi as detail from w where ri > 1
    union all select 'duplicate_normalized_question', path, instance_id, pt from w where rt > 1 and n <> ''""",
)
def duplicate_issues(spark: SparkSession, d: str, form: Norm = normalize_native) -> DataFrame:
    """F18 over the tasks, a file for each dataset, and the test items."""
    t = table(spark, d, "synthetic_task").select("instance_id", "question", F.coalesce("dataset", F.lit("?")).alias("path")).distinct()
    b = table(spark, d, "bench_instance").select("instance_id", "question", F.lit("bench").alias("path"))
    return D.duplicate_issues(t.unionByName(b), "path", "instance_id", "question", form)


@core.exact
@core.query(
    "gold_name_in_query",
    f"""with q as (select instance_id, {norm("question || ' ' || coalesce((select any_value(name) from skill_corpus s where s.skill_id = e.skill_annotations[1]), '')")} as q, unnest(skill_annotations) as skill_id from example_instance e where question is not null)
    select distinct instance_id, skill_id from q join skill_corpus using (skill_id) where {norm('name')} <> '' and contains(q, {norm('name')})""",
)
def gold_name_in_query(spark: SparkSession, d: str, form: Norm = normalize_native) -> DataFrame:
    """D9 on questions that name their first gold skill."""
    s = table(spark, d, "skill_corpus")
    e = table(spark, d, "example_instance").where("question is not null").withColumn("first", F.get("skill_annotations", F.lit(0)))
    named = e.join(s.select(F.col("skill_id").alias("first"), "name"), "first", "left").withColumn("q", F.concat("question", F.lit(" "), F.coalesce("name", F.lit(""))))
    return D.gold_name_in_query(named, s, "instance_id", "q", F.col("skill_annotations"), form)


# The events table is the journal: a user's events are attempts, in order of time.
EVENTS = "e as (select user_id, event_id, event_type as status, value, row_number() over (partition by user_id order by ts, event_id) as attempt from events)"


def _journal(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("user_id", "event_id", F.col("event_type").alias("status"), "value", F.row_number().over(w).alias("attempt"))


@core.query(
    "latest_attempt",
    f"with {EVENTS} select user_id, event_id, status, round(value, 6) as value, attempt from e where status in ('click', 'view', 'purchase') qualify row_number() over (partition by user_id order by attempt desc, event_id desc) = 1",
)
def latest_attempt(spark: SparkSession, d: str) -> DataFrame:
    """F4, M2."""
    out = J.latest_attempt(_journal(spark, d), "user_id", "attempt", "event_id", ["click", "view", "purchase"])
    return out.select("user_id", "event_id", "status", F.round("value", 6).alias("value"), F.col("attempt").cast("bigint").alias("attempt"))


@core.query(
    "resume_done",
    "with r as (select record_id, instance_id, method, error, row_number() over (partition by record_id order by loaded_at desc) as n from inference_record), u as (select record_id, instance_id || '/' || coalesce(method, '') as key, error from r where n = 1) select key, min(record_id) as record_id from u where error is null group by 1",
)
def resume_done(spark: SparkSession, d: str) -> DataFrame:
    """M1: finished (instance, method) cells of the replies, the first of each; failed ones are tried again."""
    r = table(spark, d, "inference_record").select("record_id", F.concat("instance_id", F.lit("/"), F.coalesce("method", F.lit(""))).alias("key"), "error").distinct()
    return J.resume(r, "key", "record_id", F.col("error").isNull()).select("key", "record_id")


@core.query("pending_cells", "select distinct instance_id from example_instance where instance_id not in (select instance_id from inference_record where error is null and instance_id is not null)")
def pending_cells(spark: SparkSession, d: str) -> DataFrame:
    """Examples without any finished reply."""
    done = table(spark, d, "inference_record").where("error is null").select("instance_id").distinct()
    return J.pending(table(spark, d, "example_instance").select("instance_id").distinct(), done, "instance_id")


@core.query(
    "recent_questions",
    "with u as (select distinct dataset, created_at, instance_id, question from synthetic_task where dataset is not null), r as (select *, row_number() over (partition by dataset order by instance_id desc) as n from u) select dataset, string_agg(coalesce(question, ''), '|' order by instance_id) as recent from r where n <= 5 group by 1",
)
def recent_questions(spark: SparkSession, d: str) -> DataFrame:
    """M5: the last five questions of each dataset."""
    u = table(spark, d, "synthetic_task").where("dataset is not null").select("dataset", "instance_id", F.coalesce("question", F.lit("")).alias("q")).distinct()
    return J.recent(u, "dataset", "instance_id", "q", 5).select("dataset", F.array_join("recent", "|").alias("recent"))


@core.query(
    "answer_state",
    r"""with r as (select distinct record_id, raw_output, error, case when length(raw_output) > 800 then 'length' else 'stop' end as finish from inference_record)
    select record_id, regexp_matches(coalesce(raw_output, ''), '[^\s\p{Z}]') and coalesce(error, '') = '' and finish = 'stop' as usable, not regexp_matches(coalesce(raw_output, ''), '[^\s\p{Z}]') or coalesce(error, '') <> '' as retryable from r""",
)
def answer_state(spark: SparkSession, d: str) -> DataFrame:
    """Replies of more than 800 characters count as cut off."""
    finish = F.when(F.length("raw_output") > 800, "length").otherwise("stop")
    r = table(spark, d, "inference_record").select("record_id", "raw_output", "error", finish.alias("finish")).distinct()
    return r.select("record_id", J.usable(F.col("raw_output"), F.col("error"), F.col("finish")).alias("usable"), J.retryable(F.col("raw_output"), F.col("error")).alias("retryable"))


@core.query(
    "completeness",
    r"""with a as (select instance_id, min_by(raw_output, record_id) as o, min_by(coalesce(error, ''), record_id) as e from inference_record where raw_output is not null group by 1),
    j as (select dataset, o, coalesce(e, '') as e from example_instance left join a using (instance_id))
    select dataset, count(*) as assigned, count(case when regexp_matches(coalesce(o, ''), '[^\s\p{Z}]') and e = '' then 1 end) as usable, count(case when not regexp_matches(coalesce(o, ''), '[^\s\p{Z}]') or e <> '' then 1 end) as retryable,
      not bool_or(not regexp_matches(coalesce(o, ''), '[^\s\p{Z}]') or e <> '') as complete from j group by 1""",
)
def completeness(spark: SparkSession, d: str) -> DataFrame:
    """Examples joined with their first reply."""
    r = table(spark, d, "inference_record").where("raw_output is not null")
    a = r.groupBy("instance_id").agg(F.min_by("raw_output", "record_id").alias("o"), F.min_by(F.coalesce("error", F.lit("")), "record_id").alias("e"), F.lit("stop").alias("f"))
    return J.completeness(table(spark, d, "example_instance").select("instance_id", "dataset"), a, "instance_id", "dataset", "o", "e", "f")


@core.query(
    "next_round",
    """with h as (select g as skill_id, count(distinct instance_id) as have from (select instance_id, unnest(gold_skill_ids) as g from synthetic_task) group by 1)
    select skill_id, cast(greatest(0, 40 - coalesce(have, 0)) as bigint) as missing, cast(ceil(greatest(0, 40 - coalesce(have, 0)) / 0.8) as bigint) as ask from (select distinct skill_id from skill_corpus) left join h using (skill_id)""",
)
def next_round(spark: SparkSession, d: str) -> DataFrame:
    """Forty tasks a skill, four of five accepted."""
    have = table(spark, d, "synthetic_task").select("instance_id", F.explode("gold_skill_ids").alias("skill_id")).distinct()
    targets = table(spark, d, "skill_corpus").select("skill_id").distinct().withColumn("target", F.lit(40))
    return J.next_round(have, targets, "skill_id", 0.8)


@core.query("stale_rows", "with r as (select distinct record_id, instance_id, record_id % 3 as shard from inference_record), a as (select distinct instance_id, length(instance_id) % 3 as shard from example_instance) select record_id from r where exists (select 1 from a where a.instance_id = r.instance_id and a.shard = r.shard)")
def stale_rows(spark: SparkSession, d: str) -> DataFrame:
    """M6."""
    r = table(spark, d, "inference_record").select("record_id", "instance_id", F.pmod("record_id", F.lit(3)).cast("int").alias("shard")).distinct()
    a = table(spark, d, "example_instance").select("instance_id", F.pmod(F.length("instance_id"), F.lit(3)).alias("shard"))
    return J.drop_stale(r, a, "instance_id", "shard").select("record_id")
