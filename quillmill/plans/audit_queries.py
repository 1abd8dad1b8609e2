"""Queries of audits, settings and chat samples (survey sections A, F8, H8 to H11 and O)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.text import normalize_native
from quillmill.operators import audit as U
from quillmill.operators import dedup as D
from quillmill.operators import messages as M
from quillmill.operators import retrieval as R
from quillmill.operators import settings as O
from quillmill.operators.dedup import Norm
from quillmill.plans.dedup_queries import grams_sql, overlap_sql
from quillmill.plans.registry import core
from quillmill.plans.retrieval_queries import BENCH, SKILLS, _bench, _skills, bm25_sql, counts_sql
from quillmill.plans.sqltext import norm
from quillmill.session import table

EXPECTED = {"theoremqa": 320, "medcalcbench": 55, "logicbench": 19, "toolqa": 14}


@core.query(
    "universe_check",
    """with w as (select * from (values ('theoremqa', 320), ('medcalcbench', 55), ('logicbench', 19), ('toolqa', 14)) t(prefix, expected)),
    h as (select regexp_replace(skill_id, '_[^_]*$', '') as prefix, count(*) as found, count(distinct skill_id) as distinct_found from skill_corpus group by 1)
    select prefix, cast(coalesce(expected, 0) as bigint) as expected, coalesce(found, 0) as found, coalesce(distinct_found, 0) as distinct_found, coalesce(expected, 0) = coalesce(found, 0) and coalesce(found, 0) = coalesce(distinct_found, 0) as valid from w full outer join h using (prefix)""",
)
def universe_check(spark: SparkSession, d: str) -> DataFrame:
    """F8."""
    return U.universe(table(spark, d, "skill_corpus"), EXPECTED)


T = "t as (select distinct instance_id, question, gold_skill_ids from synthetic_task)"


@core.exact
@core.query(
    "leakage_audit",
    f"""with {T}, n as (select *, coalesce({norm('question')}, '') as n from t), q as (select instance_id, question from t where question is not null),
    {grams_sql('question', 'ga', 'bench_instance', 'instance_id')}, {grams_sql('question', 'gb', 'q', 'instance_id')}, {overlap_sql('ga', 'gb', 0.5, 'o')},
    own as (select instance_id, unnest(case when len(coalesce(gold_skill_ids, [])) = 0 then [null] else gold_skill_ids end) as g from t),
    ex as (select distinct instance_id from n where n <> '' and n in (select {norm('question')} from bench_instance where question is not null))
    select 'missing_question' as issue, instance_id as id, '' as detail from n where n = ''
    union all select 'missing_or_unknown_source_skills', instance_id, coalesce(min(g), '') from own where g is null or g not in (select skill_id from skill_corpus) group by instance_id
    union all select 'duplicate_id', instance_id, cast(count(*) as varchar) from t group by instance_id having count(*) > 1
    union all select 'duplicate_normalized_question', min(instance_id), cast(count(distinct instance_id) as varchar) from n where n <> '' group by n having count(distinct instance_id) > 1
    union all select 'exact_test_question_overlap', instance_id, '' from ex
    union all select distinct 'near_test_question_overlap', b, '' from o where b not in (select instance_id from ex)
    union all select distinct 'gold_skill_name_in_query', n.instance_id, s.skill_id from n, (select instance_id, unnest(gold_skill_ids) as g from t) e, skill_corpus s where e.instance_id = n.instance_id and s.skill_id = e.g and {norm('s.name')} <> '' and contains(n.n, {norm('s.name')})
    union all select 'empty_training_input', '', '' from (select count(*) as c from t) where c = 0""",
)
def leakage_audit(spark: SparkSession, d: str, form: Norm = normalize_native) -> DataFrame:
    """H8 over the generated tasks."""
    t = table(spark, d, "synthetic_task").select("instance_id", "question", "gold_skill_ids").distinct()
    overlap = D.overlapping(t.where("question is not null"), table(spark, d, "bench_instance"), "instance_id", "question", "instance_id", "question", 0.5, form)
    return U.leakage(t, table(spark, d, "skill_corpus"), "instance_id", "question", "gold_skill_ids", overlap, norm=form)


ARTIFACT_ROWS = """t as (select distinct instance_id, question, lower(trim(split)) as split, dataset, coalesce(gold_skill_ids, []) as gold, coalesce(origin_skill_ids, []) as origin from synthetic_task),
    w as (select case when split in ('train', 'training') then 'trajectory' else 'anchor' end as kind, coalesce(origin[1], gold[1]) as skill_id, * from t),
    r as (select kind || '/' || skill_id || '.json' as path, instance_id as id, * from w where skill_id is not null),
    f as (select path, any_value(kind) as kind, any_value(skill_id) as skill_id, any_value(kind) || '/all' as directory, case when count(dataset) = count(*) then 'synthetic_train_pool' end as source_kind,
      max(dataset) as model, case when count(*) > 1 then 'dense_rerank' else 'dense' end as retriever, min(dataset) as retriever_model, case when count(*) > 2 then min(dataset) else '' end as reranker_model,
      case when count(*) % 2 = 0 then 'retrieval_top1_then_topk_loose' end as near_policy, count(distinct id) as requested from r group by path)"""


@core.query(
    "artifact_audit",
    f"""with {ARTIFACT_ROWS}, u as (select regexp_replace(skill_id, '_[^_]*$', '') as p, count(*) as c, count(distinct skill_id) as d from skill_corpus group by 1),
    e as (select * from (values ('theoremqa', 320), ('medcalcbench', 55), ('logicbench', 19), ('toolqa', 14)) t(p, n)),
    sk as (select distinct skill_id from skill_corpus), n as (select r.*, {norm('r.question')} as q from r where coalesce({norm('r.question')}, '') <> ''),
    places as (select distinct kind, directory from f), an as (select * from f where kind = 'anchor'),
    off as (select kind, directory, s.skill_id from places, sk s except select kind, directory, skill_id from f union all (select distinct kind, directory, skill_id from f where skill_id not in (select skill_id from sk))),
    tr as (select * from n where kind = 'trajectory'), firsts as (select id, min(path) as first from tr group by id), asked as (select q, min(path) as first from tr group by q)
    select 'invalid_closed_world_skill_universe' as issue, '' as id, cast((select sum(c) from u) as varchar) as detail where exists (select 1 from e full outer join u using (p) where n is distinct from c or c is distinct from d) or (select sum(d) from u) <> 408
    union all select 'incomplete_test_suite_for_decontamination', '', cast(count(distinct dataset) as varchar) from bench_instance having count(distinct dataset) <> 4
    union all select 'incomplete_' || kind || '_directory', directory, cast(count(*) as varchar) from off group by kind, directory
    union all select 'anchor_source_not_synthetic', path, coalesce(source_kind, '') from an where source_kind is distinct from 'synthetic_train_pool'
    union all select 'anchor_missing_provenance_field', path, x from (select path, unnest(list_filter([case when coalesce(model, '') = '' then 'model' end, case when coalesce(retriever_model, '') = '' then 'retriever_model' end, case when coalesce(near_policy, '') = '' then 'near_policy' end, case when coalesce(reranker_model, '') = '' then 'reranker_model' end], lambda v: v is not null)) as x from an)
    union all select 'anchor_retriever_protocol_mismatch', path, retriever from an where retriever <> 'dense_rerank'
    union all select 'anchor_near_policy_mismatch', path, coalesce(near_policy, '') from an where near_policy is null
    union all select 'anchor_unknown_target_skill', path, skill_id from an where skill_id not in (select skill_id from sk)
    union all select 'incomplete_anchor_counts', a.path, cast((select count(*) from r where r.path = a.path) as varchar) from an a where (select count(*) from r where r.path = a.path) <> requested
    union all select 'anchor_missing_source_question', path || '#' || id, '' from n where kind = 'anchor' and dataset is null
    union all select distinct 'anchor_missing_or_unknown_source_skills', path || '#' || id, '' from (select path, id, unnest(case when len(gold) = 0 then [null] else gold end) as g from n where kind = 'anchor') where g is null or g not in (select skill_id from sk)
    union all select 'anchor_is_not_negative', path || '#' || id, skill_id from n where kind = 'anchor' and list_contains(gold, skill_id)
    union all select 'cross_trajectory_duplicate_id', path || '#' || tr.id, first from tr join firsts using (id) where path <> first
    union all select 'cross_skill_duplicate_questions_retained', '', cast(count(*) as varchar) from tr join asked using (q) where path <> first having count(*) > 0""",
)
def artifact_audit(spark: SparkSession, d: str) -> DataFrame:
    """H8: the generated tasks as files of trajectories and anchors, one a skill, with every rule for such files."""
    split = F.lower(F.trim("split"))
    lists = [F.coalesce(c, F.array().cast("array<string>")).alias(n) for c, n in (("gold_skill_ids", "gold"), ("origin_skill_ids", "origin"))]
    t = table(spark, d, "synthetic_task").select("instance_id", "question", split.alias("split"), "dataset", *lists).distinct()
    w = t.withColumn("kind", F.when(F.col("split").isin("train", "training"), "trajectory").otherwise("anchor")).withColumn("skill_id", F.coalesce(F.get("origin", F.lit(0)), F.get("gold", F.lit(0))))
    r = w.where("skill_id is not null").withColumn("path", F.concat("kind", F.lit("/"), "skill_id", F.lit(".json"))).withColumnRenamed("instance_id", "id")
    n = F.count(F.lit(1))
    files = r.groupBy("path", "kind", "skill_id").agg(
        F.when(F.count("dataset") == n, U.ANCHOR_SOURCE).alias("source_kind"), F.max("dataset").alias("model"), F.when(n > 1, "dense_rerank").otherwise("dense").alias("retriever"),
        F.min("dataset").alias("retriever_model"), F.when(n > 2, F.min("dataset")).otherwise("").alias("reranker_model"), F.when(n % 2 == 0, U.ANCHOR_POLICY).alias("near_policy"), F.countDistinct("id").alias("nearmiss_requested"),
    )
    files = files.withColumn("directory", F.concat("kind", F.lit("/all"))).withColumn("nearmiss_kept", F.col("nearmiss_requested")).withColumn("random_requested", F.lit(0)).withColumn("random_kept", F.lit(0))
    rows = r.select("path", "id", "question", F.col("dataset").alias("source_question"), F.col("gold").alias("source_skill_ids"))
    skills = table(spark, d, "skill_corpus")
    suites = table(spark, d, "bench_instance").select("dataset").where("dataset is not null").distinct().count()
    return U.artifact_audit(files, rows, skills, EXPECTED, skills, suites, "dense_rerank", normalize_native)


@core.query(
    "retrieval_audit",
    f"""with {BENCH}, {SKILLS}, {counts_sql()}, {bm25_sql(10)}, r as (select * from bm25 where score >= 12 union all select 'nobody', 'theoremqa_999', 1.0, 1),
    per as (select query_id, count(*) as n, count(distinct item_id) as u from r group by 1)
    select 'retrieval_coverage_mismatch' as issue, query_id as id, 'missing' as detail from (select distinct query_id from q) where query_id not in (select query_id from r)
    union all select 'retrieval_coverage_mismatch', query_id, 'unexpected' from per where query_id not in (select query_id from q)
    union all select 'wrong_ranking_length', query_id, cast(n as varchar) from per where n <> 10 union all select 'duplicate_retrieved_skill', query_id, cast(n - u as varchar) from per where u < n
    union all select distinct 'retrieved_skill_outside_corpus', query_id, item_id from r where item_id not in (select item_id from d)""",
)
def retrieval_audit(spark: SparkSession, d: str) -> DataFrame:
    """H9, H10 on a ranking cut at a score and with a stray query."""
    r = R.catalog_top_k(_bench(spark, d), _skills(spark, d), "query_id", "text", "item_id", "text", 10)
    cut_short = r.where("score >= 12").select("query_id", "rank", "item_id")
    stray = spark.createDataFrame([("nobody", 1, "theoremqa_999")], "query_id string, rank int, item_id string")
    return U.retrieval_audit(cut_short.unionByName(stray), _bench(spark, d), _skills(spark, d), 10)


@core.query(
    "pool_content_id",
    """with h as (select sha256('{"instance_id":"' || instance_id || '"}') as h from (select distinct instance_id from synthetic_task)),
    b as (select sha256(string_agg(h, chr(10) order by h)) as h from h group by substr(h, 1, 3)) select sha256(string_agg(h, chr(10) order by h)) as content_id from b""",
)
def pool_content_id(spark: SparkSession, d: str) -> DataFrame:
    """Content hash of the pool's ids."""
    return U.content_id(table(spark, d, "synthetic_task").select("instance_id").distinct(), "instance_id")


SETTINGS = [
    ("protocol", None, "temperature", "0"),
    ("defaults", None, "max_tokens", "8192"),
    ("defaults", None, "top_k", "10"),
    ("model", "Corvik-7B", "max_tokens", "4096"),
    ("dataset", "toolqa", "max_tokens", "16384"),
    ("dataset", "theoremqa", "top_k", "5"),
    ("skill", "toolqa_010", "top_k", "3"),
    ("flags", None, "seed", "7"),
]


@core.query(
    "settings_resolve",
    f"""with s as (select * from (values {', '.join(f"('{a}', {'null' if b is None else repr(b)}, '{c}', '{e}')" for a, b, c, e in SETTINGS)}) t(scope, name, key, value)),
    t as (select distinct i.model, e.dataset, e.skill_annotations[1] as skill_id from inference_record i join example_instance e using (instance_id) where i.model is not null),
    a as (select t.*, key, value, list_position(['protocol', 'defaults', 'model', 'dataset', 'skill', 'flags'], scope) as p from t join s on scope in ('protocol', 'defaults', 'flags') or (scope = 'model' and name = model) or (scope = 'dataset' and name = dataset) or (scope = 'skill' and name = skill_id))
    select model, dataset, skill_id, key, max_by(value, p) as value from a group by 1, 2, 3, 4""",
)
def settings_resolve(spark: SparkSession, d: str) -> DataFrame:
    """O1 for every model, dataset and skill that occurs."""
    e = table(spark, d, "example_instance").select("instance_id", "dataset", F.get("skill_annotations", F.lit(0)).alias("skill_id"))
    t = table(spark, d, "inference_record").where("model is not null").select("instance_id", "model").join(e, "instance_id").select("model", "dataset", "skill_id").distinct()
    return O.resolve(spark.createDataFrame(SETTINGS, "scope string, name string, key string, value string"), t)


@core.query(
    "experiment_grid",
    """with c as (select distinct d as dataset, p as provider, case when d = 'toolqa' then 'react' else e end as engine from unnest(['theoremqa', 'logicbench', 'medcalcbench', 'toolqa']) x(d), unnest(['none', 'oracle', 'topk']) y(p), unnest(['direct', 'disclosure']) z(e))
    select dataset, provider || '+' || engine as method, provider, engine, case when provider = 'oracle' then 'oracle' when engine = 'react' then 'tools' else provider || '+' || engine end as profile from c""",
)
def experiment_grid(spark: SparkSession, d: str) -> DataFrame:
    """Methods of each dataset, an engine of its own for toolqa, and their profiles."""
    g = O.grid(list(EXPECTED), ["none", "oracle", "topk"], ["direct", "disclosure"], {"toolqa": "react"}, spark)
    oracle = F.when(F.col("provider") == "oracle", "oracle")
    return O.profile_of(g, [("+react", "tools")]).withColumn("profile", F.coalesce(oracle, "profile"))


@core.query("token_limits", "select * from (values " + ", ".join(f"('{s}', '{x}', cast({n} as bigint))" for (s, x), n in O.TOKEN_LIMITS.items()) + ") t(stage, dataset, max_tokens)")
def token_limits(spark: SparkSession, d: str) -> DataFrame:
    """O11."""
    return O.token_limits(spark)


@core.query(
    "completion_skip",
    """with j as (select skill_id as job_id, sha256(coalesce(content, '')) as content_hash from skill_corpus), f as (select skill_id as job_id, sha256(case when description is null then 'old' else coalesce(content, '') end) as content_hash from skill_corpus where skill_id in (select unnest(gold_skill_ids) from synthetic_task))
    select j.job_id, j.content_hash, case when f.job_id is null then 'new' else 'stale' end as state from j left join f using (job_id) where f.job_id is null or f.content_hash <> j.content_hash""",
)
def completion_skip(spark: SparkSession, d: str) -> DataFrame:
    """Skills with tasks are finished, those without a description with other content."""
    s = table(spark, d, "skill_corpus")
    content = F.coalesce("content", F.lit(""))
    jobs = s.select(F.col("skill_id").alias("job_id"), F.sha2(content, 256).alias("content_hash"))
    used = table(spark, d, "synthetic_task").select(F.explode("gold_skill_ids").alias("skill_id")).distinct()
    done = s.join(used, "skill_id", "left_semi").select(F.col("skill_id").alias("job_id"), F.sha2(F.when(F.col("description").isNull(), "old").otherwise(content), 256).alias("content_hash"))
    return O.open_jobs(jobs, done)


def _samples(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "inference_record").where("raw_output like 'Thought 1:%'").select("record_id", "instance_id", "raw_output").distinct()
    j = r.join(table(spark, d, "example_instance").select("instance_id", "dataset", "question"), "instance_id")
    return j.select("record_id", F.lit("Use the tools.").alias("system"), M.steps_to_messages(F.col("question"), F.col("raw_output")).alias("messages"))


@core.query("chat_export")
def chat_export(spark: SparkSession, d: str) -> DataFrame:
    """Replies in steps as chat lines."""
    return M.chat_lines(_samples(spark, d), "system", "messages", strip_skills=True)


@core.query(
    "last_assistant_turn",
    r"""with r as (select distinct i.record_id, i.raw_output from inference_record i join example_instance e using (instance_id) where raw_output like 'Thought 1:%'),
    p as (select record_id, string_split(regexp_replace(raw_output, '\n(Observation \d+:|Thought \d+:)', chr(1) || '\1', 'g'), chr(1)) as p from r)
    select record_id, list_filter(p, lambda x: not starts_with(x, 'Observation'))[-1] as last, cast(len(list_filter(p, lambda x: not starts_with(x, 'Observation'))) as bigint) as turns from p""",
)
def last_assistant_turn(spark: SparkSession, d: str) -> DataFrame:
    """Last assistant message and their number."""
    s = _samples(spark, d)
    return s.select("record_id", M.last_assistant(F.col("messages")).alias("last"), F.size(F.filter("messages", lambda x: x["role"] == "assistant")).cast("bigint").alias("turns"))


@core.query(
    "per_turn_samples",
    r"""with r as (select distinct i.record_id, coalesce(e.question, '') as q, i.raw_output from inference_record i join example_instance e using (instance_id) where raw_output like 'Thought 1:%'),
    p as (select record_id, [q] || string_split(regexp_replace(raw_output, '\n(Observation \d+:|Thought \d+:)', chr(1) || '\1', 'g'), chr(1)) as p from r),
    e as (select record_id, p, unnest(p) as x, generate_subscripts(p, 1) as pos from p)
    select record_id, cast(pos as bigint) as turn, cast(length(array_to_string(p[1:pos], '')) as bigint) as chars from e where pos > 1 and not starts_with(x, 'Observation')""",
)
def per_turn_samples(spark: SparkSession, d: str) -> DataFrame:
    """One training sample for each assistant turn, with its context."""
    t = M.per_turn(_samples(spark, d), "messages")
    chars = F.length(F.array_join(F.transform("context", lambda x: x["content"]), ""))
    return t.select("record_id", F.col("turn").cast("bigint").alias("turn"), chars.cast("bigint").alias("chars"))


@core.query(
    "trainable_span",
    r"""with r as (select distinct record_id, regexp_split_to_array(raw_output, '\s+') as w from inference_record where raw_output is not null)
    select max(len(list_filter(w, lambda x: not regexp_matches(x, '[0-9]')))) as longest, round(1 - sum(len(list_filter(w, lambda x: not regexp_matches(x, '[0-9]')))) / sum(len(w)), 6) as masked from r""",
)
def trainable_span(spark: SparkSession, d: str) -> DataFrame:
    """words with figures are masked."""
    from quillmill.operators.scoring import longest_span

    r = table(spark, d, "inference_record").where("raw_output is not null").select("record_id", "raw_output").distinct()
    labels = F.transform(F.split("raw_output", r"\s+"), lambda x: F.when(x.rlike("[0-9]"), -100).otherwise(F.length(x)))
    s = r.select(F.size(labels).alias("n"), longest_span(labels).alias("k"))
    return s.agg(F.max("k").cast("bigint").alias("longest"), F.round(1 - F.sum("k") / F.sum("n"), 6).alias("masked"))
