"""Queries of task pools, joins, routing and set operations (survey sections B, E, F and G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import strings as S
from quillmill.functions.text import normalize_native
from quillmill.operators import pool as L
from quillmill.operators import retrieval as R
from quillmill.operators.dedup import Norm
from quillmill.plans.registry import core
from quillmill.plans.retrieval_queries import BENCH, SKILLS, _bench, _skills, bm25_sql, counts_sql
from quillmill.plans.sqltext import norm
from quillmill.session import table


@core.exact
@core.query(
    "task_pool_merge",
    f"""with t as (select *, {norm('question')} as n from synthetic_task where question is not null),
    b as (select n, min(instance_id) as instance_id, min_by(question, instance_id) as question, count(distinct instance_id) as members from t where n <> '' group by 1),
    g as (select n, string_agg(distinct x, ',' order by x) as x from (select n, unnest(gold_skill_ids) as x from t) where x is not null and x <> '' group by 1),
    o as (select n, string_agg(distinct x, ',' order by x) as x from (select n, unnest(origin_skill_ids) as x from t) where x is not null and x <> '' group by 1),
    s as (select n, string_agg(distinct x, ',' order by x) as x from (select n, unnest(datasets) as x from t) where x is not null and x <> '' group by 1)
    select b.instance_id, b.question, b.members, coalesce(g.x, '') as gold, coalesce(o.x, '') as origins, coalesce(s.x, '') as datasets from b left join g using (n) left join o using (n) left join s using (n)""",
)
def task_pool_merge(spark: SparkSession, d: str, form: Norm = normalize_native) -> DataFrame:
    """F2."""
    t = table(spark, d, "synthetic_task").where("question is not null")
    m = L.merge_questions(t.select("instance_id", "question", "gold_skill_ids", "origin_skill_ids", "datasets"), "instance_id", "question", ["gold_skill_ids", "origin_skill_ids", "datasets"], form)
    join = lambda c: F.array_join(c, ",")
    return m.select("instance_id", "question", "members", join("gold_skill_ids").alias("gold"), join("origin_skill_ids").alias("origins"), join("datasets").alias("datasets"))


@core.query(
    "origin_inference",
    """with r as (select distinct case when instance_id < 'syn_8' then coalesce(gold_skill_ids[1], '') || '/' || instance_id else instance_id end as id, case when instance_id >= 'syn_8' then origin_skill_ids end as own from synthetic_task),
    c as (select id, list_filter(coalesce(own, []), lambda x: x is not null and x <> '') as own from r)
    select id, array_to_string(list_sort(list_distinct(own)), ',') as origin from c where len(own) > 0
    union all select id, string_agg(distinct skill_id, ',' order by skill_id) from c join skill_corpus on starts_with(id, skill_id) where len(own) = 0 group by id""",
)
def origin_inference(spark: SparkSession, d: str) -> DataFrame:
    """Half of the tasks by their lists, the others by the skill that begins an id made for it."""
    low = F.col("instance_id") < "syn_8"
    ident = F.when(low, F.concat(F.coalesce(F.get("gold_skill_ids", F.lit(0)), F.lit("")), F.lit("/"), "instance_id")).otherwise(F.col("instance_id"))
    rows = table(spark, d, "synthetic_task").select(ident.alias("id"), F.when(~low, F.col("origin_skill_ids")).alias("own")).distinct()
    return L.infer_origin(rows, table(spark, d, "skill_corpus"), "id", "own").select("id", F.array_join("origin", ",").alias("origin"))


ADAPTERS = "ad as (select skill_id from skill_corpus where tools is not null)"


def _adapters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "skill_corpus").where("tools is not null")


@core.query(
    "adapter_routes",
    f"""with {BENCH}, {SKILLS}, {counts_sql()}, {bm25_sql(1)}, {ADAPTERS}, e as (select instance_id, unnest(skill_annotations) as skill_id, generate_subscripts(skill_annotations, 1) as pos from bench_instance),
    a as (select instance_id, min_by(skill_id, pos) as adapter from e join ad using (skill_id) group by 1),
    r as (select query_id as instance_id, item_id as adapter from bm25 where rank = 1 and item_id in (select skill_id from ad))
    select b.instance_id, a.adapter as gold_route, r.adapter as retrieved_route from bench_instance b left join a using (instance_id) left join r on r.instance_id = b.instance_id""",
)
def adapter_routes(spark: SparkSession, d: str) -> DataFrame:
    """Skills with tools have an adapter."""
    b, ad = table(spark, d, "bench_instance"), _adapters(spark, d)
    ranked = R.catalog_top_k(_bench(spark, d), _skills(spark, d), "query_id", "text", "item_id", "text", 1)
    g = L.adapter_routes(b, "skill_annotations", ad, "instance_id").withColumnRenamed("adapter", "gold_route")
    return g.join(L.retrieved_routes(b, ranked, ad, "instance_id").withColumnRenamed("adapter", "retrieved_route"), "instance_id")


@core.query("route_text_blank", f"with {ADAPTERS} select skill_id, case when skill_id in (select skill_id from ad) then '' else content end as content from skill_corpus")
def route_text_blank(spark: SparkSession, d: str) -> DataFrame:
    """Text only for skills without an adapter."""
    ad = _adapters(spark, d).select(F.col("skill_id").alias("__a"))
    j = table(spark, d, "skill_corpus").join(ad, F.col("skill_id") == F.col("__a"), "left")
    return j.select("skill_id", L.blank_unless(F.col("content"), F.col("__a").isNull()).alias("content"))


@core.query(
    "results_joined",
    "with r as (select distinct record_id, instance_id, method from inference_record) select r.record_id, r.method, e.dataset, e.eval_data.answer as answer from r left join example_instance e using (instance_id)",
)
def results_joined(spark: SparkSession, d: str) -> DataFrame:
    """E1."""
    r = table(spark, d, "inference_record").select("record_id", "instance_id", "method").distinct()
    e = table(spark, d, "example_instance").select("instance_id", "dataset", F.col("eval_data.answer").alias("answer"))
    return r.join(e, "instance_id", "left").select("record_id", "method", "dataset", "answer")


@core.query(
    "assembled_anchors",
    """with s as (select distinct instance_id, gold_skill_ids[1] as skill_id, question from synthetic_task where gold_skill_ids[1] is not null),
    a as (select skill_id, case when length(question) % 2 = 0 then 'near' else 'random' end as kind, instance_id, question, row_number() over (partition by skill_id order by instance_id) as rank from s),
    u as (select skill_id, kind, instance_id, row_number() over (partition by skill_id, kind order by rank) as slot from a where length(question) >= 100)
    select skill_id, kind, instance_id, slot from u where slot <= 3""",
)
def assembled_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Three rows a skill and kind among those whose question is long enough."""
    s = table(spark, d, "synthetic_task").select("instance_id", F.get("gold_skill_ids", F.lit(0)).alias("skill_id"), "question").distinct().where("skill_id is not null")
    kind = F.when(F.pmod(F.length("question"), F.lit(2)) == 0, "near").otherwise("random")
    assigned = s.select("skill_id", kind.alias("kind"), "instance_id", F.col("instance_id").alias("rank"))
    answers = s.select("instance_id", "question").distinct()
    out = L.assemble(assigned, answers, F.length("question") >= 100, "skill_id", "kind", "rank", "instance_id", F.lit(3))
    return out.select("skill_id", "kind", "instance_id", F.col("slot").cast("bigint").alias("slot"))


@core.query(
    "skills_with_demos",
    """with u as (select distinct instance_id, gold_skill_ids[1] as skill_id, question from synthetic_task where question is not null),
    r as (select *, row_number() over (partition by skill_id order by instance_id) as rank from u qualify rank <= 2),
    t as (select skill_id, string_agg('Problem:' || chr(10) || question || chr(10) || 'Solution:' || chr(10) || instance_id, chr(10) || chr(10) order by rank) as d from r group by 1)
    select skill_id, concat_ws(chr(10) || chr(10), content, coalesce(d, '')) as content from skill_corpus left join t using (skill_id)""",
)
def skills_with_demos(spark: SparkSession, d: str) -> DataFrame:
    """Two demonstrations behind each skill's content."""
    from pyspark.sql import Window

    u = table(spark, d, "synthetic_task").where("question is not null").select("instance_id", F.get("gold_skill_ids", F.lit(0)).alias("skill_id"), "question").distinct()
    r = u.withColumn("rank", F.row_number().over(Window.partitionBy("skill_id").orderBy("instance_id"))).where("rank <= 2")
    text = F.concat(F.lit("Problem:\n"), "question", F.lit("\nSolution:\n"), "instance_id")
    return L.with_demos(table(spark, d, "skill_corpus"), r.select("skill_id", "rank", text.alias("text")))


@core.query(
    "prompt_render",
    """select b.instance_id, case dataset when 'theoremqa' then 'Answer with a number, a list of numbers, True/False or an option.' when 'toolqa' then 'Use the tools step by step.' when 'medcalcbench' then 'End with a line ANSWER: <value>.' else '' end as system,
    'Relevant Skill:' || chr(10) || s.content || chr(10) || chr(10) || case dataset when 'theoremqa' then 'Problem:' || question || chr(10) || 'Solution:' when 'toolqa' then 'Question: ' || question else question end as "user"
    from bench_instance b join skill_corpus s on s.skill_id = b.skill_annotations[1]""",
)
def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    """A template for each dataset, joined as a table, with the first gold skill before the question."""
    from quillmill.functions.prompts import render, templates

    b = table(spark, d, "bench_instance").withColumn("skill_id", F.get("skill_annotations", F.lit(0)))
    s = table(spark, d, "skill_corpus").select("skill_id", "content")
    return render(b.join(s, "skill_id"), templates(spark), F.array("content")).select("instance_id", "system", "user")


@core.query(
    "strip_skill",
    "select b.instance_id, question as stripped from bench_instance b join skill_corpus s on s.skill_id = b.skill_annotations[1] where dataset = 'logicbench' and not contains(s.name, chr(10))",
)
def strip_skill(spark: SparkSession, d: str) -> DataFrame:
    """A skill block put before a question and taken away again."""
    b = table(spark, d, "bench_instance").where("dataset = 'logicbench'").withColumn("skill_id", F.get("skill_annotations", F.lit(0)))
    j = b.join(table(spark, d, "skill_corpus").select("skill_id", "name"), "skill_id").where(~F.contains("name", F.lit("\n")))
    return j.select("instance_id", S.without_skills(S.with_skills(F.col("question"), F.array("name"))).alias("stripped"))


@core.query("strip_skill_all")
def strip_skill_all(spark: SparkSession, d: str) -> DataFrame:
    """B15 on all test items with all their skills, names with line breaks included; without known skills nothing is put before."""
    b = table(spark, d, "bench_instance").select("instance_id", "question", "skill_annotations")
    known = table(spark, d, "skill_corpus").select("skill_id", "name").where("name is not null")
    e = b.select("instance_id", F.posexplode("skill_annotations").alias("i", "skill_id")).join(known, "skill_id")
    names = e.groupBy("instance_id").agg(F.sort_array(F.collect_set(F.struct("i", "name"))).alias("l")).select("instance_id", F.transform("l", lambda x: x["name"]).alias("names"))
    j = b.join(names, "instance_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    return j.select("instance_id", S.without_known_skills(S.with_skills(F.col("question"), F.col("names")), F.col("names")).alias("stripped"))


@core.query(
    "catalog_text",
    """with s as (select regexp_replace(skill_id, '_[^_]*$', '') as dataset, skill_id, name, description, row_number() over (partition by regexp_replace(skill_id, '_[^_]*$', '') order by skill_id) as i from skill_corpus where name is not null)
    select dataset, string_agg('[' || i || '] ' || name || ': ' || coalesce(description, ''), chr(10) order by i) as lines from s where name is not null group by 1""",
)
def catalog_text(spark: SparkSession, d: str) -> DataFrame:
    """The skills of each dataset, a fixed library, as a catalog."""
    s = table(spark, d, "skill_corpus").where("name is not null").withColumn("dataset", S.dataset_of(F.col("skill_id")))
    l = s.groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("skill_id", "name", "description"))).alias("l"))
    return l.select("dataset", S.catalog_lines(F.transform("l", lambda x: x["name"]), F.transform("l", lambda x: x["description"])).alias("lines"))


@core.query(
    "coverage_diff",
    """with e as (select distinct instance_id from example_instance), f as (select distinct instance_id from inference_record where instance_id is not null and error is null),
    m as (select instance_id from e except select instance_id from f), x as (select instance_id from f except select instance_id from e)
    select 'missing' as side, count(*) as n, (select string_agg(instance_id, ',' order by instance_id) from (select * from m order by instance_id limit 30)) as sample from m
    union all select 'extra', count(*), coalesce((select string_agg(instance_id, ',' order by instance_id) from (select * from x order by instance_id limit 30)), '') from x""",
)
def coverage_diff(spark: SparkSession, d: str) -> DataFrame:
    """Examples against those with an error-free reply."""
    f = table(spark, d, "inference_record").where("instance_id is not null and error is null")
    return L.difference(table(spark, d, "example_instance"), f, "instance_id")


@core.query(
    "shard_cover",
    """with r as (select instance_id, count(*) as n from (select distinct record_id, instance_id from inference_record) group by 1), e as (select distinct instance_id, 1 as e from example_instance)
    select unnest(['missing', 'unexpected', 'repeated']) as violation, unnest([count(case when n is null then 1 end), count(case when e is null then 1 end), count(case when n > 1 then 1 end)]) as n from e full outer join r using (instance_id)""",
)
def shard_cover(spark: SparkSession, d: str) -> DataFrame:
    """Whether the replies cover the examples exactly once."""
    return L.exact_cover(table(spark, d, "inference_record").select("record_id", "instance_id").distinct(), table(spark, d, "example_instance"), "instance_id")


@core.query(
    "set_operations",
    """with a as (select distinct unnest(gold_skill_ids) as s from synthetic_task), b as (select distinct unnest(skill_annotations) as s from bench_instance)
    select 'union_all' as op, count(*) as n from (select s from a union all select s from b) union all select 'union', count(*) from (select s from a union select s from b)
    union all select 'intersect', count(*) from (select s from a intersect select s from b) union all select 'except', count(*) from (select s from a except select s from b)
    union all select 'except_back', count(*) from (select s from b except select s from a)""",
)
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """G1 to G4 on the skills of tasks and of test items."""
    a = table(spark, d, "synthetic_task").select(F.explode("gold_skill_ids").alias("s")).distinct()
    b = table(spark, d, "bench_instance").select(F.explode("skill_annotations").alias("s")).distinct()
    n = lambda op, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    out = n("union_all", a.unionByName(b))
    for op, df in (("union", a.unionByName(b).distinct()), ("intersect", a.intersect(b)), ("except", a.subtract(b)), ("except_back", b.subtract(a))):
        out = out.unionByName(n(op, df))
    return out


@core.query("ordered_distinct", "with t as (select distinct instance_id, datasets || gold_skill_ids || gold_skill_ids as l from synthetic_task where gold_skill_ids is not null and datasets is not null) select instance_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') as items from t")
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    """G6."""
    t = table(spark, d, "synthetic_task").where("gold_skill_ids is not null and datasets is not null").select("instance_id", F.concat("datasets", "gold_skill_ids", "gold_skill_ids").alias("l")).distinct()
    return t.select("instance_id", F.array_join(F.array_distinct("l"), ",").alias("items"))


@core.query("assigned_union", "select distinct s as skill_id from (select unnest(gold_skill_ids) as s from synthetic_task union all select unnest(skill_annotations) from bench_instance) where s is not null")
def assigned_union(spark: SparkSession, d: str) -> DataFrame:
    """F23."""
    a = table(spark, d, "synthetic_task").select(F.explode("gold_skill_ids").alias("skill_id"))
    return a.unionByName(table(spark, d, "bench_instance").select(F.explode("skill_annotations").alias("skill_id"))).where("skill_id is not null").distinct()


@core.query(
    "skill_summary",
    "with e as (select distinct instance_id, unnest(gold_skill_ids) as s from synthetic_task) select s.skill_id, count(e.instance_id) as tasks, count(e.instance_id) = 0 as missing from skill_corpus s left join e on e.s = s.skill_id group by 1",
)
def skill_summary(spark: SparkSession, d: str) -> DataFrame:
    """tasks a skill; skills without one are missing."""
    e = table(spark, d, "synthetic_task").select("instance_id", F.explode("gold_skill_ids").alias("skill_id")).distinct().groupBy("skill_id").agg(F.count(F.lit(1)).alias("n"))
    j = table(spark, d, "skill_corpus").select("skill_id").join(e, "skill_id", "left")
    return j.select("skill_id", F.coalesce("n", F.lit(0)).alias("tasks"), F.col("n").isNull().alias("missing"))
