"""Queries of retrieval, fusion and metrics (survey sections E, F and J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import retrieval as R
from quillmill.plans.registry import core
from quillmill.plans.sqltext import toks
from quillmill.session import spread, table

BENCH = "q as (select instance_id as query_id, question as text from bench_instance)"
SKILLS = "d as (select skill_id as item_id, concat_ws(chr(10), nullif(name, ''), nullif(description, ''), nullif(content, '')) as text from skill_corpus)"
CRAWL = "d as (select doc_id as item_id, text from documents)"


def counts_sql() -> str:
    """CTEs over d(item_id, text) and q(query_id, text): term counts and statistics."""
    return f"""dt as (select item_id, {toks('text')} as t from d where text is not null),
    st as (select count(*) as n_docs, avg(len(t)) as avgdl from dt),
    c as (select item_id, term, count(*) as tf, any_value(dl) as dl from (select item_id, len(t) as dl, unnest(t) as term from dt) group by 1, 2),
    df as (select term, count(*) as df from c group by 1),
    qt as (select query_id, term, count(*) as qtf from (select query_id, unnest({toks('text')}) as term from q) group by 1, 2)"""


def bm25_sql(k: int, name: str = "bm25") -> str:
    """CTE of the BM25 ranking."""
    return f"""{name}_s as (select query_id, item_id, sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) as score from c
      join (select term, ln((n_docs - df + 0.5) / (df + 0.5)) as idf, avgdl from df, st) using (term) join qt using (term) where idf > 0 group by 1, 2),
    {name} as (select query_id, item_id, score, row_number() over (partition by query_id order by round(score, 9) desc, item_id) as rank from {name}_s qualify rank <= {k})"""


def tfidf_sql(k: int, name: str = "tfidf") -> str:
    """CTE of the TF-IDF ranking."""
    return f"""{name}_i as (select term, ln(n_docs / (1 + df)) as idf from df, st),
    {name}_w as (select item_id, term, tf / dl * idf as w from c join {name}_i using (term)),
    {name}_n as (select item_id, sqrt(sum(w * w)) as norm from {name}_w group by 1),
    {name}_q0 as (select query_id, term, qtf / sum(qtf) over (partition by query_id) * idf as qw from qt join {name}_i using (term)),
    {name}_q as (select *, sqrt(sum(qw * qw) over (partition by query_id)) as qnorm from {name}_q0),
    {name}_s as (select query_id, item_id, sum(w * qw) / any_value(case when norm = 0 then 1 else norm end) / any_value(case when qnorm = 0 then 1 else qnorm end) as score
      from {name}_w join {name}_q using (term) join {name}_n using (item_id) group by 1, 2),
    {name} as (select query_id, item_id, score, row_number() over (partition by query_id order by round(score, 9) desc, item_id) as rank from {name}_s qualify rank <= {k})"""


def _bench(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bench_instance").select(F.col("instance_id").alias("query_id"), F.col("question").alias("text"))


def _skills(spark: SparkSession, d: str) -> DataFrame:
    from quillmill.functions.strings import skill_text

    return table(spark, d, "skill_corpus").select(F.col("skill_id").alias("item_id"), skill_text(F.col("name"), F.col("description"), F.col("content")).alias("text"))


def _rounded(r: DataFrame) -> DataFrame:
    return r.select("query_id", F.col("rank").cast("bigint").alias("rank"), "item_id", F.round("score", 6).alias("score"))


OUT = "select query_id, rank, item_id, round(score, 6) as score from"


@core.query("bm25_topk", f"with {BENCH}, {CRAWL}, {counts_sql()}, {bm25_sql(10)} {OUT} bm25")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """J2 with F12: the test questions over the crawl."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return _rounded(R.bm25_top_k(_bench(spark, d), docs, "query_id", "text", "doc_id", "text", 10))


@core.query("tfidf_topk", f"with {BENCH}, {SKILLS}, {counts_sql()}, {tfidf_sql(10)} {OUT} tfidf")
def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    """J3 with F12: the test questions over the skills."""
    return _rounded(R.top_k(R.tfidf_scores(_bench(spark, d), _skills(spark, d), "query_id", "text", "item_id", "text"), 10))


POOL = "q as (select distinct instance_id as query_id, question as text from synthetic_task)"


@core.query("pool_retrieval", f"with {POOL}, {SKILLS}, {counts_sql()}, {bm25_sql(5)} {OUT} bm25")
def pool_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Every generated task over the skills."""
    pool = table(spark, d, "synthetic_task").select(F.col("instance_id").alias("query_id"), F.col("question").alias("text")).distinct()
    return _rounded(R.catalog_top_k(pool, _skills(spark, d), "query_id", "text", "item_id", "text", 5))


@core.query(
    "corpus_stats",
    f"with {BENCH}, {CRAWL}, {counts_sql()} select term, df, cast(sum(tf) as bigint) as cf, n_docs, round(avgdl, 6) as avgdl from c join df using (term), st group by term, df, n_docs, avgdl",
)
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """document and corpus frequency of each term."""
    docs = table(spark, d, "documents")
    by_term = R.term_counts(docs, "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    return by_term.join(F.broadcast(R.document_stats(docs, "text"))).select("term", "df", "cf", "n_docs", F.round("avgdl", 6).alias("avgdl"))


GOLD = "g as (select distinct instance_id as query_id, unnest(case when len(skill_annotations) = 0 then [null] else coalesce(skill_annotations, [null]) end) as item_id from bench_instance)"


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bench_instance").select(F.col("instance_id").alias("query_id"), F.explode_outer("skill_annotations").alias("item_id"))


def _both(spark: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame]:
    q, s = _bench(spark, d), _skills(spark, d)
    return (
        R.catalog_top_k(q, s, "query_id", "text", "item_id", "text", k),
        R.top_k(R.tfidf_scores(q, s, "query_id", "text", "item_id", "text"), k),
    )


HYBRID = """t as (select query_id, item_id, 2 * rank as slot, score from bm25 union all select query_id, item_id, 2 * rank + 1, score from tfidf),
    both_q as (select distinct query_id from bm25 intersect select distinct query_id from tfidf),
    h0 as (select query_id, item_id, min(slot) as slot, min_by(score, slot) as score from t where query_id in (select query_id from both_q) group by 1, 2),
    h as (select query_id, item_id, score, row_number() over (partition by query_id order by slot) as rank from h0 qualify rank <= 10)"""


@core.query("hybrid_round_robin", f"with {BENCH}, {SKILLS}, {counts_sql()}, {bm25_sql(10)}, {tfidf_sql(10)}, {HYBRID} {OUT} h")
def hybrid_round_robin(spark: SparkSession, d: str) -> DataFrame:
    """J6, F14, E2."""
    a, b = _both(spark, d, 10)
    return _rounded(R.round_robin(a, b, 10))


def metrics_sql(source: str, k_max: int) -> str:
    """Recall and nDCG of a ranking CTE against the gold CTE g."""
    ks = [k for k in (1, 5, 10, 50) if k <= k_max]
    per = ", ".join(f"coalesce(sum(case when rank <= {k} then 1.0 end), 0) as h{k}, coalesce(sum(case when rank <= {k} then 1 / log2(rank + 1) end), 0) as d{k}" for k in ks)
    ideal = {k: f"list_sum(list_transform(range(1, cast(greatest(1, least(n_gold, {k})) as bigint) + 1), lambda i: 1 / log2(i + 1)))" for k in ks}
    rows = " union all ".join(
        [f"select 'Recall@{k}' as metric, round(avg(case when n_gold > 0 then h{k} / n_gold else 0 end), 6) as value from j" for k in ks]
        + [f"select 'nDCG@{k}', round(avg(case when n_gold > 0 then d{k} / {ideal[k]} else 0 end), 6) from j" for k in ks]
    )
    return f"n as (select query_id, count(item_id) as n_gold from g group by 1), j as (select n.query_id, any_value(n_gold) as n_gold, {per} from n left join (select query_id, rank from {source} join g using (query_id, item_id)) using (query_id) group by 1) {rows}"


@core.query("retrieval_metrics", f"with {BENCH}, {SKILLS}, {GOLD}, {counts_sql()}, {bm25_sql(50)}, {metrics_sql('bm25', 50)}")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """F5 and J11 of BM25 over the skills."""
    r = R.catalog_top_k(_bench(spark, d), _skills(spark, d), "query_id", "text", "item_id", "text", 50)
    return R.retrieval_metrics(r, _gold(spark, d), 50).select("metric", F.round("value", 6).alias("value"))


@core.query(
    "router_metrics",
    f"""with {BENCH}, {SKILLS}, {GOLD}, {counts_sql()}, {bm25_sql(10)},
    gg as (select distinct query_id, item_id, regexp_replace(item_id, '_[^_]*$', '') as dataset from g where item_id is not null),
    hit as (select query_id, min(rank) as first from bm25 join gg using (query_id, item_id) group by 1),
    bq as (select distinct query_id, dataset, first from gg left join hit using (query_id)),
    per as (select 'dataset:' || dataset as scope, count(*) as queries, avg(case when first <= 1 then 1.0 else 0 end) as r1, avg(case when first <= 5 then 1.0 else 0 end) as r5,
      avg(case when first <= 10 then 1.0 else 0 end) as r10, avg(coalesce(1 / first, 0)) as mrr10 from bq group by dataset),
    mi as (select 'micro' as scope, count(*) as queries, avg(case when first <= 1 then 1.0 else 0 end) as r1, avg(case when first <= 5 then 1.0 else 0 end) as r5,
      avg(case when first <= 10 then 1.0 else 0 end) as r10, avg(coalesce(1 / first, 0)) as mrr10 from (select distinct query_id, first from bq)),
    it as (select item_id, avg(case when first <= 1 then 1.0 else 0 end) as r1 from gg left join hit using (query_id) group by 1),
    u as (select * from mi union all select * from per union all select 'skill_macro', count(*), avg(r1), null, null, null from it union all select 'selection', count(*), avg(r1), null, null, null from per)
    select scope, queries, round(r1, 6) as r1, round(r5, 6) as r5, round(r10, 6) as r10, round(mrr10, 6) as mrr10 from u""",
)
def router_metrics(spark: SparkSession, d: str) -> DataFrame:
    """F6 of BM25 over the skills."""
    r = R.catalog_top_k(_bench(spark, d), _skills(spark, d), "query_id", "text", "item_id", "text", 10)
    m = R.router_metrics(r, _gold(spark, d), F.regexp_replace("item_id", "_[^_]*$", ""))
    return m.select("scope", "queries", *(F.round(c, 6).alias(c) for c in ("r1", "r5", "r10", "mrr10")))


def dense_sql(k: int) -> str:
    """CTE of the dense ranking of every hundredth vector over all."""
    return f"""e as (select vec_id, label, cast(embedding as double[]) as v from embeddings),
    s as (select a.vec_id as query_id, b.vec_id as item_id, round(list_cosine_similarity(a.v, b.v), 9) as score, a.label as ql, b.label as il from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
    dense as (select query_id, item_id, score, ql, il, row_number() over (partition by query_id order by score desc, item_id) as rank from s qualify rank <= {k})"""


def _dense(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    return R.dense_top_k(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", "vec_id", "embedding", k)


@core.query("dense_topk", f"with {dense_sql(10)} select query_id, rank, item_id, round(score, 6) as score from dense")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth vector is a query against all others."""
    return _rounded(_dense(spark, d, 10))


@core.query(
    "dense_metrics",
    f"""with {dense_sql(10)}, n as (select label, count(*) as c from embeddings group by 1), p as (select query_id, any_value(ql) as ql, min(case when ql = il then rank end) as first, count(case when ql = il then 1 end) as hits from dense group by 1)
    select ql as label, count(*) as queries, round(avg(hits / 10), 6) as precision10, round(avg(coalesce(1 / first, 0)), 6) as mrr10 from p group by 1""",
)
def dense_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Routes of the dense ranking, scored by shared labels."""
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    r = _dense(spark, d, 10).join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    r = r.join(labels.select(F.col("vec_id").alias("item_id"), F.col("label").alias("il")), "item_id")
    same = F.col("ql") == F.col("il")
    p = r.groupBy("query_id").agg(F.first("ql").alias("label"), F.min(F.when(same, F.col("rank"))).alias("first"), F.count(F.when(same, 1)).alias("hits"))
    return p.groupBy("label").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.col("hits") / 10), 6).alias("precision10"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr10"))


@core.query(
    "rank_scores",
    f"""with {BENCH}, {SKILLS}, {counts_sql()}, {bm25_sql(10)}, {tfidf_sql(5)},
    j as (select b.query_id, b.item_id, row_number() over (partition by b.query_id order by t.rank nulls last, b.rank) as rank from bm25 b left join tfidf t on b.query_id = t.query_id and b.item_id = t.item_id)
    select query_id, rank, item_id, round(1 / rank, 6) as score from j""",
)
def rank_scores(spark: SparkSession, d: str) -> DataFrame:
    """F20, J7's relational part: BM25 candidates in the order of a second ranking, the rest behind."""
    q, s = _bench(spark, d), _skills(spark, d)
    source = R.catalog_top_k(q, s, "query_id", "text", "item_id", "text", 10)
    order = R.top_k(R.tfidf_scores(q, s, "query_id", "text", "item_id", "text"), 5)
    return _rounded(R.rank_scores(order, source))


@core.query(
    "reranked",
    f"""with {BENCH}, {SKILLS}, {counts_sql()}, {bm25_sql(10)},
    x as (select b.query_id, b.item_id, b.rank as r0, length(d.text) as s from bm25 b join d using (item_id)),
    r as (select query_id, item_id, s, row_number() over (partition by query_id order by s desc, r0) as rank from x qualify rank <= 3)
    select query_id, rank, item_id, cast(s as double) as score from r""",
)
def reranked(spark: SparkSession, d: str) -> DataFrame:
    """F21, J8, E13 with a scorer that is a column (the length of the skill's text)."""
    q, s = _bench(spark, d), _skills(spark, d)
    found = R.catalog_top_k(q, s, "query_id", "text", "item_id", "text", 10).join(s, "item_id")
    return _rounded(R.rerank(found, F.length("text").cast("double"), 3))


@core.query(
    "topk_skills",
    f"""with {BENCH}, {SKILLS}, {counts_sql()}, {bm25_sql(3)} select q.query_id, coalesce(string_agg(item_id, ',' order by rank), '') as skills from q left join bm25 using (query_id) group by 1""",
)
def topk_skills(spark: SparkSession, d: str) -> DataFrame:
    """E3, J9's pool: the best skills of each question, an empty list where none is found."""
    q = _bench(spark, d)
    r = R.catalog_top_k(q, _skills(spark, d), "query_id", "text", "item_id", "text", 3)
    lists = r.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "item_id"))).alias("l"))
    return q.join(lists, "query_id", "left").select("query_id", F.coalesce(F.array_join(F.transform("l", lambda x: x["item_id"]), ","), F.lit("")).alias("skills"))


@core.query(
    "oracle_skills",
    """with e as (select instance_id, unnest(skill_annotations) as skill_id, generate_subscripts(skill_annotations, 1) as pos from bench_instance)
    select instance_id, string_agg(c.name, ' | ' order by pos) as names from e join skill_corpus c using (skill_id) group by 1""",
)
def oracle_skills(spark: SparkSession, d: str) -> DataFrame:
    """The gold skills in order, those outside the corpus dropped."""
    e = table(spark, d, "bench_instance").select("instance_id", F.posexplode("skill_annotations").alias("pos", "skill_id"))
    j = e.join(table(spark, d, "skill_corpus").select("skill_id", "name"), "skill_id")
    l = j.groupBy("instance_id").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("l"))
    return l.select("instance_id", F.array_join(F.transform("l", lambda x: x["name"]), " | ").alias("names"))


@core.query("distractors")
def distractors(spark: SparkSession, d: str) -> DataFrame:
    """Hard negatives from two rankings in turn."""
    a, b = _both(spark, d, 10)
    return R.distractors(_gold(spark, d).where("item_id is not null"), a, b, 4)


@core.query(
    "contrastive_loss",
    f"""with {dense_sql(10)}, z as (select query_id, score / 0.05 as z, ql = il as pos, max(score / 0.05) over (partition by query_id) as m from dense)
    select query_id, round(ln(sum(exp(z - m))) - ln(nullif(sum(case when pos then exp(z - m) end), 0)), 6) as loss from z group by 1""",
)
def contrastive_loss(spark: SparkSession, d: str) -> DataFrame:
    """J14 on the dense ranking, items of the query's label being positive."""
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    r = _dense(spark, d, 10).join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    r = r.join(labels.select(F.col("vec_id").alias("item_id"), F.col("label").alias("il")), "item_id")
    loss = R.contrastive_loss(r.select("query_id", "item_id", "score", (F.col("ql") == F.col("il")).alias("positive")))
    return loss.select("query_id", F.round("loss", 6).alias("loss"))
