"""Queries that go through files: sources, sinks, streams and registries (survey sections A, M and N)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.text import normalize_native
from quillmill.operators import registry as N
from quillmill.operators import retrieval as R
from quillmill.plans.registry import core
from quillmill.plans.retrieval_queries import BENCH, OUT, SKILLS, _bench, _gold, _skills, bm25_sql, counts_sql
from quillmill.plans.sqltext import norm
from quillmill.session import shared_dir, table
from quillmill.sources import readers as A
from quillmill.sources import sinks as Z
from quillmill.streaming import journals as J


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillmill/{name}-{uuid.uuid4().hex}"


@core.query("json_round_trip", f"select instance_id as id, question, {norm('question')} as norm from bench_instance where question is not null")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Test items written as JSONL and read as a benchmark of unknown layout."""
    p = _path(spark, "bench")
    Z.write_atomic(table(spark, d, "bench_instance").select("instance_id", F.col("question").alias("query")), p)
    return A.benchmark(spark, [p], normalize_native).select("id", "question", "norm")


@core.query("csv_strings", "select cast(n_nationkey as varchar) as n_nationkey, n_name, cast(n_regionkey as varchar) as n_regionkey from nation")
def csv_strings(spark: SparkSession, d: str) -> DataFrame:
    """A table through CSV, cells as strings."""
    p = _path(spark, "nation")
    table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").write.csv(p, header=True)
    return A.read_csv_strings(spark, p)


@core.query("jsonl_strings", "select cast(s_suppkey as varchar) as s_suppkey, s_name, cast(s_nationkey as varchar) as s_nationkey from supplier")
def jsonl_strings(spark: SparkSession, d: str) -> DataFrame:
    """A8, A10."""
    p = _path(spark, "supplier")
    table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey").write.json(p)
    return A.read_jsonl_strings(spark, p)


@core.query("result_sink", f"with {BENCH}, {SKILLS}, {counts_sql()}, {bm25_sql(10)} {OUT} bm25")
def result_sink(spark: SparkSession, d: str) -> DataFrame:
    """A ranking stored nested and read back in long form."""
    p = _path(spark, "ranking")
    r = R.catalog_top_k(_bench(spark, d), _skills(spark, d), "query_id", "text", "item_id", "text", 10)
    Z.write_once(Z.nest_results(r, _gold(spark, d)), p, form="parquet")
    return Z.flatten_results(spark.read.parquet(p)).select("query_id", F.col("rank").cast("bigint").alias("rank"), "item_id", F.round("score", 6).alias("score"))


@core.query("journal_round_trip", "select user_id, max(event_id) as event_id, count(*) as n from events group by 1")
def journal_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Events appended to a journal in two goes and read again."""
    p = _path(spark, "journal")
    e = table(spark, d, "events").select("event_id", "user_id", F.lit("journal.v1").alias("schema"))
    Z.append(e.where("event_id % 2 = 0"), p)
    Z.append(e.where("event_id % 2 = 1"), p)
    j = A.read_journal(spark, p, "event_id bigint, user_id bigint, schema string", "journal.v1")
    return j.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.count(F.lit(1)).alias("n"))


@core.query("corpus_dict", "with u as (select skill_id, name, 0 as o from skill_corpus union all select skill_id, 'Newer ' || name, 1 from skill_corpus where tools is not null) select skill_id, max_by(name, o) as name from u group by 1")
def corpus_dict(spark: SparkSession, d: str) -> DataFrame:
    """The last of repeated rows wins."""
    s = table(spark, d, "skill_corpus").select("skill_id", "name", F.lit(0).alias("o"))
    newer = table(spark, d, "skill_corpus").where("tools is not null").select("skill_id", F.concat(F.lit("Newer "), "name").alias("name"), F.lit(1).alias("o"))
    return A.last_of(s.unionByName(newer), "skill_id", "o").select("skill_id", "name")


@core.query("publish_or_verify")
def publish_or_verify(spark: SparkSession, d: str) -> DataFrame:
    """Published, published again unchanged, and refused when changed."""
    p = _path(spark, "published")
    rows = table(spark, d, "skill_corpus").select("skill_id", "name")
    out = [Z.publish_or_verify(rows, p, "skill_id", "name"), Z.publish_or_verify(rows.orderBy("name"), p, "skill_id", "name")]
    try:
        out.append(Z.publish_or_verify(rows.where("skill_id like '%1'"), p, "skill_id", "name"))
    except ValueError:
        out.append("refused")
    return spark.createDataFrame(list(enumerate(out)), "step int, outcome string")


@core.query("merged_shards", "select instance_id, dataset from bench_instance")
def merged_shards(spark: SparkSession, d: str) -> DataFrame:
    """Shards put together in the order of the test items."""
    b = table(spark, d, "bench_instance").select("instance_id", "dataset")
    shard = F.pmod(F.xxhash64("instance_id"), F.lit(3))
    parts = [b.where(shard == i) for i in range(3)]
    order = b.select("instance_id", F.col("instance_id").alias("position"))
    return Z.merge_shards(parts[0].unionByName(parts[1]).unionByName(parts[2]), order, "instance_id", "position")


@core.query("legacy_journal", "select event_id, row_number() over (partition by user_id order by event_type, event_id) as attempt from events")
def legacy_journal(spark: SparkSession, d: str) -> DataFrame:
    """Event types as old files, events as their lines."""
    e = table(spark, d, "events")
    return Z.legacy_journal(e, "user_id", "event_type", "event_id").select("event_id", F.col("attempt").cast("bigint").alias("attempt"))


@core.query("parts_listing")
def parts_listing(spark: SparkSession, d: str) -> DataFrame:
    """The registered retrievers and scorers."""
    return N.listing(spark, N.retrievers, N.scorers)


@core.query("registered_retriever", f"with {BENCH}, {SKILLS}, {counts_sql()}, {bm25_sql(3)} {OUT} bm25")
def registered_retriever(spark: SparkSession, d: str) -> DataFrame:
    """A retriever made by name; options that it doesn't know are not passed on."""
    r = N.retrievers.make("bm25", k=3, temperature=0)(_bench(spark, d), _skills(spark, d))
    return r.select("query_id", F.col("rank").cast("bigint").alias("rank"), "item_id", F.round("score", 6).alias("score"))


@core.query("applied_rows", "with b as (select instance_id, question as q from bench_instance) select instance_id, case when length(q) % 3 = 0 then null when length(q) % 3 = 1 then null else upper(substr(q, 1, 5)) end as value, case when length(q) % 3 = 0 then 'ValueError: odd' when length(q) % 3 = 1 then 'empty result' end as error from b")
def applied_rows(spark: SparkSession, d: str) -> DataFrame:
    """A function that fails on some rows and returns nothing on others."""

    def f(q: str) -> str:
        if len(q) % 3 == 0:
            raise ValueError("odd")
        return "" if len(q) % 3 == 1 else q[:5].upper()

    return N.apply_rows(table(spark, d, "bench_instance"), "instance_id", "question", f)


EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"


@core.query("stream_latest", "select user_id, max(event_id) as event_id from (select *, max(ts) over (partition by user_id) as m from events) where ts = m group by 1")
def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """M2 as a stream: latest state of each user, upserted batch by batch."""
    src, out = _path(spark, "events"), _path(spark, "latest")
    table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value").repartition(4).write.parquet(src)
    state = J.latest_state(J.event_stream(spark, src, EVENT, "ts", "3650 days"), "user_id", ["ts", "event_id"])
    J.run_batches(state, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), f"{out}-checkpoint", "complete")
    last = spark.read.parquet(out)
    return last.where(F.col("batch") == last.agg(F.max("batch")).first()[0]).select("user_id", "event_id")


@core.query("stream_once", "select count(distinct event_id) as n from events")
def stream_once(spark: SparkSession, d: str) -> DataFrame:
    """M1 as a stream: events delivered twice count once."""
    src, out = _path(spark, "events"), _path(spark, "once")
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    e.unionByName(e.where("event_id % 3 = 0")).write.parquet(src)
    once = J.once_delivered(J.event_stream(spark, src, EVENT, "ts", "3650 days"), "event_id")
    J.run_batches(once, lambda df, n: df.write.mode("append").parquet(out), f"{out}-checkpoint")
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n"))


@core.query("strict_lines", "select record_id, method, raw_output from inference_record where raw_output is not null")
def strict_lines(spark: SparkSession, d: str) -> DataFrame:
    """Replies through a JSONL file whose every line must be a document."""
    p = _path(spark, "strict")
    table(spark, d, "inference_record").where("raw_output is not null").select("record_id", "method", "raw_output").write.json(p)
    return A.read_strict(spark, p, "record_id bigint, method string, raw_output string")


@core.query("optional_artifacts", "select skill_id, name, 'there' as source from skill_corpus")
def optional_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """An artifact that is there, and one that isn't and so has no rows."""
    p = _path(spark, "optional")
    Z.write_atomic(table(spark, d, "skill_corpus").select("skill_id", "name"), p)
    there, missing = (A.read_optional(spark, x, "skill_id string, name string") for x in (p, p + "-missing"))
    return there.withColumn("source", F.lit("there")).unionByName(missing.withColumn("source", F.lit("missing")))
