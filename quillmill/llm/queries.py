"""Queries of the training-data problems, by problem number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.encode import count_tokens, encode
from quillmill.llm.leakage import leaked
from quillmill.llm.neardup import group_pairs, near_groups
from quillmill.llm.oracles import ORACLES
from quillmill.llm.overlap import cross_split
from quillmill.llm.packing import pack, split_items
from quillmill.llm.pairs import broken_pairs
from quillmill.llm.spam import stuffed_pages
from quillmill.llm.splits import assign, clean_ids, groups
from quillmill.llm.tasks import documents, split_of, synthetic_tasks
from quillmill.session import cut, spread, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance_id, group_id): the group of records linked by skills and sources that each record is in."""
    return groups(synthetic_tasks(spark, sf_dir), "instance_id", "gold_skill_ids", "source_instance_ids")


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance_id, split): groups assigned whole, largest first, near the shares of split_target."""
    # The target table names the splits, three by its definition.
    shares = {r["split_name"]: float(r["share"]) for r in table(spark, sf_dir, "split_target").collect() if r["split_name"] and r["share"]}
    return assign(cut(p1_found(spark, sf_dir), "p1-groups"), "instance_id", shares)


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = split_of("split")
    records = synthetic_tasks(spark, sf_dir).select("instance_id", "question", (split == "training").alias("training"))
    return cross_split(records, "instance_id", "question", "training", t=0.7)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b): pairs of a training and an evaluation record with similarity of at least 0.7."""
    pairs = _overlaps(spark, sf_dir).where(F.col("train_id") != F.col("eval_id"))
    return pairs.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).distinct()


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(split, dataset, pairs, records, mean_cover): overlaps per split and dataset of the evaluation record's gold skills.

    A record with skills of several datasets counts for each; one without a skill has a null dataset.
    """
    tasks = synthetic_tasks(spark, sf_dir)
    sets = F.transform(clean_ids(F.col("gold_skill_ids")), lambda x: F.regexp_replace(x, "_[^_]*$", ""))
    evals = tasks.where(split_of("split").isin("validation", "test")).select("instance_id", split_of("split").alias("split"), F.explode_outer(F.array_distinct(sets)).alias("dataset")).distinct()
    pairs = _overlaps(spark, sf_dir)
    joined = pairs.join(evals, pairs["eval_id"] == evals["instance_id"])
    return joined.groupBy("split", "dataset").agg(
        F.count(F.lit(1)).alias("pairs"), F.countDistinct("eval_id").alias("records"), F.round(F.avg("eval_cover"), 6).alias("mean_cover")
    )


def p2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(eval_id, partners, best_similarity, best_cover): per evaluation record, how much of it stands in training.

    One row a record; the pairs of different texts are verified all the same.
    """
    return _overlaps(spark, sf_dir).groupBy("eval_id").agg(
        F.count(F.lit(1)).alias("partners"), F.max("similarity").alias("best_similarity"), F.max("eval_cover").alias("best_cover")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, defect): records whose reply fails, with the kind of defect."""
    records = spread(table(spark, sf_dir, "inference_record").select("record_id", "instance_id", "raw_output"))
    examples = table(spark, sf_dir, "example_instance").groupBy(F.col("instance_id").alias("__i")).agg(F.min("question").alias("question"))
    pairs = records.join(examples, F.col("instance_id") == F.col("__i"), "left")
    return broken_pairs(pairs, "record_id", "raw_output", "question").distinct()  # rows delivered again


def p3_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(method, defect, records): defects of each method, null being a method of its own."""
    method = table(spark, sf_dir, "inference_record").groupBy(F.col("record_id").alias("__r")).agg(F.min("method").alias("method"))
    found = p3_found(spark, sf_dir)
    return found.join(method, F.col("record_id") == F.col("__r")).groupBy("method", "defect").agg(F.count(F.lit(1)).alias("records"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corpus_table, corpus_id, test_id): training texts with at least half of a test question's triples."""
    return p4_tiles(spark, sf_dir).select("corpus_table", "corpus_id", "test_id")


def p4_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_found with the shared triples and the words of the tiles."""
    tests = table(spark, sf_dir, "bench_instance").select(F.col("instance_id").alias("test_id"), "question")
    docs = spread(documents(spark, sf_dir).select("doc_id", "text")).select(F.lit("documents").alias("corpus_table"), F.col("doc_id").cast("string").alias("corpus_id"), "text")
    tasks = synthetic_tasks(spark, sf_dir).where(split_of("split") == "training")
    tasks = tasks.select(F.lit("synthetic_task").alias("corpus_table"), F.col("instance_id").alias("corpus_id"), F.col("question").alias("text"))
    found = leaked(docs.unionByName(tasks), tests, ["corpus_table", "corpus_id"], "text", "test_id", "question")
    return found.distinct()  # rows delivered again


def p4_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(test_id, corpus_table, texts): how many texts of each table hold each leaked test item."""
    return p4_found(spark, sf_dir).groupBy("test_id", "corpus_table").agg(F.count(F.lit(1)).alias("texts"))


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(synthetic_tasks(spark, sf_dir), "instance_id", "question", 0.5)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b): all pairs of records of the same near-duplicate group."""
    return group_pairs(cut(_near(spark, sf_dir), "p5-groups"), "instance_id")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance_id, group_id): the near-duplicate group of each record that has one."""
    return _near(spark, sf_dir)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids): the token ids of every document."""
    return encode(spread(documents(spark, sf_dir).select("doc_id", "text")), "doc_id", "text")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One row by its definition; more kinds of container would each be packed by a call of their own.
    capacity = table(spark, sf_dir, "container_spec").agg(F.min("capacity_tokens")).first()[0]
    sizes = cut(count_tokens(spread(documents(spark, sf_dir).select("doc_id", "text")), "doc_id", "text"), "p7-sizes")
    return pack(sizes, "doc_id", "tokens", int(capacity))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id): documents that the packing had to split."""
    return split_items(_packed(spark, sf_dir), "doc_id")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(container, doc_id, piece, begin, size): the containers with their documents or pieces."""
    return _packed(spark, sf_dir)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id): pages stuffed with keywords, links or tags."""
    return stuffed_pages(spread(documents(spark, sf_dir).select("doc_id", "text")), "doc_id", "text").select("doc_id")


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, pages, stuffed): stuffed pages of each source, null being a source of its own."""
    docs = documents(spark, sf_dir)
    bad = stuffed_pages(spread(docs.select("doc_id", "text")), "doc_id", "text").select(F.col("doc_id").alias("__d"), F.lit(1).alias("bad"))
    joined = docs.select("doc_id", "source").join(bad, F.col("doc_id") == F.col("__d"), "left")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("bad"), F.lit(0)).alias("stuffed"))


_QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    p1_found, p1_splits, p2_found, p2_counts, p2_coverage, p3_found, p3_methods, p5_found, p5_groups, p4_found, p4_tiles, p4_tests, p6_ids, p7_found, p7_containers, p8_found, p8_sources,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL for those that SQL can express on whole tables."""
    return dict(ORACLES)
