"""Sinks (survey section A): staged and renamed outputs, retrieval results, shards, publish or verify."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.operators.audit import content_id
from quillmill.sources.readers import exists


def write_atomic(df: DataFrame, path: str, form: str = "json") -> None:
    """Writes beside the target and renames, so a reader never sees half an output."""
    spark = df.sparkSession
    stage = f"{path.rstrip('/')}.stage-{uuid.uuid4().hex}"
    df.write.format(form).save(stage)
    jvm = spark.sparkContext._jvm
    src, dst = jvm.org.apache.hadoop.fs.Path(stage), jvm.org.apache.hadoop.fs.Path(path)
    fs = src.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    had = fs.exists(dst)
    if had and not fs.rename(dst, old):
        raise OSError(f"{path} can't be replaced")
    if not fs.rename(src, dst):
        if had:
            fs.rename(old, dst)
        raise OSError(f"{path} can't be written")
    if had:
        fs.delete(old, True)


def write_once(df: DataFrame, path: str, force: bool = False, form: str = "json") -> bool:
    """Writes unless the output is there; whether it wrote."""
    if exists(df.sparkSession, path) and not force:
        return False
    write_atomic(df, path, form)
    return True


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a journal of part files; a part appears whole or not at all."""
    df.write.mode("append").json(path)


def nest_results(results: DataFrame, gold: DataFrame) -> DataFrame:
    """One row a query as rankings are stored: (instance_id, gold_skill_ids, retrieved)."""
    r = results.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("item_id").alias("skill_id"), "score"))).alias("l"))
    g = gold.where("item_id is not null").groupBy("query_id").agg(F.array_sort(F.collect_set("item_id")).alias("gold_skill_ids"))
    flat = r.join(g, "query_id", "left").select(F.col("query_id").alias("instance_id"), F.coalesce("gold_skill_ids", F.array().cast("array<string>")).alias("gold_skill_ids"), "l")
    return flat.select("instance_id", "gold_skill_ids", F.transform("l", lambda x: F.struct(x["skill_id"].alias("skill_id"), x["score"].alias("score"))).alias("retrieved"))


def flatten_results(stored: DataFrame) -> DataFrame:
    """The long form of stored rankings."""
    e = stored.select(F.col("instance_id").alias("query_id"), F.posexplode("retrieved").alias("pos", "r"))
    return e.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("r.skill_id").alias("item_id"), F.col("r.score").alias("score"))


def merge_shards(shards: DataFrame, expected: DataFrame, key: str, position: str) -> DataFrame:
    """Shards together in the order of the benchmark; raises unless they cover it exactly once."""
    bad = shards.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(expected.select(key, F.lit(1).alias("e")), key, "full_outer").where("n is null or e is null or n > 1")
    if not bad.isEmpty():
        raise ValueError(f"the shards don't cover the rows exactly: {[r[0] for r in bad.select(key).limit(5).collect()]}")
    return shards.join(expected.select(key, position), key).orderBy(position).drop(position)


def publish_or_verify(df: DataFrame, path: str, *columns: str, form: str = "parquet") -> str:
    """'written', 'same' if the output holds the same rows, an error if other ones."""
    spark = df.sparkSession
    if not exists(spark, path):
        write_atomic(df, path, form)
        return "written"
    have = content_id(spark.read.format(form).load(path), *columns).first()[0]
    if have != content_id(df, *columns).first()[0]:
        raise ValueError(f"{path} holds other content")
    return "same"


def register_vectors(vectors: DataFrame, root: str, key: str, text: str, model: str) -> tuple[str, bool]:
    """Folder of cached vectors named by the content of its corpus and the model, and whether it is there."""
    ident = content_id(vectors, key, text).first()[0]
    path = f"{root.rstrip('/')}/{model.replace('/', '_')}-{ident[:24]}"
    return path, exists(vectors.sparkSession, path)


def legacy_journal(rows: DataFrame, key: str, file: str, line: str) -> DataFrame:
    """Old journals in one: requests numbered over (file, line), attempts within a key."""
    by_key = Window.partitionBy(key).orderBy(file, line)
    return rows.withColumn("attempt", F.row_number().over(by_key))
