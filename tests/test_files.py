"""Sources, sinks and streams on files made here."""

from __future__ import annotations

import json

import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillmill.functions.text import normalize_native
from quillmill.sources import readers as A
from quillmill.sources import sinks as Z
from quillmill.streaming import journals as J


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return f"file://{path}"


def test_layouts_of_json(spark, tmp_path):
    rows = [{"id": "a", "question": "Q one"}, {"id": "b", "question": " "}]
    lines = write(tmp_path / "l.jsonl", "\n".join(map(json.dumps, rows)))
    whole = write(tmp_path / "w.json", json.dumps(rows, indent=1))
    wrapped = write(tmp_path / "r.json", json.dumps({"schema": "x", "instances": [{"instance_id": "c", "prompt": "Q two"}]}, indent=1))
    got = {(r["id"], r["norm"]) for r in A.benchmark(spark, [lines, whole, wrapped], normalize_native).collect()}
    assert got == {("a", "q one"), ("c", "q two")} and A.benchmark(spark, [], normalize_native).count() == 0
    with pytest.raises(ValueError):
        A.unwrap(A.read_jsonish(spark, whole), required=True)


def test_gold_of_lists_and_scalars(spark):
    df = spark.createDataFrame([([], "s1"), (["s2", "s3"], "s4"), (None, " ")], "gold_skill_ids array<string>, skill_id string")
    assert [r[0] for r in df.select(A.gold_of(df)).collect()] == [["s1"], ["s2", "s3"], []]


def test_csv_keeps_cells(spark, tmp_path):
    p = write(tmp_path / "t.csv", 'a,b,c\n1,"x, ""y""\nz",\n1.0,,007\n')
    assert [tuple(r) for r in A.read_csv_strings(spark, p).collect()] == [("1", 'x, "y"\nz', None), ("1.0", None, "007")]


def test_journal_tolerates_only_its_last_line(spark, tmp_path):
    schema = "schema string, id int"
    good = '{"schema": "j", "id": 1}\n{"schema": "j", "id": 2}\n'
    assert A.read_journal(spark, write(tmp_path / "a.jsonl", good + '{"schema": "j", "i'), schema, "j").count() == 2
    with pytest.raises((PySparkException, Py4JError)):
        A.read_journal(spark, write(tmp_path / "b.jsonl", '{"sch\n' + good), schema, "j").collect()
    with pytest.raises((PySparkException, Py4JError)):
        A.read_journal(spark, write(tmp_path / "c.jsonl", '{"schema": "other", "id": 3}\n' + good), schema, "j").collect()
    with pytest.raises((PySparkException, Py4JError)):
        A.read_strict(spark, write(tmp_path / "d.jsonl", good + "\n\nbroken\n"), schema).collect()
    assert A.read_strict(spark, write(tmp_path / "e.jsonl", good + "\n\n"), schema).count() == 2


def test_optional_and_checked(spark, tmp_path):
    assert A.read_optional(spark, f"file://{tmp_path}/none", "a int").columns == ["a"]
    schema = "schema string, tasks array<struct<task_id: string, question: string>>"
    doc = lambda tag, ids: json.dumps({"schema": tag, "tasks": [{"task_id": i, "question": "q"} for i in ids]})
    assert A.read_checked(spark, write(tmp_path / "ok.json", doc("t", ["a", "b"])), schema, "t", "task_id").count() == 2
    for name, text in (("tag", doc("u", ["a"])), ("twice", doc("t", ["a", "a"])), ("null", doc("t", ["a", None]))):
        with pytest.raises(ValueError):
            A.read_checked(spark, write(tmp_path / f"{name}.json", text), schema, "t", "task_id")


def test_partitioned_names(spark, tmp_path):
    for name in ("x/theoremqa_001.json", "x/toolqa_002.json", "tasks/toolqa_003.json", "x/readme.json"):
        write(tmp_path / "root" / name, '{"v": 1}')
    got = {(r["dataset"], r["number"]) for r in A.read_partitioned(spark, f"file://{tmp_path}/root").collect()}
    assert got == {("theoremqa", 1), ("toolqa", 2)}
    assert A.read_partitioned(spark, f"file://{tmp_path}/root", ["toolqa"]).count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    p = f"file://{tmp_path}/out"
    assert Z.write_once(df, p) and not Z.write_once(df, p) and Z.write_once(df.limit(1), p, force=True)
    assert spark.read.json(p).count() == 1
    q = f"file://{tmp_path}/pub"
    assert [Z.publish_or_verify(df, q, "id", "n"), Z.publish_or_verify(df.orderBy(F.desc("id")), q, "id", "n")] == ["written", "same"]
    with pytest.raises(ValueError):
        Z.publish_or_verify(df.limit(1), q, "id", "n")
    path, there = Z.register_vectors(df.withColumn("t", F.col("id")), f"file://{tmp_path}/vec", "id", "t", "org/model")
    assert "org_model-" in path and not there
    order = df.select("id", F.col("n").alias("position"))
    assert [r["id"] for r in Z.merge_shards(df.orderBy(F.desc("n")), order, "id", "position").collect()] == ["a", "b"]
    for broken in (df.limit(1), df.unionByName(df.limit(1)), df.unionByName(df.limit(1).withColumn("id", F.lit("z")))):
        with pytest.raises(ValueError):
            Z.merge_shards(broken, order, "id", "position")


def test_results_round_trip(spark):
    r = spark.createDataFrame([("q", 2, "b", 0.5), ("q", 1, "a", 0.9)], "query_id string, rank int, item_id string, score double")
    g = spark.createDataFrame([("q", "a"), ("q", None)], "query_id string, item_id string")
    nested = Z.nest_results(r, g)
    assert nested.first()["gold_skill_ids"] == ["a"]
    assert {tuple(x) for x in Z.flatten_results(nested).collect()} == {("q", 1, "a", 0.9), ("q", 2, "b", 0.5)}


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, out, mark = (f"file://{tmp_path}/{x}" for x in ("src", "out", "mark"))
    rows = lambda a, b: spark.sql(f"select id as k, timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(id as int)) as ts from range({a}, {b})")
    rows(0, 10).write.parquet(src)
    once = lambda: J.once_delivered(J.event_stream(spark, src, "k bigint, ts timestamp", "ts", "1 hour"), "k")
    sink = lambda df, n: df.write.mode("append").parquet(out)
    J.run_batches(once(), sink, mark)
    rows(5, 15).write.mode("append").parquet(src)
    J.run_batches(once(), sink, mark)
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == list(range(15))
    w = J.windowed_counts(J.event_stream(spark, src, "k bigint, ts timestamp", "ts", "0 seconds"), "ts", "5 minutes")
    J.run_batches(w, lambda df, n: df.write.mode("append").parquet(f"{out}-w"), f"{mark}-w")
    assert all(r["n"] > 0 for r in spark.read.parquet(f"{out}-w").collect())
