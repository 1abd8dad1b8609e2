"""Selections, gates and plain-Python guards."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillmill.operators import selection as S


def test_options():
    assert S.parse_options(["a.b=1", "a.c=x=y", 'd=["z"]', "e="]) == {"a": {"b": 1, "c": "x=y"}, "d": ["z"], "e": ""}
    with pytest.raises(ValueError):
        S.parse_options(["novalue"])


def test_paths():
    S.check_paths(["/data/train.json"], ["/out/x/y"], ["/out/"])
    for bad in ((["/d/bench_items.json"], []), ([], ["/elsewhere/x"]), ([], ["/out/../x"])):
        with pytest.raises(ValueError):
            S.check_paths(*bad, ["/out"])
    assert S.artifact_path("/r/", "toolqa", "tasks", "a.json") == "/r/dataset=toolqa/stage=tasks/a.json"


def test_selection(spark):
    s = spark.createDataFrame([("a_1",), ("a_2",), ("b_1",)], "skill_id string")
    assert [r[0] for r in S.select_skills(s, ["a"], ["a_2", "b_1"]).collect()] == ["a_2"]
    with pytest.raises(ValueError):
        S.select_skills(s, names=["zz"])
    t = spark.createDataFrame([(2, "x", None), (1, "y", "v")], "id int, k string, name string")
    assert S.first_value(t, "id") == ("name", "v") and S.first_value(t.select("id", "k"), "id") is None
    g = spark.createDataFrame([('  "short" ',), ("long enough text",), (None,)], "q string")
    assert [r[0] for r in g.select(S.admissible_question(F.col("q"))).collect()] == [False, True, False]


def test_artifact_audit(spark):
    from quillmill.operators import audit as U

    fields = "path string, kind string, directory string, skill_id string, source_kind string, model string, retriever string, retriever_model string, reranker_model string, near_policy string, nearmiss_requested int, nearmiss_kept int, random_requested int, random_kept int"
    good = ("a1", "anchor", "anchors", "x_1", U.ANCHOR_SOURCE, "m", "dense_rerank", "e", "r", U.ANCHOR_POLICY, 1, 1, 1, 1)
    bad = ("a2", "anchor", "anchors", None, None, "", "dense", None, "", None, 2, None, 0, 0)
    steps = [("t1", "trajectory", "steps", "x_1", *[None] * 10), ("t2", "trajectory", "steps", "x_2", *[None] * 10)]
    files = spark.createDataFrame([good, bad, *steps], fields)
    rows = spark.createDataFrame(
        [("a1", "1", "one question", "s", ["x_2"]), ("a1", "2", "two questions", "s", ["x_1"]), ("a2", "3", "more", None, None), ("t1", "i", "Same question!", None, None), ("t2", "i", "same question", None, None), ("t2", "j", "  ", None, None)],
        "path string, id string, question string, source_question string, source_skill_ids array<string>",
    )
    skills = spark.createDataFrame([("x_1", 0), ("x_2", 1)], "skill_id string, path int")
    run = lambda f, r, s, n: sorted((x["issue"], x["id"], x["detail"]) for x in U.artifact_audit(f, r, s, {"x": 2}, skills, n, "dense_rerank").collect())
    assert run(files, rows, skills, 4) == sorted([
        ("incomplete_anchor_directory", "anchors", "2"),  # x_2 lacks, null is none of the skills
        ("anchor_source_not_synthetic", "a2", ""), *[("anchor_missing_provenance_field", "a2", f) for f in ("model", "near_policy", "reranker_model", "retriever_model")],
        ("anchor_retriever_protocol_mismatch", "a2", "dense"), ("anchor_near_policy_mismatch", "a2", ""), ("anchor_unknown_target_skill", "a2", ""), ("incomplete_anchor_counts", "a2", "1"),
        ("anchor_missing_source_question", "a2#3", ""), ("anchor_missing_or_unknown_source_skills", "a2#3", ""), ("anchor_is_not_negative", "a1#2", "x_1"),
        ("cross_trajectory_duplicate_id", "t2#i", "t1"), ("cross_skill_duplicate_questions_retained", "", "1"),
    ])
    assert run(files.limit(0), rows.limit(0), skills.limit(0), 3) == [("incomplete_test_suite_for_decontamination", "", "3"), ("invalid_closed_world_skill_universe", "", "0")]


def test_keyword_and_question_format(spark):
    from quillmill.functions.prompts import question_format
    from quillmill.functions.strings import keyword

    texts = ["The dog saw Deep Residual nets 4 all", "it Is So low", None, "", "Graph-based learning x y z", "Les Réunions de Paris", "ab " * 300 + "Late Name"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(keyword(F.col("t"), ["the"])).collect()]
    assert got == ["Residual nets 4 all", "Is So low", "neural network", "neural network", "Graph-based learning x", "Paris", "neural network"]
    df = spark.createDataFrame([("toolqa", ["a"]), ("medcalcbench", ["BMI", "GFR"]), ("medcalcbench", None), ("other", None), (None, None)], "d string, c array<string>")
    out = [r[0] for r in df.select(question_format(F.col("d"), F.col("c"))).collect()]
    assert "Calculators: BMI, GFR." in out[1] and "Calculators" not in out[0] + out[2] and out[3].count("\n") == 1 and out[4]
