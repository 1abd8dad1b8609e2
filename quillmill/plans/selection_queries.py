"""Queries of selections and gates (survey section D)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import prompts as T
from quillmill.functions.text import normalize_native
from quillmill.operators import selection as S
from quillmill.operators.dedup import Norm
from quillmill.plans.registry import core
from quillmill.plans.sqltext import norm
from quillmill.session import table


@core.exact
@core.query(
    "held_out_excluded",
    f"""with t as (select distinct instance_id, question, lower(trim(split)) as split from synthetic_task), h as (select {norm('question')} as n from t where split in ('val', 'validation', 'dev') and question is not null)
    select distinct instance_id from t where split in ('train', 'training') and (coalesce({norm('question')}, '') = '' or {norm('question')} not in (select n from h where n <> ''))""",
)
def held_out_excluded(spark: SparkSession, d: str, form: Norm = normalize_native) -> DataFrame:
    """Training tasks whose question is in no validation task."""
    t = table(spark, d, "synthetic_task").select("instance_id", "question", F.lower(F.trim("split")).alias("split")).distinct()
    return S.exclude_held_out(t.where(F.col("split").isin("train", "training")), t.where(F.col("split").isin("val", "validation", "dev")), "question", "question", form).select("instance_id").distinct()


@core.query("question_gate", """with t as (select distinct instance_id, question from synthetic_task) select instance_id, length(regexp_replace(coalesce(question, ''), '^[\\s"'']+|[\\s"'']+$', '', 'g')) >= 10 as admissible from t""")
def question_gate(spark: SparkSession, d: str) -> DataFrame:
    """D11."""
    t = table(spark, d, "synthetic_task").select("instance_id", "question").distinct()
    return t.select("instance_id", S.admissible_question(F.col("question")).alias("admissible"))


@core.query("passages", "select doc_id, substr(text, 1, 1200) as passage from documents where length(text) >= 300")
def passages(spark: SparkSession, d: str) -> DataFrame:
    """D12."""
    return table(spark, d, "documents").select("doc_id", S.passage(F.col("text")).alias("passage")).where("passage is not null")


@core.query("selected_skills", "select skill_id from skill_corpus where regexp_replace(skill_id, '_[^_]*$', '') in ('toolqa', 'logicbench')")
def selected_skills(spark: SparkSession, d: str) -> DataFrame:
    """D13."""
    return S.select_skills(table(spark, d, "skill_corpus"), datasets=["toolqa", "logicbench"]).select("skill_id")


@core.query("published_order", "select instance_id, dataset from bench_instance")
def published_order(spark: SparkSession, d: str) -> DataFrame:
    """F22."""
    return S.ordered(table(spark, d, "bench_instance").select("instance_id", "dataset"), "instance_id")


@core.query(
    "missing_demos",
    r"""with r as (select distinct record_id, raw_output from inference_record where raw_output is not null), m as (select record_id, list_transform(regexp_extract_all(raw_output, '\b[A-Z]\w+\['), lambda x: rtrim(x, '[')) as m from r),
    u as (select record_id, list_filter(m, lambda x, i: list_position(m, x) = i and x <> 'Finish') as l from m),
    f as (select record_id, flatten(list_transform(l, lambda t: case when t in ('FilterDB', 'GetValue') then ['LoadDB', t] else [t] end)) as f from u)
    select record_id, array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), ',') as tools from f""",
)
def missing_demos(spark: SparkSession, d: str) -> DataFrame:
    """Tools that a reply mentions, a loader before those that need one; only Finish is shown already."""
    r = table(spark, d, "inference_record").where("raw_output is not null").select("record_id", "raw_output").distinct()
    mentioned = F.array_distinct(F.transform(F.regexp_extract_all("raw_output", F.lit(r"\b[A-Z]\w+\["), F.lit(0)), lambda x: F.rtrim(x, F.lit("["))))
    out = S.missing_demos(mentioned, F.array(F.lit("Finish")), {"FilterDB": "LoadDB", "GetValue": "LoadDB"})
    return r.select("record_id", F.array_join(out, ",").alias("tools"))


@core.query("artifact_paths", "select distinct dataset, 'runs/dataset=' || dataset || '/stage=eval/' || dataset || '_001.json' as path from bench_instance where dataset is not null")
def artifact_paths(spark: SparkSession, d: str) -> DataFrame:
    """Where the evaluation of each dataset lies (the datasets are a closed list)."""
    names = sorted(r["dataset"] for r in table(spark, d, "bench_instance").where("dataset is not null").select("dataset").distinct().collect())
    return spark.createDataFrame([(n, S.artifact_path("runs/", n, "eval", f"{n}_001.json")) for n in names], "dataset string, path string")


@core.query(
    "path_guards",
    "select path, path like 'shared/%' and not contains(path, '..') and not contains(regexp_extract(path, '[^/]*$'), 'bench') as allowed from (values ('shared/run/a.json'), ('shared/../a.json'), ('other/a.json'), ('shared/bench_questions.json')) t(path)",
)
def path_guards(spark: SparkSession, d: str) -> DataFrame:
    """Paths as output, and as input where they are made from test material."""

    def allowed(p: str) -> bool:
        try:
            S.check_paths([p], [p], ["shared"])
        except ValueError:
            return False
        return True

    paths = ["shared/run/a.json", "shared/../a.json", "other/a.json", "shared/bench_questions.json"]
    return spark.createDataFrame([(p, allowed(p)) for p in paths], "path string, allowed boolean")


@core.query("option_values", "select * from (values ('model.name', 'small'), ('train.epochs', '3'), ('train.rate', '0.5'), ('flag', 'true')) t(option, value)")
def option_values(spark: SparkSession, d: str) -> DataFrame:
    """Options by dotted keys, flattened again."""
    got = S.parse_options(["model.name=small", "train.epochs=3", "train.rate=0.5", "flag=true"])

    def flat(at: dict, before: str = "") -> list[tuple[str, str]]:
        return [x for k, v in at.items() for x in (flat(v, before + k + ".") if isinstance(v, dict) else [(before + k, v if isinstance(v, str) else json.dumps(v))])]

    return spark.createDataFrame(flat(got), "option string, value string")


@core.query(
    "first_values",
    "select 'nation' as name, 'n_nationkey' as first_column, cast(min(n_nationkey) as varchar) as first_value from nation union all select 'region', 'r_regionkey', cast(min(r_regionkey) as varchar) from region",
)
def first_values(spark: SparkSession, d: str) -> DataFrame:
    """The first column of tables that is no id, and its first value."""
    rows = [(name, *S.first_value(table(spark, d, name), order)) for name, order in (("nation", "n_name"), ("region", "r_name"))]
    return spark.createDataFrame(rows, "name string, first_column string, first_value string")


@core.query("retrieval_prompts", "select instance_id, concat_ws(chr(10), nullif(question, ''), 'Use ' || dataset, nullif(array_to_string(skill_annotations, ','), '')) as prompt from bench_instance")
def retrieval_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What a retriever is asked for every test item."""
    return table(spark, d, "bench_instance").select(
        "instance_id", T.retrieval_query(F.concat(F.lit("Use "), "dataset"), F.col("question"), F.array_join("skill_annotations", ",")).alias("prompt")
    )


@core.query(
    "question_formats",
    f"""select skill_id, concat_ws(chr(10), 'Question format for ' || regexp_replace(skill_id, '_[^_]*$', ''),
      case regexp_replace(skill_id, '_[^_]*$', '') {' '.join(f"when '{k}' then '{v}'" for k, v in T.QUESTION_FORMATS.items())} end,
      case when skill_id like 'medcalcbench%' and len(tools) > 0 then 'Calculators: ' || array_to_string(list_transform(tools, lambda t: t.name), ', ') || '.' end, '{T.SELF_CONTAINED}') as instruction from skill_corpus""",
)
def question_formats(spark: SparkSession, d: str) -> DataFrame:
    """How a question for each skill must be written, with its tools as calculators."""
    skills = table(spark, d, "skill_corpus")
    return skills.select("skill_id", T.question_format(F.regexp_replace("skill_id", "_[^_]*$", ""), F.col("tools.name")).alias("instruction"))
