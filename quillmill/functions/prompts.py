"""Prompt templates as a table, so that rendering is a join and new datasets need no code (survey B6 to B8, B31)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.strings import with_skills

# The engine's own short wording; {question} is replaced by the question.
TEMPLATES = [
    ("theoremqa", "Answer with a number, a list of numbers, True/False or an option.", "Problem:{question}\nSolution:"),
    ("logicbench", "", "{question}"),
    ("toolqa", "Use the tools step by step.", "Question: {question}"),
    ("medcalcbench", "End with a line ANSWER: <value>.", "{question}"),
    ("champ", "Work as a mathematician.", "{question}\n\nANSWER: <your answer>"),
    ("bigcodebench", "", "{question}\n\nReply with code only."),
]


def templates(spark: SparkSession, rows: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(dataset, system, template) of the registered datasets."""
    return spark.createDataFrame(TEMPLATES if rows is None else rows, "dataset string, system string, template string")


def render(instances: DataFrame, prompts: DataFrame, skills: Column | None = None) -> DataFrame:
    """Adds (system, user); datasets without a template give no row, as they can't be run."""
    j = instances.join(prompts, "dataset")
    user = F.replace(F.col("template"), F.lit("{question}"), F.coalesce("question", F.lit("")))
    return j.withColumn("user", user if skills is None else with_skills(user, skills))


def retrieval_query(system: Column, user: Column, shots: Column | None = None) -> Column:
    """What a retriever is asked: user prompt, system prompt and examples, one under the other."""
    parts = [user, system] + ([] if shots is None else [shots])
    return F.concat_ws("\n", *(F.when(p != "", p) for p in parts))


# What a generated question must be like, for each dataset, in the engine's own wording.
QUESTION_FORMATS = {
    "theoremqa": "The answer must be a number, True or False, an option (a) to (f), or a list of numbers.",
    "logicbench": "Ask for yes or no, or end with at most five options, choice_1: to choice_5:.",
    "medcalcbench": "Describe a patient and name the score to calculate; the answer is a number or a date.",
    "toolqa": "Ask directly, in less than 200 characters, for a fact that only tool calls can find; give no facts of the database.",
}
SELF_CONTAINED = "The question must hold all parameters that it needs."


def question_format(dataset: Column, covers: Column | None = None) -> Column:
    """How a question for a dataset must be written; ``covers`` names the calculators of its skill.

    A dataset without a format of its own has the general sentence only; null and empty lists name nothing.
    """
    table = F.create_map(*(F.lit(x) for kv in QUESTION_FORMATS.items() for x in kv))
    own = F.try_element_at(table, dataset)
    named = F.lit(None).cast("string") if covers is None else F.when((dataset == "medcalcbench") & (F.size(covers) > 0), F.concat(F.lit("Calculators: "), F.array_join(covers, ", "), F.lit(".")))
    return F.concat_ws("\n", F.concat(F.lit("Question format for "), dataset), own, named, F.lit(SELF_CONTAINED))
