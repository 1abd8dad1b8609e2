"""Scoring of results against instances, and statistics of scores (survey sections C15 to C26, F3, F10, F11, F25, F26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import answers as A
from quillmill.functions.strings import strip_think


def extracted(reply: Column, dataset: Column, question: Column, data: str) -> Column:
    """The answer a reply states, by the rules of its dataset (C17); theoremqa by an Arrow-batched function."""
    text = strip_think(F.coalesce(reply, F.lit("")))
    task = F.coalesce(F.col(f"{data}.task_type"), F.lit("BQA"))
    return (
        F.when(dataset == "toolqa", A.toolqa_extract(text))
        .when((dataset == "logicbench") & (task == "BQA"), A.bqa_extract(text))
        .when(dataset == "logicbench", A.mcqa_extract(text, F.coalesce(question, F.lit(""))))
        .when(dataset == "medcalcbench", A.medcalc_extract(text, F.col(f"{data}.output_type"), F.col(f"{data}.calculator_id")))
    )


def native_details(results: DataFrame, reply: str, dataset: str, question: str, data: str) -> DataFrame:
    """Adds (extracted_answer, correct, match_type) for the datasets that built-in expressions score."""
    ds = F.col(dataset)
    e = results.withColumn("extracted_answer", extracted(F.col(reply), ds, F.col(question), data))
    x, g = F.col("extracted_answer"), A.strip(F.coalesce(F.col(f"{data}.answer"), F.lit("")))
    kind = A.toolqa_match(x, g)
    medcalc = A.medcalc_correct(x, g, F.col(f"{data}.calculator_id"), F.col(f"{data}.output_type"), F.col(f"{data}.lower_limit"), F.col(f"{data}.upper_limit"))
    correct = F.when(ds == "toolqa", kind != "none").when(ds == "logicbench", A.strip(F.lower(x)) == F.lower(g)).when(ds == "medcalcbench", medcalc)
    return e.withColumn("match_type", F.when(ds == "toolqa", kind)).withColumn("correct", F.coalesce(correct, F.lit(False)))


def theorem_details(results: DataFrame, reply: str, data: str) -> DataFrame:
    """Adds (extracted_answer, correct, match_type) of theoremqa rows."""
    e = results.withColumn("extracted_answer", A.theorem_answer(strip_think(F.coalesce(reply, F.lit("")))))
    right = A.theorem_agrees(F.col("extracted_answer"), F.col(f"{data}.answer"), F.col(f"{data}.answer_type"))
    return e.withColumn("match_type", F.lit(None).cast("string")).withColumn("correct", right)


def details(results: DataFrame, reply: str, dataset: str, question: str, data: str, failed: Column | None = None) -> DataFrame:
    """Every result with its extracted answer and whether it is correct; unknown datasets are incorrect.

    A failed run counts as an empty reply. Each dataset is scored in its own branch of the plan.
    """
    masked = results if failed is None else results.withColumn(reply, F.when(F.coalesce(failed, F.lit(False)), F.lit("")).otherwise(F.col(reply)))
    is_theorem = F.coalesce(F.col(dataset) == "theoremqa", F.lit(False))
    native = native_details(masked.where(~is_theorem), reply, dataset, question, data)
    return native.unionByName(theorem_details(masked.where(is_theorem), reply, data))


def accuracy(scored: DataFrame, *keys: str) -> DataFrame:
    """(keys, correct, total, accuracy): a missing verdict is wrong, an empty group has accuracy 0."""
    right = F.coalesce(F.sum(F.col("correct").cast("bigint")), F.lit(0))
    return scored.groupBy(*keys).agg(right.alias("correct"), F.count(F.lit(1)).alias("total")).withColumn("accuracy", F.coalesce(F.try_divide("correct", "total"), F.lit(0.0)))


def one_standard_error(epochs: DataFrame, epoch: str, acc: str, n: str) -> DataFrame:
    """(best_epoch, best, se, chosen): the earliest epoch within one standard error of the best; NaN skipped.

    Equal best accuracies count for the earlier epoch. The input is one row an epoch.
    """
    good = epochs.where(~F.isnan(acc) & F.col(acc).isNotNull())
    best = good.orderBy(F.col(acc).desc(), F.col(epoch)).limit(1).select(F.col(epoch).alias("best_epoch"), F.col(acc).alias("best"), F.sqrt(F.col(acc) * (1 - F.col(acc)) / F.col(n)).alias("se"))
    near = good.join(F.broadcast(best), F.col(acc) >= F.col("best") - F.col("se"))  # one row
    return near.groupBy("best_epoch", "best", "se").agg(F.min(epoch).alias("chosen"))


def weighted_mean(rows: DataFrame, value: str, weight: str, *keys: str) -> DataFrame:
    """(keys, mean): sum of values over sum of weights, at least 1; NaN for an empty group."""
    total = F.greatest(F.coalesce(F.sum(weight), F.lit(0)), F.lit(1))
    return rows.groupBy(*keys).agg(F.coalesce(F.sum(value) / total, F.lit(float("nan"))).alias("mean"))


def format_valid(reply: Column, answer: Column, dataset: Column, question: Column) -> Column:
    """Acceptable by form alone: a reply with an answer; a choice only if the question offers choices."""
    some = (A.strip(F.coalesce(reply, F.lit(""))) != "") & (A.strip(F.coalesce(answer, F.lit(""))) != "")
    choice = F.coalesce(answer, F.lit("")).startswith("choice_")
    return some & ~(F.coalesce(dataset == "logicbench", F.lit(False)) & choice & ~F.contains(F.lower(F.coalesce(question, F.lit(""))), F.lit("choice_1")))


def compare_answer(reply: Column, truth: Column, dataset: Column, question: Column) -> Column:
    """Whether a reply agrees with an answer taken from another reply (C16): typed by the look of that answer.

    Dates, integers (rounded half to even), decimals (4 %) and words for medcalcbench; logicbench and toolqa by
    their own rules. theoremqa needs :func:`compared` and is null here; an empty truth is never met.
    """
    text, g = strip_think(F.coalesce(reply, F.lit(""))), A.strip(F.coalesce(truth, F.lit("")))
    none = F.lit(None)
    p = A.medcalc_extract(text, none.cast("string"), none.cast("int"))
    n = A.number(p)
    medcalc = (
        F.when(g.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), A._date(p) == A._date(g))
        .when(g.rlike(r"^-?\d+$"), F.bround(n) == A.number(g))
        .when(g.rlike(r"^-?\d+\.\d+$"), A.within(n, A.number(g)))
        .otherwise(F.lower(F.regexp_replace(A.strip(p), r"\.+$", "")) == F.lower(F.regexp_replace(g, r"\.+$", "")))
    )
    choice = F.lower(g).startswith("choice")
    logic = A.strip(F.lower(F.when(choice, A.mcqa_extract(text, F.coalesce(question, F.lit("")))).otherwise(A.bqa_extract(text)))) == F.lower(g)
    same = F.when(dataset == "toolqa", A.toolqa_match(A.toolqa_extract(text), g) != "none").when(dataset == "logicbench", logic).when(dataset == "medcalcbench", medcalc)
    return F.when(g == "", False).when(dataset == "theoremqa", None).otherwise(F.coalesce(same, F.lit(False)))


def compared(results: DataFrame, reply: str, truth: Column, dataset: str, question: str) -> DataFrame:
    """Adds same: :func:`compare_answer` for every dataset, theoremqa as a number within 4 % or equal words."""
    is_theorem = F.coalesce(F.col(dataset) == "theoremqa", F.lit(False))
    base = results.withColumn("__g", A.strip(F.coalesce(truth, F.lit(""))))
    native = base.where(~is_theorem).withColumn("same", compare_answer(F.col(reply), F.col("__g"), F.col(dataset), F.col(question)))
    found = base.where(is_theorem).withColumn("__x", A.theorem_answer(strip_think(F.coalesce(F.col(reply), F.lit("")))))
    theorem = found.withColumn("same", (F.col("__g") != "") & A.theorem_agrees(F.col("__x"), F.col("__g"), F.lit("float"))).drop("__x")
    return native.unionByName(theorem).drop("__g")


def masked_correct(correct: Column, truncated: Column, error: Column) -> Column:
    """Correct only if neither cut off nor failed."""
    return F.coalesce(correct, F.lit(False)) & ~F.coalesce(truncated, F.lit(False)) & (F.coalesce(error, F.lit("")) == "")


def admission_reason(truncated: Column, acceptable: Column, answer: Column, samples: Column) -> Column:
    """The first reason to reject a generated instance; '' if there is none."""
    return (
        F.when(F.coalesce(truncated, F.lit(False)), "truncated")
        .when(~F.coalesce(acceptable, F.lit(False)), "not_acceptable")
        .when(A.strip(F.coalesce(answer, F.lit(""))) == "", "no_answer")
        .when(F.coalesce(samples, F.lit(0)) == 0, "no_samples")
        .otherwise("")
    )


def calculators_of(skills: DataFrame, catalog: DataFrame) -> DataFrame:
    """(skill_id, calculator_id): calculators that use a tool of the skill (C19); catalog (calculator_id, tool)."""
    t = skills.where("tools is not null").select("skill_id", F.explode("tools.name").alias("tool"))
    return t.join(catalog, "tool").select("skill_id", "calculator_id").distinct()


def longest_span(labels: Column) -> Column:
    """Number of labels that count in training."""
    return F.size(F.filter(labels, lambda x: x != -100))


def best_of(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The row of the largest value of each key, the earlier among equals."""
    w = Window.partitionBy(key).orderBy(F.col(value).desc(), F.col(order))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
