"""Task pools, joins of results with instances, and routing (survey sections B27, B28, E, F2, F23, G)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import normalize_exact


def merge_questions(rows: DataFrame, id_col: str, text: str, lists: list[str], norm: Callable[[Column | str], Column] = normalize_exact) -> DataFrame:
    """One row a normalised question: first id and wording, sorted unions of the list columns, members (F2).

    Copies are folded in every task before they move, so a question that holds a third of the rows is no heavy
    group; rows without words are dropped.
    """
    n = rows.withColumn("norm", norm(text)).where("norm <> ''")
    clean = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    base = n.groupBy("norm").agg(F.min(id_col).alias(id_col), F.min_by(text, id_col).alias(text), F.countDistinct(id_col).alias("members"))
    for c in lists:
        e = n.select("norm", F.explode(clean(c)).alias("x")).distinct().groupBy("norm").agg(F.array_sort(F.collect_set("x")).alias(c))
        base = base.join(e, "norm", "left").withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return base


def infer_origin(rows: DataFrame, skills: DataFrame, id_col: str, *candidates: str) -> DataFrame:
    """(id, origin): sorted skill ids of the first non-empty list column, else every skill id that prefixes the id.

    The catalog of skills is fixed; ids are matched by equality on the prefixes that a catalog id can have, one for
    each length in it, not by comparing all rows with all skills.
    """
    lists = [F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")) for c in candidates]
    own = F.coalesce(*(F.when(F.size(x) > 0, x) for x in lists)) if lists else F.lit(None).cast("array<string>")
    tagged = rows.select(F.col(id_col), own.alias("own"))
    lengths = F.broadcast(skills.agg(F.array_sort(F.collect_set(F.length("skill_id"))).alias("lengths")))  # one row
    open_rows = tagged.where("own is null").join(lengths)
    starts = open_rows.select(id_col, F.explode(F.array_distinct(F.transform("lengths", lambda n: F.substr(F.col(id_col), F.lit(1), n)))).alias("skill_id"))
    guessed = starts.join(skills.select("skill_id").distinct(), "skill_id").groupBy(id_col).agg(F.array_sort(F.collect_set("skill_id")).alias("origin"))
    known = tagged.where("own is not null").select(id_col, F.array_sort(F.array_distinct("own")).alias("origin"))
    return known.unionByName(guessed)


def adapter_routes(instances: DataFrame, gold: str, adapters: DataFrame, id_col: str) -> DataFrame:
    """(id, adapter): the first gold skill that has an adapter, null as fallback."""
    e = instances.select(id_col, F.posexplode(gold).alias("pos", "skill_id")).join(adapters.select("skill_id").distinct(), "skill_id")
    first = e.groupBy(id_col).agg(F.min_by("skill_id", "pos").alias("adapter"))
    return instances.select(id_col).join(first, id_col, "left")


def retrieved_routes(instances: DataFrame, ranked: DataFrame, adapters: DataFrame, id_col: str) -> DataFrame:
    """(id, adapter): the top-ranked skill if it has an adapter, null as fallback."""
    top = ranked.where("rank = 1").join(adapters.select(F.col("skill_id").alias("item_id")).distinct(), "item_id").select(F.col("query_id").alias(id_col), F.col("item_id").alias("adapter"))
    return instances.select(id_col).join(top, id_col, "left")


def blank_unless(content: Column, keep: Column) -> Column:
    """The content where it is kept, an empty text elsewhere."""
    return F.when(keep, content).otherwise("")


def assemble(assigned: DataFrame, answers: DataFrame, usable: Column, group: str, kind: str, rank: str, key: str, quota: Column) -> DataFrame:
    """Assigned rows with a usable answer in order, up to the quota of their group and kind."""
    j = assigned.join(answers, key).where(usable)
    w = Window.partitionBy(group, kind).orderBy(rank)
    return j.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= quota).withColumnRenamed("__r", "slot")


def with_demos(skills: DataFrame, demos: DataFrame) -> DataFrame:
    """(skill_id, content): skills followed by their demonstrations in order."""
    text = demos.groupBy("skill_id").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("d"))
    j = skills.select("skill_id", "content").join(text, "skill_id", "left")
    return j.select("skill_id", F.concat_ws("\n\n", "content", F.array_join(F.transform(F.coalesce("d", F.array()), lambda x: x["text"]), "\n\n")).alias("content"))


def difference(expected: DataFrame, found: DataFrame, key: str, show: int = 30) -> DataFrame:
    """(side, n, sample): ids that are missing or extra, with the first few."""
    e, f = expected.select(key).distinct(), found.select(key).distinct()

    def side(name: str, rows: DataFrame) -> DataFrame:
        first = rows.orderBy(key).limit(show).agg(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), ",").alias("sample"))
        return rows.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(first)).select(F.lit(name).alias("side"), "n", "sample")  # one row each

    return side("missing", e.join(f, key, "left_anti")).unionByName(side("extra", f.join(e, key, "left_anti")))


def exact_cover(results: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(violation, n): ids missing, unexpected or repeated, so that all zero means every id exactly once."""
    per = results.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    j = expected.select(key, F.lit(1).alias("__e")).distinct().join(per, key, "full_outer")
    c = lambda cond: F.count(F.when(cond, 1))
    row = j.agg(c(F.col("__n").isNull()).alias("missing"), c(F.col("__e").isNull()).alias("unexpected"), c(F.col("__n") > 1).alias("repeated"))
    names = ("missing", "unexpected", "repeated")
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("violation"), F.col(n).alias("n")) for n in names))).alias("x")).select("x.violation", "x.n")
