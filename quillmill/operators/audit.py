"""Audits as rows of violations (survey H8 to H11, F8): one plan for each rule, all in one table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.strings import fingerprint
from quillmill.functions.text import normalize_exact


def _issue(df: DataFrame, name: str, ident: Column, detail: Column | str = "") -> DataFrame:
    d = F.lit(detail) if isinstance(detail, str) else detail
    return df.select(F.lit(name).alias("issue"), ident.cast("string").alias("id"), d.cast("string").alias("detail"))


def union(parts: list[DataFrame]) -> DataFrame:
    """All violations."""
    return reduce(DataFrame.unionByName, parts)


def universe(skills: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(prefix, expected, found, distinct_found, valid): ids of each dataset against the closed universe (F8)."""
    want = skills.sparkSession.createDataFrame(sorted(expected.items()), "prefix string, expected bigint")
    have = skills.groupBy(F.regexp_replace("skill_id", "_[^_]*$", "").alias("prefix")).agg(F.count(F.lit(1)).alias("found"), F.countDistinct("skill_id").alias("distinct_found"))
    j = want.join(have, "prefix", "full_outer").fillna(0, ["expected", "found", "distinct_found"])
    return j.withColumn("valid", (F.col("expected") == F.col("found")) & (F.col("found") == F.col("distinct_found")))


def leakage(rows: DataFrame, skills: DataFrame, id_col: str, text: str, gold: str, overlap: DataFrame, negatives_of: str | None = None, norm: Callable[[Column | str], Column] = normalize_exact) -> DataFrame:
    """(issue, id, detail) of training rows (H8).

    missing_question, missing_or_unknown_source_skills, duplicate_id, duplicate_normalized_question,
    exact_test_question_overlap, near_test_question_overlap (from ``overlap``: (id, kind)), gold_skill_name_in_query,
    empty_training_input and, for anchors, anchor_is_not_negative: the row's gold holds the skill it is a negative of.
    """
    n = norm(text)
    ident = F.col(id_col)
    known = skills.select(F.col("skill_id").alias("__s"))
    parts = [_issue(rows.where(F.coalesce(n, F.lit("")) == ""), "missing_question", ident)]
    own = rows.select(ident.alias("i"), F.explode_outer(gold).alias("g"))
    parts.append(_issue(own.join(known, F.col("g") == F.col("__s"), "left_anti").groupBy("i").agg(F.min("g").alias("g")), "missing_or_unknown_source_skills", F.col("i"), F.coalesce(F.col("g"), F.lit(""))))
    parts.append(_issue(rows.groupBy(ident.alias("i")).agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "duplicate_id", F.col("i"), F.col("c")))
    same = rows.withColumn("__n", n).where("__n <> ''").groupBy("__n").agg(F.countDistinct(ident).alias("c"), F.min(ident).alias("i")).where("c > 1")
    parts.append(_issue(same, "duplicate_normalized_question", F.col("i"), F.col("c")))
    for kind in ("exact", "near"):
        parts.append(_issue(overlap.where(F.col("kind") == kind), f"{kind}_test_question_overlap", F.col(id_col)))
    named = rows.select(ident.alias("i"), n.alias("q"), F.explode(gold).alias("skill_id")).join(skills.select("skill_id", norm("name").alias("nm")).where("nm <> ''"), "skill_id")
    parts.append(_issue(named.where(F.contains("q", "nm")).select("i", "skill_id").distinct(), "gold_skill_name_in_query", F.col("i"), F.col("skill_id")))
    if negatives_of:
        parts.append(_issue(rows.where(F.array_contains(F.coalesce(gold, F.array().cast("array<string>")), F.col(negatives_of))), "anchor_is_not_negative", ident, F.col(negatives_of)))
    empty = rows.agg(F.count(F.lit(1)).alias("c")).where("c = 0")
    parts.append(_issue(empty, "empty_training_input", F.lit("")))
    return union(parts)


#: What the provenance of an anchor file must say.
ANCHOR_SOURCE, ANCHOR_POLICY = "synthetic_train_pool", "retrieval_top1_then_topk_loose"
TEST_FILES = 4


def artifact_audit(files: DataFrame, rows: DataFrame, skills: DataFrame, expected: dict[str, int], expected_skills: DataFrame, test_files: int, retriever: str, norm: Callable[[Column | str], Column] = normalize_exact) -> DataFrame:
    """(issue, id, detail) of the files of trajectories and anchors that a training set is made of (H8).

    ``files`` has a row a file: path, kind (trajectory or anchor), directory, skill_id and, of anchors, source_kind,
    model, retriever, retriever_model, reranker_model, near_policy and the numbers of nearmiss and random rows
    requested and kept. ``rows`` has path, id, question, source_question and source_skill_ids. Kinds of issues:
    invalid_closed_world_skill_universe, incomplete_test_suite_for_decontamination, incomplete_trajectory_directory and
    incomplete_anchor_directory (a file a skill of ``expected_skills``), anchor_source_not_synthetic,
    anchor_missing_provenance_field, anchor_retriever_protocol_mismatch, anchor_near_policy_mismatch,
    anchor_unknown_target_skill, incomplete_anchor_counts, anchor_missing_source_question,
    anchor_missing_or_unknown_source_skills, anchor_is_not_negative, cross_trajectory_duplicate_id, and the warning
    cross_skill_duplicate_questions_retained. Rows without words are no rows here (they are missing_question in
    :func:`leakage`); a null counts as missing everywhere. The first file by path is the reference for later ones.
    """
    path, known = F.col("path"), skills.select(F.col("skill_id").alias("__s")).where("__s is not null").distinct()
    parts = []
    worlds = universe(skills, expected).agg(F.min(F.col("valid").cast("int")).alias("ok"), F.sum("found").alias("c"), F.sum("distinct_found").alias("u"))
    parts.append(_issue(worlds.where(f"coalesce(ok, 0) = 0 or u <> {sum(expected.values())}"), "invalid_closed_world_skill_universe", F.lit(""), F.coalesce("c", F.lit(0))))
    if test_files != TEST_FILES:
        parts.append(_issue(skills.sparkSession.range(1), "incomplete_test_suite_for_decontamination", F.lit(""), F.lit(test_files)))
    want = expected_skills.select(F.col("skill_id").alias("__w"), F.lit(1).alias("__in")).distinct()
    n_want = want.count()  # the closed world of skills
    have = files.select("kind", "directory", F.col("skill_id").alias("__w")).distinct().join(want, "__w", "left")
    inside = F.count("__in")
    counts = have.groupBy("kind", "directory").agg((F.lit(n_want) - inside + F.count(F.lit(1)) - inside).alias("c")).where("c > 0")
    for kind in ("trajectory", "anchor"):
        parts.append(_issue(counts.where(F.col("kind") == kind), f"incomplete_{kind}_directory", F.col("directory"), F.col("c")))
    anchors = files.where("kind = 'anchor'")
    parts.append(_issue(anchors.where(~F.col("source_kind").eqNullSafe(ANCHOR_SOURCE)), "anchor_source_not_synthetic", path, F.coalesce("source_kind", F.lit(""))))
    fields = ["model", "retriever", "retriever_model", "near_policy", *(["reranker_model"] if retriever.endswith("_rerank") else [])]
    lacking = F.filter(F.array(*(F.when(F.coalesce(f, F.lit("")) == "", F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    parts.append(_issue(anchors.select("path", F.explode(lacking).alias("f")), "anchor_missing_provenance_field", path, F.col("f")))
    parts.append(_issue(anchors.where(~F.col("retriever").eqNullSafe(retriever)), "anchor_retriever_protocol_mismatch", path, F.coalesce("retriever", F.lit(""))))
    parts.append(_issue(anchors.where(~F.col("near_policy").eqNullSafe(ANCHOR_POLICY)), "anchor_near_policy_mismatch", path, F.coalesce("near_policy", F.lit(""))))
    parts.append(_issue(anchors.join(known, F.col("skill_id") == F.col("__s"), "left_anti"), "anchor_unknown_target_skill", path, F.coalesce("skill_id", F.lit(""))))
    size = rows.groupBy(F.col("path").alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    numbers = [F.coalesce(c, F.lit(-1)) for c in ("nearmiss_requested", "nearmiss_kept", "random_requested", "random_kept")]
    sized = anchors.join(size, path == F.col("__p"), "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    wrong = (F.least(*numbers) < 0) | (numbers[0] != numbers[1]) | (numbers[2] != numbers[3]) | (F.col("__n") != numbers[1] + numbers[3])
    parts.append(_issue(sized.where(wrong), "incomplete_anchor_counts", path, F.col("__n")))
    real = rows.withColumn("__q", norm("question")).where("__q <> ''").join(files.select(F.col("path").alias("__f"), "kind", "skill_id"), path == F.col("__f"))
    ident = F.concat_ws("#", "path", "id")
    of_anchors = real.where("kind = 'anchor'")
    parts.append(_issue(of_anchors.where("coalesce(source_question, '') = ''"), "anchor_missing_source_question", ident))
    each = of_anchors.select("path", "id", F.explode_outer("source_skill_ids").alias("g"))
    parts.append(_issue(each.join(known, F.col("g") == F.col("__s"), "left_anti").select("path", "id").distinct(), "anchor_missing_or_unknown_source_skills", ident))
    parts.append(_issue(of_anchors.where(F.array_contains("source_skill_ids", F.col("skill_id"))), "anchor_is_not_negative", ident, F.col("skill_id")))
    steps = real.where("kind = 'trajectory'")
    firsts = steps.groupBy(F.col("id").alias("__i")).agg(F.min("path").alias("__first"), F.max("path").alias("__last")).where("__first <> __last")
    parts.append(_issue(steps.join(firsts, F.col("id") == F.col("__i")).where(path != F.col("__first")), "cross_trajectory_duplicate_id", ident, F.col("__first")))
    asked = steps.groupBy("__q").agg(F.min("path").alias("__first"))
    first_rows = steps.join(asked.select(F.col("__q").alias("__k"), "__first"), F.col("__q") == F.col("__k")).where(path != F.col("__first")).agg(F.count(F.lit(1)).alias("c")).where("c > 0")
    parts.append(_issue(first_rows, "cross_skill_duplicate_questions_retained", F.lit(""), F.col("c")))
    return union(parts)


def retrieval_audit(results: DataFrame, instances: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(issue, id, detail) of a ranking (query_id, rank, item_id).

    retrieval_coverage_mismatch for instances without a ranking and rankings without an instance, empty_ranking,
    wrong_ranking_length, duplicate_retrieved_skill, retrieved_skill_outside_corpus.
    """
    per = results.where("item_id is not null").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("u"))
    have, want = results.select("query_id").distinct(), instances.select("query_id").distinct()
    outside = results.where("item_id is not null").join(corpus.select("item_id").distinct(), "item_id", "left_anti").select("query_id", "item_id").distinct()
    return union(
        [
            _issue(want.join(have, "query_id", "left_anti"), "retrieval_coverage_mismatch", F.col("query_id"), "missing"),
            _issue(have.join(want, "query_id", "left_anti"), "retrieval_coverage_mismatch", F.col("query_id"), "unexpected"),
            _issue(have.join(per, "query_id", "left_anti"), "empty_ranking", F.col("query_id")),
            _issue(per.where(F.col("n") != k), "wrong_ranking_length", F.col("query_id"), F.col("n")),
            _issue(per.where("u < n"), "duplicate_retrieved_skill", F.col("query_id"), F.col("n") - F.col("u")),
            _issue(outside, "retrieved_skill_outside_corpus", F.col("query_id"), F.col("item_id")),
        ]
    )


def content_id(rows: DataFrame, *columns: str) -> DataFrame:
    """One row (content_id): a hash of the rows' content whatever their order.

    Each row is hashed; the hashes are hashed once more in buckets of their first digits, so no task holds more
    than its share of them, and the few bucket hashes together.
    """
    row = F.sha2(F.to_json(F.struct(*columns)), 256)
    buckets = rows.select(row.alias("h")).groupBy(F.substring("h", 1, 3).alias("b")).agg(fingerprint(F.collect_list("h")).alias("h"))
    return buckets.agg(fingerprint(F.collect_list("h")).alias("content_id"))
