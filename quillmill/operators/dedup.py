"""Exact and near duplicates and decontamination of the engine's own pipeline (survey section H)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.strings import normalized_gram_set, number_signature
from quillmill.functions.text import normalize_exact
from quillmill.session import cut

#: The normalisation that texts compare in: the exact one, or the JVM-side form for text that is in NFKC form already.
Norm = Callable[[Column | str], Column]


BROADCAST_GRAMS = 2_000_000  #: grams of the queries up to which they are broadcast (about 50 MB)


def exact_dedup(rows: DataFrame, text: str, order: str, norm: Norm = normalize_exact) -> DataFrame:
    """The first row by ``order`` of every normalised text; rows without words are dropped (H1)."""
    n = rows.withColumn("__n", norm(text)).where("__n <> ''")
    w = Window.partitionBy("__n").orderBy(order)
    return n.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__n", "__r")


def _gram_sets(rows: DataFrame, id_col: str, text: str, side: str, norm: Norm = normalize_exact) -> DataFrame:
    """(id, grams as 64-bit hashes) of rows that have words."""
    n = rows.select(F.col(id_col).alias(side), norm(text).alias("__n")).where("__n <> ''")
    return n.select(side, normalized_gram_set(F.col("__n")).alias(f"g{side}")).distinct()


def near_overlap(queries: DataFrame, corpus: DataFrame, query_id: str, query_text: str, doc_id: str, doc_text: str, t: float = 0.92, norm: Norm = normalize_exact) -> DataFrame:
    """(a, b, similarity): pairs of a query and a document with Jaccard similarity of their grams of at least t.

    Counts shared grams by an equi-join on the gram (H3, E6). Before that, documents are left out that have fewer
    than t of their grams among those of all queries: counted in place where these grams are few enough to be
    broadcast, so that grams that many documents share are joined only for documents that may match.
    """
    a, b = cut(_gram_sets(queries, query_id, query_text, "a", norm), "query-grams"), cut(_gram_sets(corpus, doc_id, doc_text, "b", norm), "corpus-grams")
    left = a.select("a", F.size("ga").alias("na"), F.explode("ga").alias("g"))
    asked = left.select(F.col("g").alias("h")).distinct()
    asked = F.broadcast(asked) if left.count() <= BROADCAST_GRAMS else asked
    right = b.select("b", F.size("gb").alias("nb"), F.explode("gb").alias("h")).join(asked, "h", "left_semi")
    able = right.groupBy("b").agg(F.count(F.lit(1)).alias("__m"), F.first("nb").alias("__nb")).where(F.col("__m") >= F.lit(t) * F.col("__nb") - F.lit(1e-9)).select("b")
    right = right.join(able, "b", "left_semi")
    fits = (F.col("g") == F.col("h")) & (F.least("na", "nb") >= F.lit(t) * F.greatest("na", "nb") - F.lit(1e-9))
    both = left.join(right, fits).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("n"))
    s = F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))
    return both.select("a", "b", s.alias("similarity")).where(F.col("similarity") >= F.lit(t) - 1e-12)


def near_overlap_prefix(queries: DataFrame, corpus: DataFrame, query_id: str, query_text: str, doc_id: str, doc_text: str, t: float = 0.92, norm: Norm = normalize_exact) -> DataFrame:
    """The result of :func:`near_overlap` by prefix filtering (H4): only the rarest grams are joined.

    Of n grams, ordered from rare to common in both sides together, any partner of similarity t shares one of the
    first n - ceil(t n) + 1; candidates are then verified on their whole sets. Nothing is lost.
    """
    a, b = cut(_gram_sets(queries, query_id, query_text, "a", norm), "grams-a"), cut(_gram_sets(corpus, doc_id, doc_text, "b", norm), "grams-b")
    ea, eb = a.select("a", F.size("ga").alias("n"), F.explode("ga").alias("g")), b.select("b", F.size("gb").alias("n"), F.explode("gb").alias("g"))
    freq = ea.select("g").unionByName(eb.select("g")).groupBy("g").agg(F.count(F.lit(1)).alias("f"))

    def prefix(e: DataFrame, side: str) -> DataFrame:
        w = Window.partitionBy(side).orderBy("f", "g")
        r = e.join(freq.where("f > 1"), "g", "left").withColumn("f", F.coalesce("f", F.lit(1))).withColumn("r", F.row_number().over(w))
        return r.where(F.col("r") <= F.col("n") - F.ceil(F.lit(t) * F.col("n") - F.lit(1e-9)) + 1).where("f > 1").select(side, F.col("n").alias(f"n{side}"), F.col("g").alias(f"k{side}"))

    pa, pb = prefix(ea, "a"), prefix(eb, "b")
    fits = (F.col("ka") == F.col("kb")) & (F.least("na", "nb") >= F.lit(t) * F.greatest("na", "nb") - F.lit(1e-9))
    pairs = pa.join(pb, fits).select("a", "b").distinct()
    full = pairs.join(a, "a").join(b, "b")
    n = F.size(F.array_intersect("ga", "gb"))
    s = n / (F.size("ga") + F.size("gb") - n)
    return full.select("a", "b", s.alias("similarity")).where(F.col("similarity") >= F.lit(t) - 1e-12)


def overlapping(rows: DataFrame, tests: DataFrame, id_col: str, text: str, test_id: str, test_text: str, t: float = 0.92, norm: Norm = normalize_exact) -> DataFrame:
    """(id, kind): rows whose text equals a test text after normalisation, or is near one (D3, H3)."""
    norms = tests.select(norm(test_text).alias("__n")).where("__n <> ''").distinct()
    exact = rows.withColumn("__n", norm(text)).join(norms, "__n", "left_semi").select(F.col(id_col), F.lit("exact").alias("kind"))
    near = near_overlap(tests, rows, test_id, test_text, id_col, text, t, norm).select(F.col("b").alias(id_col), F.lit("near").alias("kind"))
    return exact.unionByName(near).groupBy(id_col).agg(F.min("kind").alias("kind"))


def decontaminate(rows: DataFrame, tests: DataFrame, blocked: DataFrame, id_col: str, text: str, test_id: str, test_text: str, t: float = 0.92, norm: Norm = normalize_exact) -> tuple[DataFrame, DataFrame]:
    """(clean rows, blocklist): removes overlapping and formerly blocked rows; the blocklist only grows."""
    bad = overlapping(rows, tests, id_col, text, test_id, test_text, t, norm).select(id_col)
    blocklist = blocked.select(id_col).unionByName(bad).distinct()
    return rows.join(blocklist, id_col, "left_anti"), blocklist


def decontaminate_until_clean(rows: DataFrame, tests: DataFrame, blocked: DataFrame, id_col: str, text: str, test_id: str, test_text: str, cycles: int, t: float = 0.92, norm: Norm = normalize_exact) -> tuple[DataFrame, DataFrame, bool]:
    """Repeats :func:`decontaminate` until an audit finds nothing, ``cycles`` times at most (H6)."""
    for _ in range(cycles):
        rows, blocked = decontaminate(rows, tests, blocked, id_col, text, test_id, test_text, t, norm)
        rows, blocked = cut(rows, "clean"), cut(blocked, "blocked")
        if overlapping(rows, tests, id_col, text, test_id, test_text, t, norm).isEmpty():
            return rows, blocked, True
    return rows, blocked, False


def exclude_near(train: DataFrame, dev: DataFrame, id_col: str, text: str, t: float = 0.92, norm: Norm = normalize_exact) -> DataFrame:
    """Training rows that are near no dev row (H7)."""
    near = near_overlap_prefix(dev, train, id_col, text, id_col, text, t, norm).select(F.col("b").alias(id_col)).distinct()
    return train.join(near, id_col, "left_anti")


MIN_WORDS = 12


def near_edges(rows: DataFrame, key: str, id_col: str, text: str, threshold: float = 0.88, norm: Norm = normalize_exact) -> DataFrame:
    """(key, a, b): pairs a < b of one key whose wording is near and whose numbers are the same.

    Both have at least 12 words, the same number signature and a matching ratio of at least the threshold. Bounds
    on the ratio from the lengths and from the counts of letters are checked inside the join, so few pairs reach
    the matcher.
    """
    a, b = _matchable(rows, key, id_col, text, norm).alias("a"), _matchable(rows, key, id_col, text, norm).alias("b")
    pairs = a.join(b, _may_match(key, threshold) & (F.col("a.__i") < F.col("b.__i"))).select(F.col(f"a.{key}").alias(key), F.col("a.__i").alias("a"), F.col("b.__i").alias("b"), F.col("a.__n").alias("x"), F.col("b.__n").alias("y"))
    return _matched(pairs, rows, key, id_col, threshold)


def _matchable(rows: DataFrame, key: str, id_col: str, text: str, norm: Norm) -> DataFrame:
    """(key, id, text, number signature, counts of letters, length) of texts of enough words."""
    n = rows.select(key, F.col(id_col).alias("__i"), norm(text).alias("__n")).where(F.size(F.split("__n", " ")) >= MIN_WORDS)
    letters = F.array(*(F.length("__n") - F.length(F.replace(F.col("__n"), F.lit(c), F.lit(""))) for c in "abcdefghijklmnopqrstuvwxyz "))
    return n.select(key, "__i", "__n", F.array_join(number_signature(F.col("__n")), " ").alias("__s"), letters.alias("__l"), F.length("__n").alias("__len"))


def _may_match(key: str, threshold: float) -> Column:
    total = F.col("a.__len") + F.col("b.__len")
    known = F.aggregate(F.zip_with("a.__l", "b.__l", lambda x, y: F.abs(x - y)), F.lit(0), lambda acc, x: acc + x)
    return (
        (F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")))
        & (F.col("a.__s") == F.col("b.__s"))
        & (2 * F.least("a.__len", "b.__len") >= threshold * total)
        & (total - known >= threshold * total)
    )


def _matched(pairs: DataFrame, rows: DataFrame, key: str, id_col: str, threshold: float) -> DataFrame:
    kind, ikind = rows.schema[key].dataType.simpleString(), rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            near = [SequenceMatcher(None, y, x, autojunk=False).ratio() >= threshold for x, y in zip(pdf["x"], pdf["y"])]
            yield pdf.loc[near, [key, "a", "b"]]

    return pairs.mapInPandas(run, f"`{key}` {kind}, a {ikind}, b {ikind}")


def near_admission(rows: DataFrame, key: str, id_col: str, text: str, threshold: float = 0.88, existing: DataFrame | None = None, norm: Norm = normalize_exact) -> DataFrame:
    """Rows that a pass in id order admits: not empty, not equal and not near an *admitted* earlier row (H2).

    ``existing`` (key, text) are questions admitted before: a row equal or near to one of its key is rejected. The
    pass is order-dependent, but a row's fate needs only its earlier neighbours: in every round rows whose earlier
    neighbours are all rejected are admitted, and their later neighbours rejected. There are as many rounds as the
    longest chain of dependent rows is long, each of them settles a row at least.
    """
    if existing is not None:
        known = existing.select(F.col(key).alias("__k"), norm(text).alias("__e")).where("__e <> ''").distinct()
        rows = rows.withColumn("__n", norm(text)).join(known, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__n") == F.col("__e")), "left_anti").drop("__n")
        seeds = existing.select(F.col(key), F.col(text), F.lit(None).cast(rows.schema[id_col].dataType).alias(id_col))
        a, b = _matchable(seeds, key, id_col, text, norm).alias("a"), _matchable(rows, key, id_col, text, norm).alias("b")
        pairs = a.join(b, _may_match(key, threshold)).select(F.col(f"b.{key}").alias(key), F.col("b.__i").alias("a"), F.col("b.__i").alias("b"), F.col("a.__n").alias("x"), F.col("b.__n").alias("y"))
        near = cut(_matched(pairs, rows, key, id_col, threshold).select(F.col("b").alias("__g")).distinct(), "near-existing")
        rows = rows.join(near, F.col(id_col) == F.col("__g"), "left_anti")
    first = cut(_first_of_key(rows, key, id_col, text, norm), "first")
    open_edges = cut(near_edges(first, key, id_col, text, threshold, norm).select("a", "b"), "near-edges")
    done_out = None
    while True:
        waiting = open_edges.select("b").distinct()
        sure = open_edges.select("a").distinct().join(waiting, F.col("a") == F.col("b"), "left_anti")
        out = cut(open_edges.join(sure, "a", "left_semi").select("b").distinct(), "rejected")
        if out.isEmpty():
            break
        done_out = out if done_out is None else done_out.unionByName(out)
        gone = out.select(F.col("b").alias("__g"))
        open_edges = open_edges.join(sure, "a", "left_anti").join(gone, F.col("b") == F.col("__g"), "left_anti").join(gone, F.col("a") == F.col("__g"), "left_anti")
        open_edges = cut(open_edges, "open-edges")
    if done_out is None:
        return first
    return first.join(done_out.select(F.col("b").alias("__g")), F.col(id_col) == F.col("__g"), "left_anti")


def _first_of_key(rows: DataFrame, key: str, id_col: str, text: str, norm: Norm = normalize_exact) -> DataFrame:
    n = rows.withColumn("__n", norm(text)).where("__n <> ''")
    w = Window.partitionBy(key, "__n").orderBy(id_col)
    return n.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__n", "__r")


def duplicate_issues(rows: DataFrame, path: str, id_col: str, text: str, norm: Norm = normalize_exact) -> DataFrame:
    """(issue, path, id, detail): repeated ids and questions within and across files.

    The first row by (path, id) of an id or a normalised question is the reference for the others.
    """
    n = rows.withColumn("__n", norm(text))
    by_id, by_text = Window.partitionBy(id_col).orderBy(path, "__n"), Window.partitionBy("__n").orderBy(path, id_col)
    marked = n.withColumn("__ri", F.row_number().over(by_id)).withColumn("__pi", F.first(path).over(by_id))
    marked = marked.withColumn("__rt", F.row_number().over(by_text)).withColumn("__pt", F.first(path).over(by_text))
    out = lambda name, detail: (F.lit(name).alias("issue"), F.col(path).alias("path"), F.col(id_col).alias("id"), detail.alias("detail"))
    ids = marked.where("__ri > 1").select(*out("duplicate_id", F.col("__pi")))
    texts = marked.where("__rt > 1 and __n <> ''").select(*out("duplicate_normalized_question", F.col("__pt")))
    return ids.unionByName(texts)


def gold_name_in_query(rows: DataFrame, skills: DataFrame, id_col: str, text: str, gold: Column, norm: Norm = normalize_exact) -> DataFrame:
    """(id, skill_id): rows whose question contains the name of one of their gold skills."""
    g = rows.select(F.col(id_col), norm(text).alias("__q"), F.explode(gold).alias("skill_id"))
    s = skills.select("skill_id", norm("name").alias("__name")).where("__name <> ''")
    return g.join(s, "skill_id").where(F.contains("__q", "__name")).select(id_col, "skill_id").distinct()
