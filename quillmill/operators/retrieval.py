"""Sparse and dense retrieval, fusion and metrics; rankings are long: (query_id, rank, item_id, score)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.strings import tokens

DENSE_BLOCK = 4096  #: queries scored in one pass over the corpus
CATALOG_ROWS = 2_000_000  #: most (term, item) pairs of a catalog whose index is broadcast (about 100 MB)
SCORED_DOCS = 500  #: documents scored at once in a worker


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term, tf, dl): terms of each document and its length; null and empty texts have no row.

    Tokens move once, to the partition of their document; the counts are then made in place.
    """
    t = docs.select(F.col(id_col).alias("item_id"), tokens(F.col(text_col)).alias("t")).where(F.size("t") > 0)
    placed = t.repartition("item_id").select("item_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return placed.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").cast("bigint").alias("dl"))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, term, qtf): terms of each query."""
    t = queries.select(F.col(id_col).alias("query_id"), F.explode(tokens(F.col(text_col))).alias("term"))
    return t.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def document_stats(docs: DataFrame, text_col: str) -> DataFrame:
    """One row (n_docs, avgdl) over documents that have a text; empty ones count with length 0."""
    n = F.size(tokens(F.col(text_col)))
    return docs.where(F.col(text_col).isNotNull()).agg(F.count(F.lit(1)).alias("n_docs"), F.avg(n).alias("avgdl"))


def _with_stats(counts: DataFrame, stats: DataFrame) -> DataFrame:
    # one row, so this is no product of tables
    return counts.join(F.broadcast(stats))


def bm25_scores(queries: DataFrame, docs: DataFrame, query_id: str, query_text: str, doc_id: str, doc_text: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, item_id, score) of all pairs with a positive score.

    The idf is clipped at zero, so terms of more than half of the documents weigh nothing and are dropped
    before the join; query terms count once.
    """
    counts = term_counts(docs, doc_id, doc_text)
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = document_stats(docs, doc_text)
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = query_terms(queries, query_id, query_text).select("query_id", "term")
    weighed = _with_stats(df.join(terms.select("term").distinct(), "term", "left_semi"), stats).select("term", idf.alias("idf"), "avgdl").where("idf > 0")
    wanted = terms.join(weighed, "term")
    tf = F.col("tf")
    w = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return counts.join(wanted, "term").groupBy("item_id", "query_id").agg(F.sum(w).alias("score")).select("query_id", "item_id", "score")


def bm25_top_k(queries: DataFrame, docs: DataFrame, query_id: str, query_text: str, doc_id: str, doc_text: str, k: int, k1: float = 1.5, b: float = 0.75, block: int = DENSE_BLOCK) -> DataFrame:
    """The result of top_k(bm25_scores(...), k) for a small set of queries against any number of documents.

    A block of at most ``block`` queries is broadcast as an index from term to queries; documents are scored where
    they lie, and only the k best of a partition leave it, so neither terms nor pairs are shuffled. Document
    frequencies are counted for the block's terms alone, one partial count a partition. For many queries against
    a small catalog there is :func:`catalog_top_k`.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = docs.sparkSession
    words = docs.where(F.col(doc_text).isNotNull()).select(F.col(doc_id).alias("item_id"), tokens(F.col(doc_text)).alias("t"))
    kind, qkind = docs.schema[doc_id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    stats = document_stats(docs, doc_text).first()
    n_docs, avgdl = stats["n_docs"], stats["avgdl"] or 1.0
    parts = max(1, -(-queries.count() // block))
    found = None
    for part in range(parts):
        mine = queries.where(F.pmod(F.xxhash64(query_id), F.lit(parts)) == part).select(F.col(query_id).alias("q"), tokens(F.col(query_text)).alias("t"))
        rows = mine.where("t is not null").toArrow()
        ids = rows.column("q").to_pylist()
        index: dict[str, list[int]] = {}
        for i, terms in enumerate(rows.column("t").to_pylist()):
            for term in set(terms):
                index.setdefault(term, []).append(i)
        vocabulary = spark.sparkContext.broadcast(frozenset(index))

        def count(batches: Iterator[pa.RecordBatch], vocabulary=vocabulary) -> Iterator[pa.RecordBatch]:
            df: Counter[str] = Counter()
            for batch in batches:
                for terms in batch.column(0).to_pylist():
                    df.update(vocabulary.value.intersection(terms))
            yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], names=["term", "df"])

        # as many rows as the block of queries has terms
        dfs = {r["term"]: r["df"] for r in words.select("t").mapInArrow(count, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()}
        idf = {w: math.log((n_docs - n + 0.5) / (n + 0.5)) for w, n in dfs.items()}
        weights = {w: (np.array(index[w]), x) for w, x in idf.items() if x > 0}
        shared = spark.sparkContext.broadcast((ids, weights))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, known = shared.value
            kept_s = np.full((len(names), 0), -np.inf)
            kept_i: np.ndarray | None = None
            for batch in batches:
                for at in range(0, batch.num_rows, SCORED_DOCS):
                    piece = batch.slice(at, SCORED_DOCS)
                    s = np.zeros((len(names), piece.num_rows))
                    for j, terms in enumerate(piece.column(1).to_pylist()):
                        norm = k1 * (1 - b + b * len(terms) / avgdl)
                        for term, tf in Counter(terms).items():
                            hit = known.get(term)
                            if hit is not None:
                                s[hit[0], j] += hit[1] * tf * (k1 + 1) / (tf + norm)
                    s[s <= 0] = -np.inf
                    own = np.broadcast_to(np.asarray(piece.column(0).to_pylist()), s.shape)
                    kept_s = np.concatenate([kept_s, s], axis=1)
                    kept_i = own if kept_i is None else np.concatenate([kept_i, own], axis=1)
                    order = np.lexsort((kept_i, -np.round(kept_s, 9)), axis=1)[:, :k]
                    kept_s, kept_i = np.take_along_axis(kept_s, order, 1), np.take_along_axis(kept_i, order, 1)
            if kept_i is not None:
                good = np.isfinite(kept_s)
                q = [names[i] for i in np.repeat(np.arange(len(names)), good.sum(1))]
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(kept_i[good].tolist()), pa.array(kept_s[good])], names=["query_id", "item_id", "score"]) if q else _no_rows(qkind, kind)

        one = words.mapInArrow(run, f"query_id {qkind}, item_id {kind}, score double")
        found = one if found is None else found.unionByName(one)
    return top_k(found, k)


def _no_rows(qkind: str, kind: str) -> pa.RecordBatch:
    form = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([], form[qkind]), pa.array([], form[kind]), pa.array([], pa.float64())], names=["query_id", "item_id", "score"])


def tfidf_scores(queries: DataFrame, docs: DataFrame, query_id: str, query_text: str, doc_id: str, doc_text: str) -> DataFrame:
    """(query_id, item_id, score): cosine of tf-idf vectors, idf = ln(N / (1 + df)) unclipped."""
    counts = term_counts(docs, doc_id, doc_text)
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = document_stats(docs, doc_text)
    weighed = _with_stats(df, stats).select("term", F.log(F.col("n_docs") / (1 + F.col("df"))).alias("idf"))
    dw = counts.join(weighed, "term").select("item_id", "term", (F.col("tf") / F.col("dl") * F.col("idf")).alias("w"))
    norms = dw.groupBy("item_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    known = query_terms(queries, query_id, query_text).join(weighed, "term")
    length = Window.partitionBy("query_id")
    qw = known.withColumn("qlen", F.sum("qtf").over(length)).select("query_id", "term", (F.col("qtf") / F.col("qlen") * F.col("idf")).alias("qw"))
    qw = qw.withColumn("qnorm", F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(length)))
    one = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(F.col(c))
    dots = dw.join(qw, "term").groupBy("item_id", "query_id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"), F.first("qnorm").alias("qnorm"))
    return dots.join(norms, "item_id").select("query_id", "item_id", (F.col("dot") / one("norm") / one("qnorm")).alias("score"))


def catalog_top_k(queries: DataFrame, items: DataFrame, query_id: str, query_text: str, item_id: str, item_text: str, k: int, k1: float = 1.5, b: float = 0.75, bound: int = CATALOG_ROWS) -> DataFrame:
    """The result of top_k(bm25_scores(...), k) for any number of queries over a catalog of items.

    If the catalog has at most ``bound`` (term, item) pairs, its weighed index is broadcast and every query is scored
    where it lies: one narrow pass, k rows a query, no term shuffled. A larger catalog is joined by term. Queries
    without a term and items without a text are in no row; equal scores go by item.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    counts = term_counts(items, item_id, item_text)
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf, tf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.col("tf")
    w = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    weights = _with_stats(counts.join(df, "term"), document_stats(items, item_text)).where(idf > 0).select("term", "item_id", w.alias("w"))
    index = weights.limit(bound + 1).toArrow()
    if index.num_rows > bound:
        return top_k(bm25_scores(queries, items, query_id, query_text, item_id, item_text, k1, b), k)
    names = sorted(set(index.column("item_id").to_pylist()))
    at = {x: i for i, x in enumerate(names)}
    terms = index.column("term").to_pylist()
    words = {t: i for i, t in enumerate(dict.fromkeys(terms))}
    place = np.fromiter((words[t] for t in terms), dtype=np.int64, count=len(terms))
    order = np.argsort(place, kind="stable")
    item = np.fromiter(map(at.__getitem__, index.column("item_id").to_pylist()), dtype=np.int64, count=len(terms))[order]
    weight = index.column("w").to_numpy().astype(np.float64)[order] if len(terms) else np.empty(0)
    stop = np.searchsorted(place[order], np.arange(len(words)), "right")
    start = np.concatenate(([0], stop[:-1])).astype(np.int64)
    shared = items.sparkSession.sparkContext.broadcast((names, words, start, stop, item, weight))
    kinds = f"query_id {queries.schema[query_id].dataType.simpleString()}, rank int, item_id {items.schema[item_id].dataType.simpleString()}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, words, start, stop, item, weight = shared.value
        name_array = pa.array(names)
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):  # so many rows of scores at once
                part = batch.slice(first, 1000)
                known = [[j for t in set(ts or ()) if (j := words.get(t)) is not None] for ts in part.column(1).to_pylist()]
                owner = np.repeat(np.arange(len(known)), [len(x) for x in known])
                term = np.fromiter((j for x in known for j in x), dtype=np.int64, count=len(owner))
                n = stop[term] - start[term]
                where = np.repeat(start[term] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                cell = np.repeat(owner, n) * len(names) + item[where]
                scores = np.bincount(cell, weight[where], minlength=len(known) * len(names)).reshape(len(known), len(names))
                best = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :k]
                top = np.take_along_axis(scores, best, 1)
                q, r = np.nonzero(top > 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(q)), pa.array((r + 1).astype(np.int32)), name_array.take(pa.array(best[q, r])), pa.array(top[q, r])],
                    names=["query_id", "rank", "item_id", "score"],
                )

    if not names:
        return items.sparkSession.createDataFrame([], kinds)
    source = queries.select(F.col(query_id).alias("query_id"), tokens(F.col(query_text)).alias("t"))
    return source.mapInArrow(run, kinds)


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, item_id, score): best k items a query, ties by item; equal to nine digits is a tie."""
    if k < 1:
        raise ValueError("k must be at least 1")
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("item_id"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "item_id", "score")


def dense_top_k(queries: DataFrame, items: DataFrame, query_id: str, query_vec: str, item_id: str, item_vec: str, k: int, block: int = DENSE_BLOCK, skip_self: bool = True) -> DataFrame:
    """(query_id, rank, item_id, score): cosine top-k by blocks of queries.

    A block of at most ``block`` queries is broadcast and multiplied with the vectors of each partition; only the
    k best of a partition leave it. Null and zero vectors, and those of another length than the queries', match nothing. Ids must be whole numbers.
    """
    spark = items.sparkSession
    n = queries.count()
    parts = max(1, -(-n // block))
    found = None
    for part in range(parts):
        mine = queries.where(F.pmod(F.xxhash64(query_id), F.lit(parts)) == part).where(F.col(query_vec).isNotNull()).select(query_id, query_vec).toArrow()
        if not mine.num_rows and found is not None:
            continue
        ids = mine.column(0).to_numpy()
        vec = np.array(mine.column(1).to_pylist(), dtype=np.float64).reshape(len(ids), -1)
        shared = spark.sparkContext.broadcast((ids, _unit(vec)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, q = shared.value
            kept_s, kept_i = np.full((len(qids), 0), -np.inf), np.full((len(qids), 0), 0, dtype=np.int64)
            for b in batches:
                vs = b.column(1).to_pylist()
                rows = [i for i, v in enumerate(vs) if v and len(v) == q.shape[1]]
                if not rows or not len(qids):
                    continue
                x = _unit(np.array([vs[i] for i in rows], dtype=np.float64))
                got = np.asarray(b.column(0))[rows].astype(np.int64)
                s = np.round(q @ x.T, 9)
                if skip_self:
                    s[qids[:, None] == got[None, :]] = -np.inf
                kept_s = np.concatenate([kept_s, s], axis=1)
                kept_i = np.concatenate([kept_i, np.broadcast_to(got, s.shape)], axis=1)
                order = np.lexsort((kept_i, -kept_s), axis=1)[:, :k]
                kept_s, kept_i = np.take_along_axis(kept_s, order, 1), np.take_along_axis(kept_i, order, 1)
            good = np.isfinite(kept_s)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, good.sum(1)).astype(np.int64)), pa.array(kept_i[good]), pa.array(kept_s[good])], names=["query_id", "item_id", "score"])

        one = items.select(F.col(item_id).cast("bigint"), F.col(item_vec)).mapInArrow(run, "query_id bigint, item_id bigint, score double")
        found = one if found is None else found.unionByName(one)
    return top_k(found, k)


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n == 0, 1.0, n)


def round_robin(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Interleaves two rankings, a before b; an item's first place counts; queries of both only."""
    both = a.select("query_id").distinct().join(b.select("query_id").distinct(), "query_id")
    tagged = a.withColumn("slot", 2 * F.col("rank")).unionByName(b.withColumn("slot", 2 * F.col("rank") + 1)).join(both, "query_id", "left_semi")
    first = tagged.groupBy("query_id", "item_id").agg(F.min("slot").alias("slot"), F.min_by("score", "slot").alias("score"))
    w = Window.partitionBy("query_id").orderBy("slot")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "item_id", "score")


def rank_scores(order: DataFrame, source: DataFrame) -> DataFrame:
    """Listwise reranking: the parsed order first, then what it left out in source order; score 1/rank."""
    joined = source.alias("s").join(order.select("query_id", "item_id", F.col("rank").alias("new")), ["query_id", "item_id"], "left")
    w = Window.partitionBy("query_id").orderBy(F.col("new").asc_nulls_last(), F.col("rank"))
    ranked = joined.withColumn("r", F.row_number().over(w))
    return ranked.select("query_id", F.col("r").alias("rank"), "item_id", (1 / F.col("r")).alias("score"))


def rerank(candidates: DataFrame, score: Callable[[DataFrame], Column] | Column, k: int) -> DataFrame:
    """Reorders candidates (query_id, rank, item_id, ...) by a scorer column, ties in source order."""
    s = score(candidates) if callable(score) else score
    w = Window.partitionBy("query_id").orderBy(F.col("new").desc(), F.col("rank"))
    ranked = candidates.withColumn("new", s).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return ranked.select("query_id", F.col("r").alias("rank"), "item_id", F.col("new").alias("score"))


def retrieval_metrics(results: DataFrame, gold: DataFrame, k_max: int, ks: tuple[int, ...] = (1, 5, 10, 50)) -> DataFrame:
    """(metric, value): mean Recall@K and nDCG@K for K up to k_max over the queries of ``gold``.

    ``gold`` holds (query_id, item_id); a query with a null item has no gold and scores 0.
    """
    use = [k for k in ks if k <= k_max]
    if not use:
        raise ValueError("k_max must be at least 1")
    g = gold.select("query_id", "item_id").distinct()
    size = g.groupBy("query_id").agg(F.count("item_id").alias("n_gold"))
    hits = results.select("query_id", "item_id", "rank").join(g.where("item_id is not null"), ["query_id", "item_id"])
    gain = 1 / F.log2(F.col("rank") + 1.0)
    per = hits.groupBy("query_id").agg(*(F.sum(F.when(F.col("rank") <= k, 1.0)).alias(f"h{k}") for k in use), *(F.sum(F.when(F.col("rank") <= k, gain)).alias(f"d{k}") for k in use))
    joined = size.join(per, "query_id", "left")
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(F.when(F.col("n_gold") > 0, c), F.lit(0.0))
    cols = [F.avg(zero(F.coalesce(F.col(f"h{k}"), F.lit(0.0)) / F.col("n_gold"))).alias(f"Recall@{k}") for k in use] + [F.avg(zero(F.coalesce(F.col(f"d{k}"), F.lit(0.0)) / ideal(k))).alias(f"nDCG@{k}") for k in use]
    row = joined.agg(*cols)
    names = [f"Recall@{k}" for k in use] + [f"nDCG@{k}" for k in use]
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias("value")) for n in names))).alias("m")).select("m.metric", "m.value")


def router_metrics(results: DataFrame, gold: DataFrame, dataset: Column) -> DataFrame:
    """(scope, queries, r1, r5, r10, mrr10): micro, per dataset, macro over skills, and their selection mean.

    ``gold`` holds (query_id, item_id); ``dataset`` is an expression over it. The macro row averages, over gold
    items, the share of their queries whose first gold item is at rank 1.
    """
    g = gold.where("item_id is not null").select("query_id", "item_id", dataset.alias("dataset")).distinct()
    hit = results.where("rank <= 10").join(g, ["query_id", "item_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    by_query = g.select("query_id", "dataset").distinct().join(hit, "query_id", "left")
    at = lambda k: F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0))
    agg = [F.count(F.lit(1)).alias("queries"), at(1).alias("r1"), at(5).alias("r5"), at(10).alias("r10"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr10")]
    sets = by_query.groupBy("dataset").agg(*agg).select(F.concat(F.lit("dataset:"), "dataset").alias("scope"), "queries", "r1", "r5", "r10", "mrr10")
    micro = by_query.select("query_id", "first").distinct().agg(*agg).select(F.lit("micro").alias("scope"), "queries", "r1", "r5", "r10", "mrr10")
    per_item = g.select("query_id", "item_id").distinct().join(hit, "query_id", "left").groupBy("item_id").agg(at(1).alias("r1"))
    empty = [F.lit(None).cast("double").alias(c) for c in ("r5", "r10", "mrr10")]
    macro = per_item.agg(F.count(F.lit(1)).alias("queries"), F.avg("r1").alias("r1")).select(F.lit("skill_macro").alias("scope"), "queries", "r1", *empty)
    selection = sets.agg(F.count(F.lit(1)).alias("queries"), F.avg("r1").alias("r1")).select(F.lit("selection").alias("scope"), "queries", "r1", *empty)
    return micro.unionByName(sets).unionByName(macro).unionByName(selection)


def distractors(gold: DataFrame, lexical: DataFrame, semantic: DataFrame, n: int) -> DataFrame:
    """(query_id, pos, item_id): up to n hard negatives, the two rankings taking turns.

    A turn takes the next unseen item of its ranking; an exhausted ranking passes its turn to the other. The
    pointers depend on each other, so a query's two short lists are walked together in Python.
    """
    lists = lambda r, name: r.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias(name))
    g = gold.groupBy("query_id").agg(F.collect_set("item_id").alias("gold"))
    joined = g.join(lists(lexical, "lex"), "query_id", "left").join(lists(semantic, "sem"), "query_id", "left")
    kind = gold.schema["item_id"].dataType.simpleString()
    qkind = gold.schema["query_id"].dataType.simpleString()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for q, own, lex, sem in zip(pdf["query_id"], pdf["gold"], pdf["lex"], pdf["sem"]):
                seen = set(own)
                pools = [iter(list(x) if x is not None else []) for x in (lex, sem)]
                for i in range(n):
                    pick = next((x for p in (pools[i % 2], pools[1 - i % 2]) for x in p if x not in seen), None)
                    if pick is None:
                        break
                    seen.add(pick)
                    out.append((q, i, pick))
            yield pd.DataFrame(out, columns=["query_id", "pos", "item_id"])

    return joined.mapInPandas(run, f"query_id {qkind}, pos int, item_id {kind}")


def contrastive_loss(scores: DataFrame, temperature: float = 0.05) -> DataFrame:
    """(query_id, loss): log-sum-exp of all scores less that of the positives, duplicate items once.

    ``scores`` holds (query_id, item_id, score, positive). A query without positives has a null loss.
    """
    once = scores.groupBy("query_id", "item_id").agg(F.max("score").alias("score"), F.max("positive").alias("positive"))
    z = F.col("score") / temperature
    top = F.max(z).over(Window.partitionBy("query_id"))
    e = once.withColumn("e", F.exp(z - top))
    sums = e.groupBy("query_id").agg(F.sum("e").alias("a"), F.sum(F.when(F.col("positive"), F.col("e"))).alias("p"))
    return sums.select("query_id", (F.log("a") - F.log("p")).alias("loss"))
